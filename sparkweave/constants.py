"""Constants of the domain."""

# Countries, verdicts and the statutory term lists that results depend on.
COUNTRIES = ("DE", "FR", "NL", "UK", "IT", "ES")
REUSABLE, DOUBTFUL, BLOCKED = "可复用", "存疑", "需拦截"
STATUTORY_TERMS = {
    "ucpd_env_generic": (
        "eco-friendly", "eco friendly", "environmentally friendly", "environment friendly", "sustainable", "sustainability",
        "biodegradable", "100% natural", "all-natural", "umweltfreundlich", "klimafreundlich", "nachhaltig", "biologisch abbaubar",
        "100% natürlich", "öko-freundlich", "respectueux de l'environnement", "écologique", "ecologique", "éco-responsable",
        "eco-responsable", "biodégradable", "100% naturel", "milieuvriendelijk", "biologisch afbreekbaar", "100% natuurlijk",
        "duurzaam", "ecologico", "ecologica", "ecosostenibile", "biodegradabile", "100% naturale", "ecológico",
        "respetuoso con el medio ambiente",
    ),
    "ucpd_carbon_offset": (
        "climate-neutral", "climate neutral", "carbon-neutral", "carbon neutral", "net-zero", "net zero", "zero emission",
        "co2 neutral", "co2-neutral", "carbon offset", "carbon-offset", "climateneutral", "klimaneutral", "kohlenstoffneutral",
        "emissionsfrei", "neutre en carbone", "neutre en climat", "climatiquement neutre", "zéro émission", "klimaatneutraal",
        "co2-neutraal", "a impatto zero", "neutro en carbono", "climáticamente neutro", "carbono neutral",
    ),
    "ucpd_env_unverified_label": ("eco label", "eco-label", "green label", "green seal", "eco certified", "eco-certified"),
}
MANUAL_RULE = "manual_banned"
SAFE_REASON, STATUTORY_REASON, BANNED_REASON = "通过安全词库", "命中UCPD禁用词库(%s): %s", "命中%s广告法禁用词库(%s)"
NO_ANCHOR = " [未找到对应中文锚点]"
SCORE_RANKS, SCORE_FLOOR = 15, 0.1
TOP_PER_COUNTRY, PER_COUNTRY, FIRST_QUOTA, TOTAL_CAP = 50, 20, 15, 120
RECALL, RERANK, DEFAULT_OUTPUT, MAX_OUTPUT = 16, 8, 5, 10
PICK_REASON, FILL_REASON = "基于 LLM 精排推荐", "基于向量相似度补充推荐"
THRESHOLD_WITH_CATEGORY, THRESHOLD_WITHOUT = 0.60, 0.75
PROGRESS_KEYS, CACHE_KEYS, RECENT_ANCHORS, BATCH = 1000, 2000, 50, 12
RETENTION_DAYS = {"llm_trace": 90, "audit_log": 396, "lineage_event": 396}
MIN_DAYS, MAX_DAYS = 30, 3650
MANUAL_REJECT = "manual_reject"
HOT_SECONDS, HOT_MISS_SECONDS = 600, 60
VERDICTS = (REUSABLE, DOUBTFUL, BLOCKED)
DEFAULT_REASON, REASON_CHARS = "LLM 返回的判定理由无效，请人工审核", 200
DEADLINE_DAYS = 30
REQUEST_TYPES = ("access", "erasure", "objection")
TICKET_STATUS = ("received", "in_progress", "completed", "rejected")
BOUNDS = {
    "title": (1, 500, "text"), "category": (0, 100, "text"), "top_k": (1, 10, "number"), "term": (1, 500, "text"), "contact": (3, 500, "text"),
    "note": (0, 2000, "text"), "reason": (1, 2000, "text"), "cron": (9, 100, "text"),
}
# end of fixed values
