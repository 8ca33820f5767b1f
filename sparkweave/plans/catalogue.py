"""The registered queries on the reference's own operators, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import COUNTRIES, DOUBTFUL, PROGRESS_KEYS, RECENT_ANCHORS, STATUTORY_TERMS
from ..functions import text as tx
from ..functions import validate
from ..functions.ids import point_id, text_hash
from ..functions.pii import pseudonymise
from ..functions.vector import normalise
from ..operators import collect, governance, listing, points, recommend, review, route, rules, search, store
from ..operators.shared import dealt
from .views import duck_query, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def operator(name: str, views: tuple[str, ...] = (), duck: str | None = None):
    """Registers a function of (spark, sf_dir); ``duck`` is SQL over the views."""

    def add(f):
        QUERIES[name] = f
        if duck:
            ORACLE_SQL[name] = duck_query(views, duck)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


COSINE = "round(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6)"


def cosine(a: str, b: str) -> str:
    return COSINE.replace("{a}", a).replace("{b}", b)


# ---------------------------------------------------------------- search

_ASKED = """asked AS (SELECT id AS qid, vector AS q, category AS want, country.c AS qc FROM anchors CROSS JOIN (SELECT unnest(['DE','FR','NL','UK','IT','ES']) AS c) country),
found AS (SELECT qid, want, t.id, t.word, t.country, t.category, t.source, t.trend_score, """ + cosine("t.vector", "q") + """ AS similarity FROM asked JOIN tags t ON t.country = qc WHERE t.compliance_status = '可复用'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, country ORDER BY similarity DESC, id) AS ord FROM found)"""


def _asked(spark, sf_dir) -> DataFrame:
    """Every anchor asks in every country."""
    a = view(spark, sf_dir, "anchors").select(F.col("id").alias("aid"), F.col("vector").alias("q"), F.col("category").alias("want"))
    a = a.withColumn("country", F.explode(F.array(*(F.lit(c) for c in COUNTRIES))))
    return a.withColumn("qid", F.concat_ws(":", F.col("aid"), F.col("country"))).drop("aid")


_RECALLED = ("qid", "id", "word", "country", "category", "source", "trend_score", "similarity")


def _qid(df: DataFrame) -> DataFrame:
    return df.withColumn("qid", F.split_part("qid", F.lit(":"), F.lit(1)).cast("long"))


@operator("q01_recommend_topk", ("anchors", "tags"), f"WITH {_ASKED}, kept AS (SELECT *, row_number() OVER (PARTITION BY qid, country ORDER BY ord) AS position FROM ranked WHERE ord <= 16 AND (want IS NULL OR category IS NULL OR category = want)) SELECT qid, id, word, country, category, source, trend_score, similarity, position FROM kept WHERE position <= 5")
def recommend_topk(spark, sf_dir):
    return _qid(search.recommend(view(spark, sf_dir, "tags"), _asked(spark, sf_dir), 5)).select(*_RECALLED, "position")


@operator("q02_knn_topk_per_query", ("anchors", "tags"), f"WITH {_ASKED} SELECT qid, id, word, country, category, source, trend_score, similarity, ord FROM ranked WHERE ord <= 16")
def knn_topk(spark, sf_dir):
    return _qid(search.recall(view(spark, sf_dir, "tags"), _asked(spark, sf_dir))).select(*_RECALLED, "ord")


@operator("q03_anchor_align_threshold", ("anchors", "tags"), "WITH p AS (SELECT t.id, a.id AS anchor_id, a.cn_word, " + cosine("t.vector", "a.vector") + " AS s FROM tags t JOIN anchors a ON t.category IS NULL OR t.category = a.category), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, anchor_id) AS n FROM p) SELECT t.id, t.word, t.country, t.category, CASE WHEN s >= lim THEN r.anchor_id END AS anchor_id, CASE WHEN s >= lim THEN cn_word END AS anchor_word, CASE WHEN s >= lim THEN s END AS anchor_score FROM (SELECT *, CASE WHEN category IS NULL THEN 0.30 ELSE 0.18 END AS lim FROM tags) t LEFT JOIN (SELECT * FROM r WHERE n = 1) r ON r.id = t.id")
def anchor_align(spark, sf_dir):
    out = search.align(view(spark, sf_dir, "tags").drop("anchor_id"), view(spark, sf_dir, "anchors"), 0.18, 0.30)
    return out.select("id", "word", "country", "category", "anchor_id", "anchor_word", "anchor_score")


@operator("q04_category_soft_filter", ("anchors", "tags"), f"WITH {_ASKED} SELECT qid, id, word, country, category, source, trend_score, similarity FROM ranked WHERE ord <= 16 AND (want IS NULL OR category IS NULL OR category = want)")
def soft_filter(spark, sf_dir):
    return _qid(search.category_filter(search.recall(view(spark, sf_dir, "tags"), _asked(spark, sf_dir)), F.col("want"))).select(*_RECALLED)


@operator("q05_l2_normalise", (), "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) / n)), 6) AS total, round(CAST(embedding[1] AS DOUBLE) / n, 6) AS first FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings)")
def l2_normalise(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", normalise(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.element_at("v", 1), 6).alias("first"))


# ---------------------------------------------------------------- suggestions

FOLD = "replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ')"


def fold(x: str) -> str:
    return FOLD.replace("{x}", x)


_CLEAN = f"clean AS (SELECT * FROM suggestions WHERE length(word) >= 2 AND {fold('word')} <> {fold('seed')} AND NOT regexp_matches(word, '^[0-9]+$'))"
_BEST = _CLEAN + """, scored AS (SELECT *, round(greatest(0.1, 1 - rank / 15.0), 4) AS score FROM clean),
best AS (SELECT country, source, word, max(score) AS trend_score FROM scored GROUP BY ALL),
cats AS (SELECT country, source, word, score, min(struct_pack(r := rank, c := category)).c AS category FROM scored WHERE category IS NOT NULL GROUP BY country, source, word, score),
words AS (SELECT b.country, b.source, b.word, b.trend_score, c.category FROM best b LEFT JOIN cats c ON c.country = b.country AND c.source = b.source AND c.word = b.word AND c.score = b.trend_score),
tops AS (SELECT *, row_number() OVER (PARTITION BY country, source ORDER BY trend_score DESC, word) AS ord FROM words)"""
_MERGE = _BEST + f""", staged AS (SELECT *, CASE WHEN source = 'ebay_suggest' THEN 1 WHEN ord <= 15 THEN 0 ELSE 2 END AS phase FROM tops WHERE ord <= 50),
once AS (SELECT *, row_number() OVER (PARTITION BY country, {fold('word')} ORDER BY phase, ord) AS k FROM staged),
merged AS (SELECT country, word, trend_score, category, source, phase, row_number() OVER (PARTITION BY country ORDER BY phase, ord) AS pick FROM once WHERE k = 1)"""


def _best(spark, sf_dir) -> DataFrame:
    return collect.best_scores(collect.hygiene(view(spark, sf_dir, "suggestions")), "country", "source")


def _merged(spark, sf_dir) -> DataFrame:
    tops = collect.top_per_country(_best(spark, sf_dir), 50, "source")
    return collect.quota_merge(tops.where("source = 'amazon_suggest'"), tops.where("source = 'ebay_suggest'"))


@operator("q06_position_score", ("suggestions",), "SELECT doc_id, rank, word, round(greatest(0.1, 1 - rank / 15.0), 4) AS score FROM suggestions")
def position_score(spark, sf_dir):
    return view(spark, sf_dir, "suggestions").select("doc_id", "rank", "word", collect.position_score(F.col("rank")).alias("score"))


@operator("q07_best_score_dedup", ("suggestions",), f"WITH {_BEST} SELECT * FROM words")
def best_score(spark, sf_dir):
    return _best(spark, sf_dir).select("country", "source", "word", "trend_score", "category")


@operator("q08_cn_score_dedup", ("suggestions",), """SELECT word, max(s) AS heat, max(CASE WHEN category IS NOT NULL AND n = 1 THEN category END) AS category FROM
(SELECT *, row_number() OVER (PARTITION BY word ORDER BY CASE WHEN category IS NULL THEN 1 ELSE 0 END, s DESC, rank, category) AS n FROM (SELECT word, category, rank, greatest(CAST(0.1 AS DOUBLE), 1 - CAST(rank AS DOUBLE) / 15) AS s FROM suggestions) x) y GROUP BY word""")
def cn_score(spark, sf_dir):
    return collect.cn_scores(view(spark, sf_dir, "suggestions"))


@operator("q09_top50_per_country", ("suggestions",), f"WITH {_BEST} SELECT country, source, word, trend_score, category, ord FROM tops WHERE ord <= 50")
def top50(spark, sf_dir):
    return collect.top_per_country(_best(spark, sf_dir), 50, "source").select("country", "source", "word", "trend_score", "category", "ord")


@operator("q10_quota_merge", ("suggestions",), f"WITH {_MERGE} SELECT country, word, trend_score, category, source, phase, pick FROM merged WHERE pick <= 20")
def quota_merge(spark, sf_dir):
    return _merged(spark, sf_dir).select("country", "word", "trend_score", "category", "source", "phase", "pick")


@operator("q11_global_cap", ("suggestions",), f"WITH {_MERGE} SELECT country, word, trend_score, pick FROM (SELECT *, list_position(['DE','FR','NL','UK','IT','ES'], country) AS c FROM merged WHERE pick <= 20) ORDER BY c, pick LIMIT 70")
def global_cap(spark, sf_dir):
    return collect.capped(_merged(spark, sf_dir), COUNTRIES, 70).select("country", "word", "trend_score", "pick")


@operator("q12_seed_fallback", ("suggestions",), "WITH fixed AS (SELECT DISTINCT country, seed FROM suggestions), dynamic AS (SELECT DISTINCT country, seed FROM suggestions WHERE source = 'ebay_suggest' AND country <> 'FR') SELECT country, seed, 'dynamic' AS kind FROM dynamic UNION ALL SELECT country, seed, 'fixed' FROM fixed WHERE country NOT IN (SELECT country FROM dynamic)")
def seed_fallback(spark, sf_dir):
    s = view(spark, sf_dir, "suggestions")
    dynamic = s.where("source = 'ebay_suggest' AND country <> 'FR'").select("country", "seed").distinct().withColumn("kind", F.lit("dynamic"))
    return collect.with_fallback(dynamic, s.select("country", "seed").distinct().withColumn("kind", F.lit("fixed")))


@operator("q13_suggestion_hygiene", ("suggestions",), f"WITH {_CLEAN} SELECT doc_id, country, word, rank FROM clean")
def hygiene(spark, sf_dir):
    return collect.hygiene(view(spark, sf_dir, "suggestions")).select("doc_id", "country", "word", "rank")


# ---------------------------------------------------------------- rules

_RULES = [(r, t) for r, ts in STATUTORY_TERMS.items() for t in ts]


def _quoted(x: str) -> str:
    return x.replace("'", "''")


def _re(term: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in term)


_PLACE = "CASE " + " ".join(f"WHEN regexp_matches(word, '(?i)(^|[^\\pL\\pN_]){_quoted(_re(t))}($|[^\\pL\\pN_])') THEN {i}" for i, (_, t) in enumerate(_RULES)) + " END"
_LISTS = ", ".join(f"({i}, '{r}', '{_quoted(t)}')" for i, (r, t) in enumerate(_RULES))
_STATUTORY = f"lists(o, rule, term) AS (VALUES {_LISTS}), placed AS (SELECT *, {_PLACE} AS place FROM terms), statutory AS (SELECT w.id, w.word, w.country, l.rule AS statutory_rule, l.term AS statutory_term FROM placed w LEFT JOIN lists l ON l.o = w.place)"
_FILES = {c: '{"banned": ["' + x + '", {"word": "BLUE", "rule_id": "colour"}, 7, {"word": "green"}], "safe": [{"word": "' + y + '"}, "hot red"]}' for c, x, y in (("DE", "red", "small ring eco-friendly"), ("FR", "hot", "red widget Net Zero set"), ("UK", "spac", "hot gear sustainables"))}
_BANNED = "entries(country, ord, term, rule) AS (VALUES " + ", ".join(f"('{c}', {o}, '{t}', '{r}')" for c, x in (("DE", "red"), ("FR", "hot"), ("UK", "spac")) for o, t, r in ((0, x, "manual_banned"), (1, "BLUE", "colour"), (3, "green", "manual_banned"))) + f"), banned AS (SELECT w.id, arg_min(rule, ord) AS banned_rule FROM terms w JOIN entries e ON e.country = w.country AND contains({fold('w.word')}, {fold('e.term')}) GROUP BY w.id)"
_SAFE = "safe(country, word) AS (VALUES ('DE', 'small ring eco-friendly'), ('DE', 'hot red'), ('FR', 'red widget Net Zero set'), ('FR', 'hot red'), ('UK', 'hot gear sustainables'), ('UK', 'hot red'))"
_VERDICT = f"{_STATUTORY}, {_BANNED}, {_SAFE}, verdicts AS (SELECT s.id, s.word, s.country, CASE WHEN f.word IS NOT NULL THEN true WHEN coalesce(statutory_rule, banned_rule) IS NOT NULL THEN false END AS verdict, CASE WHEN f.word IS NULL THEN coalesce(statutory_rule, banned_rule) END AS rule_id FROM statutory s LEFT JOIN banned b ON b.id = s.id LEFT JOIN safe f ON f.country = s.country AND f.word = s.word)"


def _files(spark) -> DataFrame:
    return spark.createDataFrame(list(_FILES.items()), "country string, json string")


def _verdicts(spark, sf_dir) -> DataFrame:
    files = _files(spark)
    return rules.verdicts(view(spark, sf_dir, "terms"), rules.rule_entries(files, "safe"), rules.rule_entries(files, "banned"))


@operator("q14_safe_semi_join", ("terms",), f"WITH {_SAFE} SELECT id, word, country FROM terms WHERE (country, word) IN (SELECT country, word FROM safe)")
def safe_join(spark, sf_dir):
    return view(spark, sf_dir, "terms").join(rules.rule_entries(_files(spark), "safe"), ["country", "word"], "left_semi").select("id", "word", "country")


@operator("q15_statutory_regex", ("terms",), f"WITH {_STATUTORY} SELECT id, word, statutory_rule, statutory_term FROM statutory")
def statutory(spark, sf_dir):
    return rules.statutory(view(spark, sf_dir, "terms")).select("id", "word", "statutory_rule", "statutory_term")


@operator("q16_banned_substring", ("terms",), f"WITH {_BANNED} SELECT w.id, w.word, w.country, b.banned_rule FROM terms w LEFT JOIN banned b ON b.id = w.id")
def banned(spark, sf_dir):
    return rules.banned(view(spark, sf_dir, "terms"), rules.rule_entries(_files(spark), "banned")).select("id", "word", "country", "banned_rule")


@operator("q17_rule_verdict", ("terms",), f"WITH {_VERDICT} SELECT * FROM verdicts")
def verdict(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("id", "word", "country", "verdict", "rule_id")


_ROUTED = f"""{_VERDICT}, judged AS (SELECT id, word, country, id % 9 <> 0 AS anchored, verdict IS NULL AS asked, coalesce(verdict, false) AS good FROM verdicts),
routed AS (SELECT id, word, country, 'approved' AS action FROM judged WHERE anchored AND (good OR (asked AND id % 4 = 0))
UNION ALL SELECT id, word, country, 'pending_no_anchor' FROM judged WHERE NOT anchored AND (good OR (asked AND id % 4 = 0))
UNION ALL SELECT id, word, country, 'pending' FROM judged WHERE asked AND id % 4 IN (1, 3)
UNION ALL SELECT id, word, country, 'blocked' FROM judged WHERE (NOT asked AND NOT good) OR (asked AND id % 4 = 2))"""


def _said(words: DataFrame) -> DataFrame:
    """A model's answers stand in by id: reusable, doubtful, to be blocked, nonsense; every other reason is blank."""
    said = F.get(F.array(F.lit("可复用"), F.lit("存疑"), F.lit("需拦截"), F.lit("nonsense")), (F.col("id") % 4).cast("int"))
    return words.withColumns({"said_verdict": said, "said_reason": F.when(F.col("id") % 2 == 0, F.concat(F.lit(" said "), "id")).otherwise(" ")})


def _routed(spark, sf_dir) -> DataFrame:
    """Every word's action; each ninth word has no anchor."""
    words = _said(_verdicts(spark, sf_dir)).withColumn("anchor_id", F.when(F.col("id") % 9 != 0, F.col("id")))
    return route.routed(route.assessed(words)).select("id", "word", "country", "action")


@operator("q18_funnel_route", ("terms",), f"WITH {_ROUTED} SELECT * FROM routed")
def funnel(spark, sf_dir):
    return _routed(spark, sf_dir)


@operator("q19_funnel_counters", ("terms",), f"WITH {_ROUTED} SELECT country, count(*) FILTER (WHERE action = 'approved') AS approved, count(*) FILTER (WHERE action LIKE 'pending%') AS pending, count(*) FILTER (WHERE action = 'blocked') AS rejected, count(*) AS total FROM routed GROUP BY country")
def counters(spark, sf_dir):
    a = F.col("action")
    return _routed(spark, sf_dir).groupBy("country").agg(F.count_if(a == "approved").alias("approved"), F.count_if(a.startswith("pending")).alias("pending"), F.count_if(a == "blocked").alias("rejected"), F.count("*").alias("total"))


@operator("q20_running_progress", ("terms",), f"WITH {_ROUTED} SELECT id, country, action, sum(CASE WHEN action = 'approved' THEN 1 ELSE 0 END) OVER w AS approved, count(*) OVER w AS processed FROM routed WINDOW w AS (PARTITION BY country ORDER BY id)")
def progress(spark, sf_dir):
    one = F.when(F.col("action") == "approved", 1).otherwise(0)
    out = points.running(_routed(spark, sf_dir), "country", "id", one, "approved")
    return points.running(out, "country", "id", F.lit(1), "processed").select("id", "country", "action", "approved", "processed")


# ---------------------------------------------------------------- progress and sets


@operator("q21_unseen_anti_join", ("suggestions",), "SELECT a.country, a.word FROM (SELECT country, word FROM suggestions WHERE source = 'amazon_suggest') a LEFT JOIN (SELECT DISTINCT country, word, true AS there FROM suggestions WHERE source = 'ebay_suggest') b ON b.country = a.country AND b.word = a.word WHERE b.there IS NULL")
def unseen(spark, sf_dir):
    """Repeated words stay as often as they come."""
    s = view(spark, sf_dir, "suggestions").select("country", "word", "source")
    a, b = (s.where(F.col("source") == x) for x in ("amazon_suggest", "ebay_suggest"))
    return listing.unseen(a, b, "country", "word").select("country", "word")


@operator("q22_exists_flag", ("tags", "suggestions"), "SELECT s.country, s.word, t.word IS NOT NULL AS known FROM (SELECT DISTINCT country, word FROM suggestions) s LEFT JOIN (SELECT DISTINCT country, split_part(word, ' ', 1) AS word FROM tags) t ON t.country = s.country AND t.word = s.word")
def exists_flag(spark, sf_dir):
    known = view(spark, sf_dir, "tags").select("country", F.split_part("word", F.lit(" "), F.lit(1)).alias("word"))
    return listing.flagged(view(spark, sf_dir, "suggestions").select("country", "word").distinct(), known, "country", "word")


@operator("q23_last_n_keys", (), "SELECT event_id, user_id FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 1000")
def last_keys(spark, sf_dir):
    return listing.latest(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), PROGRESS_KEYS, "ts", "event_id").select("event_id", "user_id")


@operator("q24_recent_anchors", ("anchors",), "SELECT id, cn_word, category FROM anchors ORDER BY created_at DESC, id LIMIT 50")
def recent_anchors(spark, sf_dir):
    return listing.latest(view(spark, sf_dir, "anchors"), RECENT_ANCHORS, "created_at", ties=("id",)).select("id", "cn_word", "category")


@operator("q25_batch_groups", ("tags",), "SELECT id, country, CAST(floor((row_number() OVER (PARTITION BY country ORDER BY id) - 1) / 12) AS BIGINT) AS batch FROM tags")
def batch_groups(spark, sf_dir):
    return points.numbered(view(spark, sf_dir, "tags").select("id", "country"), "country", "id", 12)


@operator("q36_linked_counts", ("anchors", "tags"), "SELECT a.id, a.cn_word, coalesce(c.n, 0) AS linked FROM anchors a LEFT JOIN (SELECT anchor_id, count(*) AS n FROM tags GROUP BY anchor_id) c ON c.anchor_id = a.id")
def linked_counts(spark, sf_dir):
    return listing.linked(view(spark, sf_dir, "anchors").select("id", "cn_word"), view(spark, sf_dir, "tags"))


@operator("q34_filtered_counts", ("tags",), "SELECT country, category, count(*) AS n FROM tags WHERE contains(word, 'th') GROUP BY country, category")
def filtered_counts(spark, sf_dir):
    return listing.counts(view(spark, sf_dir, "tags"), "country", "category", holds="th")


@operator("q35_dashboard", ("anchors", "tags"), "SELECT a.n AS anchors, t.n AS tags, t.p AS pending, t.b AS blocked, t.countries, coalesce(round_even(t.n / nullif(t.n + t.p, 0), 3), 0.0) AS ratio FROM (SELECT count(*) AS n FROM anchors) a CROSS JOIN (SELECT CAST(coalesce(sum(CASE WHEN compliance_status = '可复用' THEN 1 ELSE 0 END), 0) AS DOUBLE) AS n, CAST(coalesce(sum(CASE WHEN compliance_status = '存疑' THEN 1 ELSE 0 END), 0) AS DOUBLE) AS p, CAST(sum(CASE WHEN compliance_status = '需拦截' THEN 1 ELSE 0 END) AS BIGINT) AS b, count(DISTINCT CASE WHEN country <> '' THEN country END) AS countries FROM tags) t")
def dashboard(spark, sf_dir):
    return listing.dashboard(view(spark, sf_dir, "anchors"), view(spark, sf_dir, "tags"))


# ---------------------------------------------------------------- rerank

_RERANK = f"{_ASKED}, c AS (SELECT *, {fold('word')} AS key FROM ranked WHERE ord <= 8), f AS (SELECT *, row_number() OVER (PARTITION BY qid, country, key ORDER BY similarity DESC, id) AS first, row_number() OVER (PARTITION BY qid, country, key ORDER BY similarity, id DESC) AS last FROM c), p AS (SELECT qid, country, key, min(9 - ord) AS pick_ord FROM c WHERE ord IN (3, 5) GROUP BY ALL), o AS (SELECT f.*, p.pick_ord, 0 AS phase, CAST(p.pick_ord AS DOUBLE) AS place FROM f JOIN p USING (qid, country, key) WHERE last = 1 UNION ALL SELECT f.*, NULL, 1, -similarity FROM f LEFT JOIN p USING (qid, country, key) WHERE first = 1 AND p.qid IS NULL), r AS (SELECT qid, country, id, word, similarity, source, row_number() OVER (PARTITION BY qid, country ORDER BY phase, place, id) AS position, phase = 0 AS ai_generated FROM o)"


def _reranked(spark, sf_dir) -> DataFrame:
    """The third and the fifth candidate, in the other order and upper case, stand for a model's picks; one more is no candidate."""
    c = search.recall(view(spark, sf_dir, "tags"), _asked(spark, sf_dir), 8)
    known = F.col("ord") > 1
    picks = c.where("ord IN (1, 3, 5)").select("qid", F.when(known, 9 - F.col("ord")).otherwise(0).alias("pick_ord"), F.when(known, F.upper("word")).otherwise("invented tag").alias("word"), F.when(known, "picked").otherwise("none").alias("reason"))
    return search.rerank(c, picks, 5)


@operator("q26_rerank_backfill", ("anchors", "tags"), f"WITH {_RERANK} SELECT qid, country, id, word, similarity, position, ai_generated FROM r WHERE position <= 5")
def rerank_backfill(spark, sf_dir):
    return _qid(_reranked(spark, sf_dir)).select("qid", "country", "id", "word", "similarity", "position", "ai_generated")


@operator("q27_provenance_join", ("anchors", "tags"), f"WITH {_RERANK} SELECT r.qid, r.country, r.position, r.word, r.source, t.trend_score, a.cn_word FROM r JOIN tags t ON t.id = r.id LEFT JOIN anchors a ON a.id = t.anchor_id WHERE position <= 5")
def provenance(spark, sf_dir):
    tags, anchors = view(spark, sf_dir, "tags").select("id", "anchor_id"), view(spark, sf_dir, "anchors").select(F.col("id").alias("anchor_id"), "cn_word")
    out = _qid(_reranked(spark, sf_dir)).join(tags, "id").join(anchors, "anchor_id", "left")
    return out.select("qid", "country", "position", "word", "source", "trend_score", "cn_word")


@operator("q28_any_flag", ("anchors", "tags"), f"WITH {_RERANK} SELECT qid, country, bool_or(ai_generated) AS ai_assisted, count(*) AS n FROM r WHERE position <= 5 GROUP BY ALL")
def any_flag(spark, sf_dir):
    return _qid(_reranked(spark, sf_dir)).groupBy("qid", "country").agg(F.coalesce(F.bool_or("ai_generated"), F.lit(False)).alias("ai_assisted"), F.count("*").alias("n"))


@operator("q29_candidate_text_block", ("anchors", "tags"), f"WITH {_ASKED} SELECT qid, country, string_agg('- ' || word || coalesce(' (类目: ' || category || ')', '') || ' (热度: ' || CAST(trend_score AS VARCHAR) || ')' || ' (相似度: ' || printf('%.4f', floor(similarity * 10000 + 0.5) / 10000) || ')', chr(10) ORDER BY ord) AS block FROM ranked WHERE ord <= 8 GROUP BY qid, country")
def text_block(spark, sf_dir):
    c = _qid(search.recall(view(spark, sf_dir, "tags"), _asked(spark, sf_dir), 8))
    return recommend.blocks(c, "qid", "country")


# ---------------------------------------------------------------- tables


@operator("q30_upsert_lww", (), "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def upsert_lww(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return store.upsert(e.where("event_type = 'click'"), e.where("event_type <> 'click'"), "user_id", "event_id")


@operator("q31_delete_anti", (), "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def delete_anti(spark, sf_dir):
    return store.delete(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels").where("quality = 0"), "doc_id")


@operator("q32_keyset_page", (), "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 1000 ORDER BY o_orderkey LIMIT 101")
def keyset_page(spark, sf_dir):
    return store.keyset_page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 1000, 100)


@operator("q33_offset_page", (), "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50 OFFSET 100")
def offset_page(spark, sf_dir):
    return store.offset_page(table(spark, sf_dir, "events").select("event_id", "event_type"), [F.desc("event_id")], 100, 50)


@operator("q37_deterministic_id", ("tags",), "SELECT id, word, country, regexp_replace(md5(concat(length(word), ':', word, length(country), ':', country)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS point_id FROM tags".replace("{8}", "@8").replace("{4}", "@4").replace("{12}", "@12"))
def deterministic_id(spark, sf_dir):
    return view(spark, sf_dir, "tags").select("id", "word", "country", point_id(F.col("word"), F.col("country")).alias("point_id"))


ORACLE_SQL["q37_deterministic_id"] = ORACLE_SQL["q37_deterministic_id"].replace("@8", "{8}").replace("@4", "{4}").replace("@12", "{12}")


@operator("q38_sha_hashes", ("traces",), "SELECT conv_id, turn, word_sha256, left(word_sha256, 12) AS log_prefix FROM traces")
def sha_hashes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", text_hash(F.col("text")).alias("word_sha256"))
    return c.withColumn("log_prefix", F.left("word_sha256", F.lit(12)))


_FOLD = "list_reduce(list_prepend('GENESIS', list(concat_ws('|', id, ts, actor, action, rtype, rid) ORDER BY id)), lambda p, x: sha256(p || '|' || x))"


@operator("q39_chain_append", ("audit",), f"SELECT actor, {_FOLD} AS head, count(*) AS n FROM audit GROUP BY actor")
def chain_append(spark, sf_dir):
    c = store.chain_append(view(spark, sf_dir, "audit"), "GENESIS", "actor")
    return c.groupBy("actor").agg(F.max_by("hash", "id").alias("head"), F.count("*").alias("n"))


@operator("q40_chain_verify", ("audit",), "SELECT actor, count(*) AS n, count(*) FILTER (WHERE id % 97 = 0) AS broken FROM audit GROUP BY actor")
def chain_verify(spark, sf_dir):
    """Every 97th row's action is tampered with after the fact; the check finds exactly those."""
    a = view(spark, sf_dir, "audit")
    log = a.join(store.chain_append(a, "GENESIS", "actor"), ["actor", "id"]).withColumn("action", F.when(F.col("id") % 97 == 0, "tampered").otherwise(F.col("action")))
    return store.chain_verify(log, "actor").groupBy("actor").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("broken"))


@operator("q41_audit_list", ("audit",), "SELECT id, ts, actor, action FROM audit WHERE action = 'click' ORDER BY id DESC LIMIT 50")
def audit_list(spark, sf_dir):
    rows = governance.matching(view(spark, sf_dir, "audit"), {"action": "click"})
    return listing.latest(rows, 50, "id").select("id", "ts", "actor", "action")


@operator("q42_retention_purge", (), "WITH now AS (SELECT max(ts) AS t FROM events) SELECT event_type, count(*) AS n, min(event_id) AS first FROM events, now WHERE ts >= t - INTERVAL 10 DAY GROUP BY event_type")
def retention(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = F.broadcast(e.agg(F.max("ts").alias("now")))  # one row
    return store.purge(e.join(now), "ts", F.col("now"), 10).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


_TRACES = "tr AS (SELECT c.conv_id * 1000 + c.turn AS id, c.conv_id AS ts, sha256(coalesce(c.text, '')) AS word_sha256, CASE WHEN b.conv_id IS NOT NULL THEN sha256(coalesce(b.text, '')) END AS prompt_hash FROM conversations c LEFT JOIN conversations b ON b.conv_id = c.conv_id AND b.turn = c.turn - 1)"
_HELD = """SELECT subject, 'tags' AS store, CAST(id AS VARCHAR) AS rid FROM tags, subjects WHERE word = term AND (asked IS NULL OR country = asked) UNION ALL SELECT subject, 'anchors', CAST(id AS VARCHAR) FROM anchors, subjects WHERE cn_word = term
UNION ALL SELECT subject, 'traces', CAST(id AS VARCHAR) FROM (SELECT subject, id, row_number() OVER (PARTITION BY subject ORDER BY ts DESC, id DESC) AS n FROM tr, subjects WHERE word_sha256 = sha256(term) OR prompt_hash = sha256(term)) WHERE n <= 100
UNION ALL SELECT subject, 'audit', CAST(id AS VARCHAR) FROM (SELECT subject, id, row_number() OVER (PARTITION BY subject ORDER BY ts DESC, id DESC) AS n FROM audit, subjects WHERE detail ILIKE concat('%', term, '%') OR action ILIKE concat('%', term, '%')) WHERE n <= 100"""


def traces_of(spark, sf_dir) -> DataFrame:
    """Traces of model calls, one per turn; the prompt is the turn before."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.sha2("text", 256).alias("prompt_hash"))
    return c.join(before, ["conv_id", "turn"], "left").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("ts"), F.sha2("text", 256).alias("word_sha256"), "prompt_hash", "conv_id", "turn")


@operator("q43_dsar_search", ("tags", "anchors", "audit"), f"WITH {_TRACES}, subjects AS (SELECT 'word' AS subject, (SELECT max(word) FROM tags) AS term, NULL AS asked UNION ALL SELECT 'country', (SELECT max(word) FROM tags), 'DE' UNION ALL SELECT 'text', (SELECT min(text) FROM conversations WHERE text <> ''), NULL UNION ALL SELECT 'detail', 'SIGNUP', NULL) {_HELD}")
def dsar_search(spark, sf_dir):
    """Four subjects: a tag's word, the same in one country, the text of a turn, and what the audit log writes in lower case."""
    tags, anchors, audit = (view(spark, sf_dir, x) for x in ("tags", "anchors", "audit"))
    text = table(spark, sf_dir, "conversations").where("text <> ''")
    word, turn = tags.agg(F.max("word")).first()[0], text.agg(F.min("text")).first()[0]  # subjects are parameters of a run
    stores = {"tags": (tags, "word", F.col("id")), "anchors": (anchors, "cn_word", F.col("id"))}
    subjects = [("word", word or "", None), ("country", word or "", "DE"), ("text", turn or "", None), ("detail", "SIGNUP", None)]
    return governance.subjects_data(stores, traces_of(spark, sf_dir), audit, subjects, ("detail", "action"))


_TERMS = "x AS (SELECT max(word) AS term FROM tags UNION ALL SELECT min(text) FROM conversations WHERE text <> '')"


@operator("q44_dsar_erase_counts", ("tags", "anchors"), f"WITH {_TRACES}, {_TERMS} SELECT 'tags' AS store, sum(CASE WHEN word IN (SELECT term FROM x) AND country = 'DE' THEN 1 ELSE 0 END) AS erased, sum(CASE WHEN word IN (SELECT term FROM x) AND country = 'DE' THEN 0 ELSE 1 END) AS kept FROM tags UNION ALL SELECT 'anchors', sum(CASE WHEN cn_word IN (SELECT term FROM x) THEN 1 ELSE 0 END), sum(CASE WHEN cn_word IN (SELECT term FROM x) THEN 0 ELSE 1 END) FROM anchors UNION ALL SELECT 'traces', count(*) FILTER (WHERE named), count(*) FILTER (WHERE named IS NOT TRUE) FROM (SELECT word_sha256 IN (SELECT sha256(term) FROM x) OR prompt_hash IN (SELECT sha256(term) FROM x) AS named FROM tr)")
def erase_counts(spark, sf_dir):
    """One request that names a tag's word and the text of a turn, so that it is about tags, anchors and traces."""
    tags, anchors = view(spark, sf_dir, "tags"), view(spark, sf_dir, "anchors")
    text = table(spark, sf_dir, "conversations").where("text <> ''")
    terms = [tags.agg(F.max("word")).first()[0], text.agg(F.min("text")).first()[0]]  # parameters of a run
    return governance.erasure_counts({"tags": (tags, "word"), "anchors": (anchors, "cn_word")}, [t for t in terms if t is not None], "DE", traces_of(spark, sf_dir))


@operator("q45_redact_json")
def redact_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", store.redact_json(F.to_json(F.struct("event_type", "props")), "click").alias("detail"))


ORACLE_SQL["q45_redact_json"] = """WITH e AS (SELECT event_id, event_type, replace(props, '"', concat(chr(92), '"')) AS p FROM events)
SELECT event_id, concat('{"event_type":"', event_type, '","props":"', p, '"}') AS detail FROM e WHERE NOT contains(concat(event_type, p), 'click')
UNION ALL SELECT event_id, concat('{"event_type": "', replace(event_type, 'click', '<REDACTED>'), '", "props": "', replace(p, 'click', '<REDACTED>'), '"}') FROM e WHERE contains(concat(event_type, p), 'click')"""


@operator("q46_lineage_by_run", (), "SELECT user_id AS run_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM {events}")
def lineage_by_run(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id", "event_type", "ts")
    return governance.lineage_steps(e, "run_id", "ts", "event_id").drop("ts")


@operator("q47_trace_lookup", ("traces",), "SELECT conv_id, turn, word_sha256 FROM traces WHERE word_sha256 IN (SELECT sha256(coalesce(text, '')) FROM conversations WHERE conv_id % 7 = 0)")
def trace_lookup(spark, sf_dir):
    """The texts of every seventh conversation are asked for."""
    asked = table(spark, sf_dir, "conversations").where("conv_id % 7 = 0").select(text_hash(F.col("text")).alias("word_sha256"))
    traces = view(spark, sf_dir, "traces").select("conv_id", "turn", "word_sha256")
    return traces.join(asked.distinct(), "word_sha256", "left_semi").select("conv_id", "turn", "word_sha256")


_REDACTED = "text"
for _p, _m in tx.LOG_PATTERNS:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_p}', '{_m}', 'g')"


@operator("q48_log_redaction")
def log_redaction(spark, sf_dir):
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", tx.redact_log(F.col("text")).alias("line"))


ORACLE_SQL["q48_log_redaction"] = f"SELECT doc_id, {_REDACTED} AS line FROM documents"


@operator("q49_luhn", (), "WITH d AS (SELECT p_partkey, concat('4539', lpad(CAST(p_partkey AS VARCHAR), 12, '7')) AS x FROM part) SELECT p_partkey, x, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(x)[i] AS INT) ELSE (CAST(reverse(x)[i] AS INT) * 2) % 10 + (CAST(reverse(x)[i] AS INT) * 2) // 10 END)) % 10 = 0 AS ok FROM d")
def luhn(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("4539"), F.lpad(F.col("p_partkey").cast("string"), 12, "7")).alias("x"))
    return d.withColumn("ok", tx.luhn_ok(F.col("x")))


@operator("q50_pii_mask")
def pii_mask(spark, sf_dir):
    out = table(spark, sf_dir, "documents").select("doc_id", pseudonymise(F.coalesce("text", F.lit(""))).alias("p"))
    return out.select("doc_id", "p.text", F.size("p.map").alias("n_entities"), F.map_entries("p.map").alias("entities"))


@operator("q51_json_fallback", (), "WITH p AS (SELECT event_id, props, CASE WHEN event_id % 2 = 0 THEN props ELSE left(props, 5) END AS cut FROM events) SELECT event_id, coalesce(json_extract_string(props, '$.k'), '存疑') AS k, coalesce(CASE WHEN json_valid(cut) THEN json_extract_string(cut, '$.k') END, '存疑') AS bad FROM p")
def json_fallback(spark, sf_dir):
    """Every other text is cut off, so that it isn't JSON."""
    cut = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.left("props", F.lit(5)))
    said = {name: tx.json_text(c, "$.k", DOUBTFUL).alias(name) for name, c in (("k", F.col("props")), ("bad", cut))}
    return table(spark, sf_dir, "events").select("event_id", *said.values())


@operator("q52_fence_strip", (), "SELECT item_id, trim(text) AS text FROM benchmark")
def fence_strip(spark, sf_dir):
    raw = F.concat(F.lit("<think>a\nb</think>\n```json\n"), F.trim("text"), F.lit("\n```"))
    return table(spark, sf_dir, "benchmark").select("item_id", tx.strip_fences(raw).alias("text"))


@operator("q53_sanitise", (), "SELECT doc_id, left(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), 500) AS text FROM documents")
def sanitise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.sanitise(F.col("text")).alias("text"))


@operator("q54_rule_json_union", ("terms",), f"WITH {_BANNED} SELECT e.country, e.term AS word, e.rule AS rule_id, count(w.id) AS words FROM entries e LEFT JOIN terms w ON w.country = e.country GROUP BY ALL")
def rule_json(spark, sf_dir):
    e = rules.rule_entries(_files(spark), "banned")
    n = view(spark, sf_dir, "terms").groupBy("country").agg(F.count("*").alias("words"))
    return e.join(n, "country", "left").select("country", "word", F.coalesce("rule_id", F.lit("manual_banned")).alias("rule_id"), F.coalesce("words", F.lit(0)).alias("words"))


@operator("q55_cache_merge", ("suggestions",), "WITH o AS (SELECT country, word, max(rank) AS v FROM suggestions WHERE source = 'amazon_suggest' GROUP BY ALL), n AS (SELECT country, word, max(rank) AS v FROM suggestions WHERE source = 'ebay_suggest' GROUP BY ALL) SELECT country, word, coalesce(n.v, o.v) AS v FROM o FULL JOIN n USING (country, word)")
def cache_merge(spark, sf_dir):
    s = view(spark, sf_dir, "suggestions").groupBy("country", "word", "source").agg(F.max("rank").alias("v"))
    old, new = (s.where(F.col("source") == x).drop("source") for x in ("amazon_suggest", "ebay_suggest"))
    return store.merged_cache(old, new, ["country", "word"], "v")


@operator("q56_positional_lookup", ("tags",), "SELECT country, CAST(floor(id / 72) AS BIGINT) AS batch, concat(coalesce(word, ''), ' ', id, CASE WHEN id % 5 = 0 THEN chr(7) ELSE '' END) AS word, concat(CASE id % 4 WHEN 0 THEN 'p' WHEN 1 THEN 'c' ELSE 'o' END, id) AS translation FROM tags WHERE id % 4 <> 3")
def positional_lookup(spark, sf_dir):
    """Batches of up to 12 words of a country; by id, answers name the masked form, the cleaned one, the word itself, or are blank."""
    at = F.col("id").cast("string")
    word = F.concat(F.coalesce("word", F.lit("")), F.lit(" "), at, F.when(F.col("id") % 5 == 0, F.lit("\x07")).otherwise(""))
    t = view(spark, sf_dir, "tags").select("country", "id", F.floor(F.col("id") / 72).alias("batch"), word.alias("word"), tx.sanitise(word).alias("clean"))
    kind = F.col("id") % 4
    t = t.withColumn("piece", F.when(kind == 0, F.concat(F.lit("<P"), at, F.lit(">"))).otherwise(F.col("clean")))
    key = F.when(kind == 0, F.col("piece")).when(kind == 1, F.col("clean")).otherwise(F.col("word"))
    says = F.when(kind == 3, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.when(kind == 0, "p").when(kind == 1, "c").otherwise("o"), at))
    b = t.groupBy("country", "batch").agg(F.array_sort(F.collect_list(F.struct("id", "word", "clean", "piece", key.alias("key"), says.alias("value")))).alias("b"))
    answers = F.map_from_arrays(F.col("b.key"), F.col("b.value"))
    found = b.select("country", "batch", F.inline(collect.positional_lookup(F.col("b.word"), F.col("b.clean"), F.col("b.piece"), answers)))
    return found.select("country", "batch", "word", "translation")


@operator("q57_review_transition", ("tags",), "SELECT id, word, country, CASE WHEN compliance_status = '存疑' AND id % 2 = 0 THEN 'approved' WHEN compliance_status = '存疑' THEN 'rejected' ELSE 'unchanged' END AS transition, CASE WHEN compliance_status = '存疑' AND id % 2 = 0 THEN '可复用' WHEN compliance_status = '存疑' THEN '需拦截' ELSE compliance_status END AS status FROM tags")
def review_transition(spark, sf_dir):
    t = view(spark, sf_dir, "tags")
    return t.select("id", "word", "country", review.transition(F.col("compliance_status"), F.col("id") % 2 == 0).alias("t")).select("id", "word", "country", "t.*")


@operator("q58_cron_valid", (), "SELECT event_id, event_id % 3 = 1 AS ok FROM events")
def cron_valid(spark, sf_dir):
    minute = (F.col("event_id") % 60).cast("string")
    cron = F.when(F.col("event_id") % 3 == 1, F.concat(minute, F.lit(" 3 * * 1-5"))).when(F.col("event_id") % 3 == 2, F.concat(minute, F.lit(" 3 * *"))).otherwise(F.concat(minute, F.lit(" 3 * * * 2026")))
    return table(spark, sf_dir, "events").select("event_id", tx.cron_ok(cron).alias("ok"))


@operator("q59_role_overlap", (), "SELECT c_custkey, list_has_any([c_mktsegment, concat('nation-', c_nationkey)], ['BUILDING', 'MACHINERY', 'nation-3']) AS allowed FROM customer")
def role_overlap(spark, sf_dir):
    roles = F.array("c_mktsegment", F.concat(F.lit("nation-"), F.col("c_nationkey")))
    return table(spark, sf_dir, "customer").select("c_custkey", validate.allowed(roles, ("BUILDING", "MACHINERY", "nation-3")).alias("allowed"))


@operator("q61_policy_upsert", (), "SELECT user_id, coalesce(max(value) FILTER (WHERE event_type = 'click'), max(value)) AS value FROM events GROUP BY user_id")
def policy_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    base = e.groupBy("user_id").agg(F.max("value").alias("value"))
    new = e.where("event_type = 'click'").groupBy("user_id").agg(F.max("value").alias("value"))
    return store.merged_cache(base, new, ["user_id"], "value")


@operator("q62_lineage_event_shape", ("tags",), "SELECT id, concat('run-', id % 10) AS run_id, country, word FROM tags")
def lineage_shape(spark, sf_dir):
    event = F.to_json(F.struct(F.lit("OUTPUT").alias("eventType"), F.struct(F.concat(F.lit("run-"), F.col("id") % 10).alias("runId")).alias("run"), F.array(F.struct("country", "word")).alias("outputs")))
    e = view(spark, sf_dir, "tags").select("id", event.alias("event"))
    return e.select("id", F.get_json_object("event", "$.run.runId").alias("run_id"), F.get_json_object("event", "$.outputs[0].country").alias("country"), F.get_json_object("event", "$.outputs[0].word").alias("word"))
