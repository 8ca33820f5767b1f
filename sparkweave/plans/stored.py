"""Registered queries on routing, collectors and stored tables, each with SQL of its own as check."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..constants import COUNTRIES, DEFAULT_REASON
from ..functions.vector import norm
from ..operators import collect, points, recommend, route, rules, search
from ..operators.ledger import Ledger
from ..operators.shared import shared_dir, stored
from ..sources import hotwords, providers, suggestions
from ..sources.daily import DailyLog
from ..sources.versioned import VersionedTable
from ..streaming import collector
from .catalogue import _VERDICT, _files, _said, cosine, fold, operator, table
from .records import _both
from .views import view


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_ALIGNED = f"p AS (SELECT t.id, a.id AS anchor_id, a.cn_word, {cosine('t.vector', 'a.vector')} AS s FROM tags t JOIN anchors a ON t.category IS NULL OR t.category = a.category), best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, anchor_id) AS n FROM p)"


@operator("q84_route_sinks", ("anchors", "tags"), f"""WITH terms AS (SELECT id, word, country FROM tags), {_VERDICT}, {_ALIGNED},
j AS (SELECT t.id, t.word, t.country, t.category, v.verdict, v.rule_id, s.statutory_rule, s.statutory_term, b.banned_rule, CASE WHEN best.s >= CASE WHEN t.category IS NULL THEN 0.30 ELSE 0.18 END THEN best.cn_word END AS anchor_word, CASE WHEN best.s >= CASE WHEN t.category IS NULL THEN 0.30 ELSE 0.18 END THEN best.anchor_id END AS anchor_id FROM tags t JOIN verdicts v ON v.id = t.id JOIN statutory s ON s.id = t.id LEFT JOIN banned b ON b.id = t.id LEFT JOIN best ON best.id = t.id AND best.n = 1),
k AS (SELECT *, CASE WHEN verdict THEN '可复用' WHEN NOT verdict THEN '需拦截' WHEN id % 4 = 0 THEN '可复用' WHEN id % 4 = 2 THEN '需拦截' ELSE '存疑' END AS status,
CASE WHEN verdict THEN '通过安全词库' WHEN NOT verdict AND statutory_rule IS NOT NULL THEN concat('命中UCPD禁用词库(', statutory_rule, '): ', statutory_term) WHEN NOT verdict THEN concat('命中', country, '广告法禁用词库(', banned_rule, ')') WHEN id % 2 = 0 THEN concat('said ', id) ELSE '{DEFAULT_REASON}' END AS reason FROM j)
SELECT 'local_tags' AS part, word, country, category, reason, anchor_word, NULL AS rule_id FROM k WHERE status = '可复用' AND anchor_id IS NOT NULL
UNION ALL SELECT 'pending_review', word, country, category, CASE WHEN status = '可复用' THEN concat(reason, ' [未找到对应中文锚点]') ELSE reason END, NULL, NULL FROM k WHERE status = '存疑' OR (status = '可复用' AND anchor_id IS NULL)
UNION ALL SELECT 'blocked_decisions', word, country, category, reason, anchor_word, rule_id FROM k WHERE status = '需拦截'
UNION ALL SELECT 'lineage', NULL, NULL, NULL, NULL, NULL, NULL FROM k""")
def route_sinks(spark, sf_dir):
    """Tags, aligned to anchors and assessed by rules and a model, go to their three stores, and each leaves an event."""
    tags = view(spark, sf_dir, "tags").select("id", "word", "country", "category", "source", "trend_score", "vector")
    words, files = search.align(tags, view(spark, sf_dir, "anchors"), 0.18, 0.30), _files(spark)
    words = rules.verdicts(words, rules.rule_entries(files, "safe"), rules.rule_entries(files, "banned"))
    out = route.sinks(route.routed(route.assessed(_said(words))))
    out["local_tags"] = out["local_tags"].withColumnRenamed("anchor_cn_word", "anchor_word")
    out["pending_review"] = out["pending_review"].withColumnRenamed("assessment_reason", "reason")
    out["blocked_decisions"] = out["blocked_decisions"].withColumnRenamed("cn_word", "anchor_word")
    return _both(out, "word", "country", "category", "reason", "anchor_word", "rule_id")


_RUNS = f"""clean AS (SELECT *, doc_id % 2 AS run FROM suggestions WHERE length(word) >= 2 AND {fold('word')} <> {fold('seed')} AND NOT regexp_matches(word, '^[0-9]+$')),
least AS (SELECT run, country, source, word, min(rank) AS rank FROM clean GROUP BY ALL), scored AS (SELECT *, round(greatest(0.1, 1 - rank / 15.0), 4) AS score FROM least),
tops AS (SELECT *, row_number() OVER (PARTITION BY run, country, source ORDER BY score DESC, word) AS ord FROM scored QUALIFY ord <= 50),
staged AS (SELECT *, CASE WHEN source = 'ebay_suggest' THEN 1 WHEN ord <= 15 THEN 0 ELSE 2 END AS phase FROM tops),
once AS (SELECT *, row_number() OVER (PARTITION BY run, country, {fold('word')} ORDER BY phase, ord) AS k FROM staged QUALIFY k = 1),
picked AS (SELECT run, country, word, score, source, row_number() OVER (PARTITION BY run, country ORDER BY phase, ord) AS pos FROM once QUALIFY pos <= 20)"""
_STATUS = "CASE WHEN length(word) % 4 = 0 THEN CASE WHEN length(word) % 5 = 0 THEN 'pending_no_anchor' ELSE 'approved' END WHEN length(word) % 4 = 2 THEN 'blocked' ELSE 'pending' END"


@operator("q85_collector_runs", ("tags", "suggestions"), f"""WITH {_RUNS}, known AS (SELECT DISTINCT country, split_part(word, ' ', 1) AS word, true AS there FROM tags),
d AS (SELECT p.*, k.there IS NOT NULL OR (p.run = 1 AND (p.country, p.word) IN (SELECT country, word FROM picked WHERE run = 0)) AS duplicate, {_STATUS.replace('word', 'p.word')} AS said FROM picked p LEFT JOIN known k ON k.country = p.country AND k.word = p.word)
SELECT concat('r', run) AS run_id, country, pos, word, score AS trend_score, source, CASE WHEN NOT duplicate THEN said END AS action, duplicate,
CAST(sum(CASE WHEN NOT duplicate AND said = 'approved' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS approved, CAST(sum(CASE WHEN NOT duplicate AND said LIKE 'pending%' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS pending, CAST(sum(CASE WHEN NOT duplicate AND said = 'blocked' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS rejected, CAST(sum(CASE WHEN duplicate THEN 1 ELSE 0 END) OVER w AS BIGINT) AS duplicates, count(*) OVER w AS processed FROM d WINDOW w AS (PARTITION BY run, country ORDER BY pos)""")
def collector_runs(spark, sf_dir):
    """Two collection runs, of the even and of the odd documents, through the stream: each run's words against the store and the runs before."""
    known = view(spark, sf_dir, "tags").select("country", F.split_part("word", F.lit(" "), F.lit(1)).alias("word"))
    said = F.get(F.array(F.lit("可复用"), F.lit("存疑"), F.lit("需拦截"), F.lit("nonsense")), F.length("word") % 4)
    folder, best = _folder(spark, "runs"), collect.hygiene(view(spark, sf_dir, "suggestions")).withColumn("run", F.col("doc_id") % 2)
    tops = stored(collect.top_per_country(collect.best_scores(best, "run", "country", "source"), 50, "run", "source"), "tops")
    for run in (0, 1):
        mine = tops.where(F.col("run") == run)
        merged = collect.quota_merge(mine.where("source = 'amazon_suggest'"), mine.where("source = 'ebay_suggest'"))
        words = merged.withColumns({"verdict": F.lit(None).cast("boolean"), "statutory_rule": F.lit(None).cast("string"), "statutory_term": F.lit(None).cast("string"), "banned_rule": F.lit(None).cast("string"), "said_verdict": said, "said_reason": F.lit(""), "anchor_id": F.when(F.length("word") % 5 != 0, 1)})
        words = route.routed(route.assessed(words)).withColumns({"job": F.lit("overseas"), "run_id": F.lit(f"r{run}"), "at": F.make_timestamp(F.lit(2026), F.lit(1), F.lit(run + 1), F.lit(0), F.lit(0), F.lit(0)), "pos": F.col("pick")})
        collector.submit(collect.capped(words, COUNTRIES), f"{folder}/in")
        query = collector.run_collector(spark, f"{folder}/in", known, f"{folder}/out", f"{folder}/progress")
        query.awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.select("run_id", "country", "pos", "word", "trend_score", "source", "action", "duplicate", "approved", "pending", "rejected", "duplicates", "processed")


_CHAIN = "list_reduce(list_prepend('GENESIS', list(concat_ws('|', id, ts, actor, action, rtype, rid) ORDER BY id)), lambda p, x: sha256(p || '|' || x))"


@operator("q86_ledger_batches", ("audit",), f"SELECT actor AS chain, {_CHAIN} AS head, count(*) AS n, count(DISTINCT id * 3 // (SELECT max(id) + 1 FROM audit)) AS segments, max(id) AS last_id FROM audit GROUP BY actor")
def ledger_batches(spark, sf_dir):
    """The audit log appended in three batches has the heads of one fold; all segments hold."""
    a = view(spark, sf_dir, "audit").drop("at")
    top = (a.agg(F.max("id")).first()[0] or 0) + 1
    ledger = Ledger(spark, _folder(spark, "ledger"), a.schema)
    for i in range(3):
        ledger.append(a.where(F.floor(F.col("id") * 3 / top) == i), "actor")
    good = ledger.verified().where("ok").groupBy("chain").agg(F.sum("n").alias("n"), F.count("*").alias("segments"))
    return ledger.heads().join(good, "chain")


@operator("q87_versioned_merge", (), """WITH m AS (SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id)
SELECT user_id, event_id, event_type, value FROM m WHERE user_id % 7 <> 3 AND value < 90""")
def versioned_merge(spark, sf_dir):
    """Clicks, then all else, are merged by user; every seventh user is deleted by key, and large values by condition."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    t = VersionedTable(spark, _folder(spark, "users"), "user_id", e.schema)
    t.upsert(e.where("event_type = 'click'"), "event_id")
    t.upsert(e.where("event_type <> 'click'"), "event_id")
    t.delete(e.where("user_id % 7 = 3").select("user_id"))
    t.delete_where(F.col("value") >= 90)
    return t.read()


@operator("q88_banned_many", ("tags", "suggestions"), f"""WITH e AS (SELECT DISTINCT country, split_part(word, ' ', 1) AS term FROM tags WHERE length(split_part(word, ' ', 1)) > 2), o AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY term) - 1 AS ord FROM e),
w AS (SELECT DISTINCT country, word FROM suggestions), h AS (SELECT w.country, w.word, o.term, o.ord FROM w JOIN o ON o.country = w.country AND contains({fold('w.word')}, {fold('o.term')}))
SELECT w.country, w.word, b.rule AS banned_rule FROM w LEFT JOIN (SELECT country, word, arg_min(concat('rule-', term), ord) AS rule FROM h GROUP BY ALL) b ON b.country = w.country AND b.word = w.word""")
def banned_many(spark, sf_dir):
    """The first words of tags, in their order, are what a country bans; all suggested words are searched."""
    first = F.split_part("word", F.lit(" "), F.lit(1))
    e = view(spark, sf_dir, "tags").select("country", first.alias("word")).where(F.length("word") > 2).distinct()
    lists = e.groupBy("country").agg(F.sort_array(F.collect_list("word")).alias("words")).select("country", F.posexplode("words").alias("ord", "word"))  # an editor's list
    entries = lists.withColumn("rule_id", F.concat(F.lit("rule-"), "word"))
    words = view(spark, sf_dir, "suggestions").select("country", "word").distinct()
    return rules.banned(words, entries).select("country", "word", "banned_rule")


@operator("q89_daily_retention", (), """WITH c AS (SELECT date_trunc('second', max(ts)) - INTERVAL 10 DAY AS cut FROM events)
SELECT event_type, count(*) FILTER (WHERE ts >= cut) AS kept, min(CASE WHEN ts >= cut THEN event_id END) AS first, (SELECT count(*) FROM events, c WHERE ts < cut) AS removed FROM events, c GROUP BY event_type HAVING count(*) FILTER (WHERE ts >= cut) > 0""")
def daily_retention(spark, sf_dir):
    """Events are logged by day in two batches; what is older than ten days before the last second goes."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    log = DailyLog(spark, _folder(spark, "log"), e.schema)
    for half in (0, 1):
        log.append(e.where(F.col("event_id") % 2 == half))
    cut = e.agg(F.date_format(F.date_trunc("second", F.max("ts")) - F.make_dt_interval(F.lit(10)), "yyyy-MM-dd HH:mm:ss").alias("c")).first()["c"]
    removed = log.purge(cut)
    return log.read().groupBy("event_type").agg(F.count("*").alias("kept"), F.min("event_id").alias("first")).withColumn("removed", F.lit(removed).cast("long"))


@operator("q90_hot_words", ("suggestions",), """WITH w AS (SELECT country, word, min(rank) AS rank FROM suggestions WHERE source = 'amazon_suggest' AND country <> 'FR' GROUP BY ALL), s AS (SELECT country, word AS query, round(greatest(0.1, 1 - rank / 15.0), 4) AS trend_score FROM w),
n AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY trend_score DESC, query) - 1 AS ord FROM s) SELECT country, ord, query, trend_score FROM n WHERE ord < 10""")
def hot_word_cache(spark, sf_dir):
    """The cache is filled, a minute later only the country without words is due, and ten words of each are read."""
    s = view(spark, sf_dir, "suggestions").where("source = 'amazon_suggest'")

    def fetch(countries):
        mine = s.where("country <> 'FR'").join(F.broadcast(countries), "country", "left_semi")  # six countries at most
        best = mine.groupBy("country", "word").agg(F.min("rank").alias("rank")).withColumn("trend_score", collect.position_score(F.col("rank")))
        return collect.top_per_country(best, 50).select("country", F.col("word").alias("query"), "trend_score", F.lit(None).cast("string").alias("category"))

    cache = VersionedTable(spark, _folder(spark, "hot"), "country", hotwords.CACHE, 1)
    at = lambda minute: F.make_timestamp(F.lit(2026), F.lit(1), F.lit(1), F.lit(0), F.lit(minute), F.lit(0))
    hotwords.refreshed(cache, fetch, at(0))
    hotwords.refreshed(cache, fetch, at(2))
    asked = spark.createDataFrame([(f" {c.lower()}",) for c in COUNTRIES] + [("US",)], "country string")
    return hotwords.hot_words(cache.read(), asked).select("country", "ord", "query", "trend_score")


@operator("q91_cn_anchors", ("suggestions",), """WITH b AS (SELECT word, min(rank) AS rank FROM suggestions GROUP BY word), c AS (SELECT word, min(struct_pack(r := rank, c := category)).c AS category FROM suggestions WHERE category IS NOT NULL GROUP BY word),
h AS (SELECT b.word, greatest(0.1, 1 - rank / 15.0) AS heat, c.category FROM b LEFT JOIN c ON c.word = b.word ORDER BY heat DESC, b.word LIMIT 200)
SELECT word AS cn_word, category, regexp_replace(md5(concat(length(word), ':', word)), '^(........)(....)(....)(....)(............)$', '\\1-\\2-\\3-\\4-\\5') AS point_id, CAST(1 AS DOUBLE) AS norm, CAST(64 AS INTEGER) AS dim, (SELECT count(*) FROM h WHERE trim(word) <> '') AS events FROM h WHERE trim(word) <> ''""")
def cn_anchors(spark, sf_dir):
    """The 200 hottest words become anchors with their vectors, each embedded once and kept by content."""
    words = points.hottest(collect.cn_scores(view(spark, sf_dir, "suggestions")))
    kept = providers.vector_table(spark, _folder(spark, "vectors"), 4)
    model = providers.Model("offline-64", providers.Offline, 64)
    out = route.anchored(stored(words, "hot"), lambda df: providers.embed_through(df, model, kept, "word"))
    told = out["lineage"].agg(F.count("*").alias("events"))
    a = out["cn_anchors"].select("cn_word", "category", "point_id", F.round(norm(F.col("vector")), 5).alias("norm"), F.size("vector").alias("dim"))
    return a.crossJoin(F.broadcast(told))  # one row


@operator("q92_payloads", ("suggestions",), f"""WITH clean AS (SELECT doc_id, country, seed, word, rank FROM suggestions WHERE rank < 10 AND length(word) >= 2 AND {fold('word')} <> {fold('seed')} AND NOT regexp_matches(word, '^[0-9]+$'))
SELECT doc_id, 'object' AS shape, 2 * rank AS rank, word FROM clean UNION ALL SELECT doc_id, 'pair', 2 * rank, word FROM clean UNION ALL SELECT doc_id, 'rows', 2 * rank, word FROM suggestions WHERE rank < 10 AND length(word) > 0 AND word <> seed""")
def payloads(spark, sf_dir):
    """Each text's first ten words as payloads of three shapes, with a number or a flag after each word; every item stands on its own."""
    s = view(spark, sf_dir, "suggestions").where("rank < 10").groupBy("doc_id", "country", "seed").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("w"))
    quoted = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    joined = lambda f, odd: F.array_join(F.transform("w", lambda x: f(quoted(x["word"]))), f", {odd}, ")
    shapes = {
        "object": (suggestions.parse_object, F.concat(F.lit('{"suggestions": ['), joined(lambda q: F.concat(F.lit('{"value": '), q, F.lit("}")), "12.5"), F.lit("]}"))),
        "pair": (suggestions.parse_pair, F.concat(F.lit('["x", ['), joined(lambda q: q, "true"), F.lit("]]"))),
        "rows": (suggestions.parse_rows, F.concat(F.lit('{"result": ['), joined(lambda q: F.concat(F.lit("["), q, F.lit(', "1"]')), '{"a": 1}'), F.lit("]}"))),
    }
    out = None
    for shape, (parse, body) in shapes.items():
        bodies = s.select("country", "seed", F.col("doc_id").cast("string").alias("category"), body.alias("body"))
        rows = parse(bodies).select(F.col("category").cast("long").alias("doc_id"), F.lit(shape).alias("shape"), F.col("rank").cast("long").alias("rank"), "word")
        out = rows if out is None else out.unionByName(rows)
    return out


_PICKED = f"""r AS (SELECT e.vec_id AS qid, e.embedding AS q, CASE e.vec_id % 7 WHEN 0 THEN 'DE' WHEN 1 THEN 'FR' WHEN 2 THEN 'NL' WHEN 3 THEN 'UK' WHEN 4 THEN 'IT' WHEN 5 THEN 'ES' END AS country, CASE WHEN e.vec_id % 2 = 0 THEN concat('c', e.label) END AS want, e.vec_id % 13 AS top_k FROM embeddings e),
good AS (SELECT * FROM r WHERE country IS NOT NULL AND top_k BETWEEN 1 AND 10),
found AS (SELECT qid, want, top_k, t.id, t.word, t.category, t.source, t.anchor_id, {cosine('t.vector', 'good.q')} AS similarity FROM good JOIN tags t ON t.country = good.country WHERE t.compliance_status = '可复用'),
recalled AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS ord FROM found QUALIFY ord <= 16),
kept AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ord) AS n FROM recalled WHERE want IS NULL OR category IS NULL OR category = want),
c AS (SELECT *, {fold('word')} AS key, row_number() OVER (PARTITION BY qid, {fold('word')} ORDER BY ord) AS first, row_number() OVER (PARTITION BY qid, {fold('word')} ORDER BY ord DESC) AS last FROM kept WHERE n <= 8),
p AS (SELECT qid, key FROM c WHERE n = 3 AND qid % 5 > 0),
o AS (SELECT c.*, p.key IS NOT NULL AS picked FROM c LEFT JOIN p ON p.qid = c.qid AND p.key = c.key WHERE CASE WHEN p.key IS NULL THEN first = 1 ELSE last = 1 END),
items AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN picked THEN 0 ELSE 1 END, similarity DESC, id) AS position FROM o QUALIFY position <= top_k)"""


@operator("q93_recommendations", ("tags",), f"""WITH {_PICKED}
SELECT 'item' AS part, qid, position, id, word, source, CASE WHEN picked THEN CASE WHEN qid % 5 = 1 THEN '基于 LLM 精排推荐' ELSE 'third' END ELSE '基于向量相似度补充推荐' END AS reason, picked AS ai, NULL AS total, NULL AS filtered FROM items
UNION ALL SELECT 'answer', qid, NULL, NULL, NULL, NULL, NULL, coalesce((SELECT bool_or(picked) FROM items i WHERE i.qid = good.qid), false), (SELECT count(*) FROM recalled x WHERE x.qid = good.qid), (SELECT count(*) FROM kept x WHERE x.qid = good.qid) FROM good
UNION ALL SELECT 'refused', qid, NULL, NULL, NULL, NULL, concat_ws(',', CASE WHEN country IS NULL THEN 'target_country' END, CASE WHEN top_k NOT BETWEEN 1 AND 10 THEN 'top_k' END), NULL, NULL, NULL FROM r WHERE country IS NULL OR top_k NOT BETWEEN 1 AND 10""")
def recommendations(spark, sf_dir):
    """Each vector's document asks; the model names the third candidate, gives no reason to some and no answer to others."""
    e, i = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    country = F.get(F.array(*(F.lit(c) for c in (*COUNTRIES, "US"))), (i % 7).cast("int"))
    category = F.when(i % 2 == 0, F.concat(F.lit("c"), F.col("label").cast("string")))
    asked = e.select(i.alias("qid"), F.concat(F.lit("title "), i).alias("title"), country.alias("target_country"), category.alias("category"), (i % 13).cast("int").alias("top_k"))
    texts = e.select(F.concat_ws(" ", F.concat(F.lit("title "), i), category).alias("query"), F.col("embedding").alias("vector"))

    def ask(prompts):
        words = F.regexp_extract_all("prompt", F.lit(r"(?m)^- (.*?)(?: \(类目: [^()]*\))?(?: \(热度: [0-9.]+\))? \(相似度: -?[0-9.]+\)$"), F.lit(1))
        reason = F.when(F.col("qid") % 5 == 1, " ").otherwise(" third ")
        pick = F.struct(F.upper(F.get(words, F.lit(2))).alias("word"), reason.alias("reason"))
        answer = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(pick).alias("recommendations"))), F.lit("\n```"))
        return prompts.select("qid", F.when(F.col("qid") % 5 > 0, answer).alias("answer"))

    tags = view(spark, sf_dir, "tags").drop("ts").withColumns({"reason": F.lit("checked"), "anchor_cn_word": F.lit("x")})
    out = recommend.recommendations(asked, tags, lambda q: q.join(texts, "query"), ask)
    none = lambda kind: F.lit(None).cast(kind)
    items = out["items"].select(F.lit("item").alias("part"), "qid", "position", "id", "word", "source", "reason", F.col("ai_generated").alias("ai"), none("long").alias("total"), none("long").alias("filtered"))
    answers = out["answers"].select(F.lit("answer"), "qid", none("long"), none("long"), none("string"), none("string"), none("string"), "ai_assisted", "total_candidates", "filtered_candidates")
    refused = out["refused"].select(F.lit("refused"), "qid", none("long"), none("long"), none("string"), none("string"), F.array_join("problems", ","), none("boolean"), none("long"), none("long"))
    return items.union(answers).union(refused)
