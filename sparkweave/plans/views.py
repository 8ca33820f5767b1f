"""Domain views over the given tables, one definition for Spark and for the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.shared import dealt

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_WORDS = {"spark": r"split(trim(text), '\\s+')", "duck": r"regexp_split_to_array(trim(text), '\s+')"}
_TWO = {"spark": r"d.word", "duck": r"array_to_string(regexp_split_to_array(trim(d.text), '\s+')[1:2], ' ')"}
_POSITIONS = {
    "spark": "SELECT doc_id, lang, seed, CAST(p AS BIGINT) AS rank, word FROM (SELECT doc_id, lang, {words} AS w, regexp_extract(trim(text), '^(\\\\S*)', 1) AS seed FROM {t} WHERE text IS NOT NULL) LATERAL VIEW posexplode(w) x AS p, word",
    "duck": "SELECT doc_id, lang, seed, CAST(i - 1 AS BIGINT) AS rank, word FROM (SELECT doc_id, lang, w[1] AS seed, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, lang, {words} AS w FROM {t} WHERE text IS NOT NULL))",
}
_COUNTRY = "CASE {x} % 6 WHEN 0 THEN 'DE' WHEN 1 THEN 'FR' WHEN 2 THEN 'NL' WHEN 3 THEN 'UK' WHEN 4 THEN 'IT' ELSE 'ES' END"
#: What each view stands on, in order.
NEEDS = {"anchors": ("base",), "tags": ("base",), "suggestions": (), "terms": (), "audit": (), "traces": (), "base": ()}


def _view(name: str, kind: str, table) -> str:
    if name == "base":
        docs = table("documents")
        if kind == "spark":  # words before the join, so that it moves no whole texts
            docs = rf"(SELECT doc_id, concat_ws(' ', slice(split(trim(text), '\\s+'), 1, 2)) AS word FROM {docs})"
        return f"SELECT e.vec_id, e.embedding, e.label, {_TWO[kind]} AS word, ev.ts FROM {table('embeddings')} e JOIN {docs} d ON d.doc_id = e.vec_id JOIN {table('events')} ev ON ev.event_id = e.vec_id"
    if name == "anchors":
        return "SELECT vec_id AS id, word AS cn_word, CASE WHEN vec_id % 10 = 0 THEN NULL ELSE concat('c', CAST(label AS VARCHAR(9))) END AS category, embedding AS vector, ts AS created_at FROM base WHERE vec_id % 5 = 0"
    if name == "tags":
        return f"SELECT vec_id AS id, word, {_COUNTRY.format(x='vec_id')} AS country, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE concat('c', CAST(label AS VARCHAR(9))) END AS category, CASE vec_id % 7 WHEN 0 THEN '存疑' WHEN 1 THEN '需拦截' ELSE '可复用' END AS compliance_status, CAST(10 - vec_id % 10 AS DOUBLE) / 8 AS trend_score, CASE WHEN vec_id % 2 = 0 THEN 'amazon_suggest' ELSE 'ebay_suggest' END AS source, vec_id - vec_id % 5 AS anchor_id, embedding AS vector, ts FROM base WHERE vec_id % 5 <> 0"
    if name == "suggestions":
        rows = _POSITIONS[kind].format(words=_WORDS[kind], t=table("documents"))
        country = "CASE WHEN lang = 'en' THEN 'UK' WHEN doc_id % 4 = 3 THEN CASE WHEN doc_id % 8 = 3 THEN 'IT' ELSE 'NL' END ELSE upper(lang) END"
        return f"SELECT doc_id, {country} AS country, seed, word, rank, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('g', CAST(doc_id % 4 AS VARCHAR(9))) END AS category, CASE WHEN doc_id % 2 = 0 THEN 'amazon_suggest' ELSE 'ebay_suggest' END AS source FROM ({rows}) x"
    if name == "terms":
        ends = "CASE p_partkey % 5 WHEN 0 THEN ' eco-friendly' WHEN 1 THEN ' Net Zero set' WHEN 2 THEN ' ÉCOLOGIQUE' WHEN 3 THEN ' sustainables' ELSE '' END"
        return f"SELECT p_partkey AS id, concat(p_name, {ends}) AS word, {_COUNTRY.format(x='p_partkey')} AS country FROM {table('part')}"
    if name == "audit":
        return f"SELECT event_id AS id, date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS ts, CAST(user_id AS STRING) AS actor, event_type AS action, 'event' AS rtype, CAST(event_id AS STRING) AS rid, props AS detail, ts AS at FROM {table('events')}" if kind == "spark" else f"SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(user_id AS VARCHAR) AS actor, event_type AS action, 'event' AS rtype, CAST(event_id AS VARCHAR) AS rid, props AS detail, ts AS at FROM {table('events')}"
    sha = "sha2(coalesce(text, ''), 256)" if kind == "spark" else "sha256(coalesce(text, ''))"
    return f"SELECT conv_id, turn, role, {sha} AS word_sha256, text AS response FROM {table('conversations')}"


def _with(names: tuple[str, ...], kind: str, table) -> str:
    order = list(dict.fromkeys(x for n in names for x in (*NEEDS[n], n)))
    return "WITH " + ", ".join(f"{n} AS ({_view(n, kind, table)})" for n in order) if order else ""


def spark_query(spark: SparkSession, sf_dir: str, names: tuple[str, ...], sql: str) -> DataFrame:
    """``sql`` over domain views and, in braces, given tables."""
    head = _with(names, "spark", lambda t: "{" + t + "}")
    text = f"{head}, answer AS ({sql}) SELECT * FROM answer" if head else sql
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    if "suggestions" in names:  # each text gives as many rows as it has words
        used["documents"] = dealt(used["documents"].select("doc_id", "lang", "text"))
    return spark.sql(text, **used)


def duck_query(names: tuple[str, ...], sql: str) -> str:
    head = _with(names, "duck", lambda t: t)
    sql = sql.replace("{", "").replace("}", "")
    return f"{head}, answer AS ({sql}) SELECT * FROM answer" if head else sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark_query(spark, sf_dir, (name,), f"SELECT * FROM {name}")
