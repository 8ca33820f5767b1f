"""URL filters: rules for hosts and paths, and path-template trees for what no rule decides.

Rules are a host and a path; one fits a url of its host or a subdomain whose path starts with the
rule's path, and the longest that fits decides.

For the rest, each host has a tree of path templates. Segments that vary (numbers, hex strings, long
tokens with digits) are wildcards at once. Then, from the root down, a segment keeps a branch of
its own only if it has enough labels and its labelled purity (share of good labels) differs from
its parent's by more than chance; all other branches merge into the wildcard, down to the last
segment of the deepest path. A
template is rejected if its purity, smoothed towards all labelled urls' with ``WEIGHT`` pseudo-labels,
is under ``LEAST``. Trees are aggregates of distinct templates, counted before any shuffle, so a
host with a third of all urls is no larger than its templates.

Null urls and urls without "://" have an empty host and path, fit no rule, and share the template of
the empty host. Labels that are null or of unknown pages count as none; a page labelled more
than once counts as bad if any label says so. Equal rows get equal verdicts.
"""

from __future__ import annotations

import functools
import itertools
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hot_join, stored

#: (verdict, host, path) of the rules that the query applies.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A branch of its own needs so many labels.
LABELS = 5
WEIGHT, LEAST = 10.0, 0.5
#: Segments of all templates below a node that one task grows to its leaves.
SMALL = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VARIABLE = r"^(\d+|[0-9a-fA-F-]{8,}|(?=.*\d)\S{12,}|\d+\.\w+|(?=.*\d)[\w-]+\.\w{2,5})$"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(rules) -> tuple[Column, Column]:
    """(rule as text, its verdict) of the longest rule that fits columns host and path; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """The segments of a path, variable ones as wildcards."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(x.rlike(VARIABLE), "*").otherwise(x))


def _apart(cl, cg, pl, pg) -> bool:
    """Whether a branch with ``cl`` labels, ``cg`` of them good, differs from its node's by more than chance."""
    mean, own = pg / max(pl, 1), cg / max(cl, 1)
    return cl >= LABELS and abs(own - mean) > 2 * math.sqrt(max(mean * (1 - mean), 1e-4) / max(cl, 1))


def _grown(table: pa.Table) -> pa.Table:
    """The whole tree below one node: rows (node, segs, at, l, g) with the node of their leaf."""
    segs, labels, goods = (table[c].to_pylist() for c in ("segs", "l", "g"))
    names, todo = list(table["node"].to_pylist()), [(table["at"][0].as_py(), list(range(len(segs))))] if len(segs) else []
    while todo:
        at, members = todo.pop()
        pl, pg = sum(labels[i] for i in members), sum(goods[i] for i in members)
        if pl < LABELS or pg in (0, pl):  # no branch can stand apart any more
            for i in members:
                names[i] += "/*" * (len(segs[i]) - at)
            continue
        branches: dict[str, list[int]] = {}
        for i in members:
            if at < len(segs[i]):
                branches.setdefault(segs[i][at], []).append(i)
        below: dict[str, list[int]] = {}
        for seg, part in branches.items():
            own = _apart(sum(labels[i] for i in part), sum(goods[i] for i in part), pl, pg)
            below.setdefault(seg if own else "*", []).extend(part)
        for name, part in below.items():
            for i in part:
                names[i] += "/" + name
            todo.append((at + 1, part))
    kept = table.drop_columns(["node", "at"])
    return kept.append_column("node", pa.array(names, pa.string()))


def templates(urls: DataFrame) -> DataFrame:
    """``urls``: host, segs, good (1, 0 or null). Returns host, segs, n, template, purity: the merged trees' leaves.

    Nodes whose templates have at most ``SMALL`` segments together are grown to their leaves in one task each, and nodes
    without enough labels, or with labels of one kind, can't branch, so the rest of their segments are wildcards at once. Only
    larger nodes take a step a depth, with counts combined before they are shuffled.
    """
    count = (F.count("*").alias("n"), F.count("good").alias("l"), F.sum("good").alias("g"))
    rows = stored(urls.groupBy("host", "segs").agg(*count).fillna(0, ["g"]), "templates")
    prior, total = rows.agg(F.sum("g") / F.sum("l"), F.count("*")).first()
    prior = 1.0 if prior is None else float(prior)
    open_, done = rows.withColumn("node", F.col("host")), []
    columns = ("host", "segs", "n", "l", "g", "node")
    for depth in itertools.count():
        nodes = open_.groupBy("node").agg(F.sum("l").alias("pl"), F.sum("g").alias("pg"), F.count("*").alias("rows"), F.sum(F.size("segs") + 1).alias("weight"))
        nodes = stored(nodes, "nodes")
        closed = (F.col("pl") < LABELS) | F.col("pg").isin(0) | (F.col("pg") == F.col("pl"))
        kind = F.when(closed, 0).when(F.col("weight") <= SMALL, 1).otherwise(2).alias("kind")
        kinds = {r["kind"] for r in nodes.select(kind).distinct().collect()}
        dealt = stored(hot_join(open_, nodes.select("node", "pl", "pg", "rows", kind), ["node"], "rows", total), "dealt") if kinds else open_
        if 0 in kinds:
            done.append(dealt.where("kind = 0").withColumn("node", F.concat("node", F.repeat(F.lit("/*"), F.greatest(F.size("segs") - depth, F.lit(0))))).select(*columns))
        if 1 in kinds:
            schema = T.StructType([*(dealt.schema[c] for c in columns[:-1]), T.StructField("node", T.StringType())])
            small = dealt.where("kind = 1").select(*columns[:-1], F.lit(depth).alias("at"), "node")
            done.append(stored(small.groupBy("node").applyInArrow(_grown, schema), "grown"))
        if 2 not in kinds:
            break
        large = dealt.where("kind = 2")
        done.append(large.where(F.size("segs") <= depth).select(*columns))
        large = large.where(F.size("segs") > depth).withColumn("seg", F.get("segs", F.lit(depth)))
        child = large.groupBy("node", "seg").agg(F.sum("l").alias("cl"), F.sum("g").alias("cg"), F.first("pl").alias("pl"), F.first("pg").alias("pg"))
        mean, own = F.col("pg") / F.greatest("pl", F.lit(1)), F.col("cg") / F.greatest("cl", F.lit(1))
        chance = F.sqrt(F.greatest(mean * (1 - mean), F.lit(1e-4)) / F.greatest("cl", F.lit(1)))
        apart = stored(child.where((F.col("cl") >= LABELS) & (F.abs(own - mean) > 2 * chance)).select("node", "seg", F.lit(True).alias("own")), "apart")
        few = F.broadcast(apart) if apart.count() <= 100_000 else apart  # branches of their own have LABELS labels each
        open_ = stored(large.join(few, ["node", "seg"], "left").withColumn("node", F.concat_ws("/", "node", F.when(F.col("own"), F.col("seg")).otherwise("*"))).select(*columns), "tree")
    tree = functools.reduce(DataFrame.unionByName, done) if done else open_
    leaf = tree.groupBy("node").agg(((F.sum("g") + WEIGHT * prior) / (F.sum("l") + WEIGHT)).alias("purity"), F.count("*").alias("leaf_rows"))
    return hot_join(tree, leaf, ["node"], "leaf_rows", total).select("host", "segs", "n", F.col("node").alias("template"), "purity")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity). labels: page_id and good (1 or 0)."""
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    own = own.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = own.withColumn("segs", segments(F.col("path")))
    known = labels.select("page_id", "good").dropna().groupBy("page_id").agg(F.min("good").alias("good"))
    tree = templates(own.join(known, "page_id", "left").select("host", "segs", "good"))
    name, says = rule_of(rules)
    tree = stored(tree, "leaves")
    out = hot_join(own, tree, ["host", "segs"], "n", tree.agg(F.sum("n")).first()[0] or 0)
    verdict = F.coalesce(says, F.when(F.col("purity") < LEAST, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"), "template", "purity")


def judged(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """A page is the document of its id; good is of high quality and not toxic."""
    good = F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), ((F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int"))
    return judge(pages, labels.select(F.col("doc_id").alias("page_id"), good.alias("good")))
