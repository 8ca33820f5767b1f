"""Exact dedup against an index of digests that outlives the session.

The index is a table bucketed and sorted by digest. A batch of new data is brought to one row per digest
and meets the index in a sort-merge anti-join: the batch is shuffled to the index's buckets, the
index isn't moved. What is left is appended, bucketed the same way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, shared_dir, stored

#: Of a table's groups of equal texts, at most so many can be larger than rows / HOT.
HOT = 4096


def digested(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, digest): SHA-256 of each text with runs of white space as one blank; ``row`` tells repeated rows apart."""
    plain = F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(plain.cast("binary"), 256)).alias("digest"))


class DigestIndex:
    """A stored index below ``path``: (digest, doc_id, row, batch), one row per digest, with who brought it first.

    Opening it again, in this session or another one, finds what was appended before. ``buckets`` holds
    for a new index; an old one keeps its own. One job at a time may append. A folder is named by its
    buckets and its version; compaction writes the next version, which counts once it is whole.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int | None = None):
        self.spark, self.path, self.id_type = spark, path, id_type
        fs, at = self._store()
        found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        layouts = [tuple(map(int, n.split("-")[1:])) for n in found if n.startswith("by-")]
        whole = [(version, n) for n, version in layouts if not version or fs.exists(self._hadoop(f"{path}/by-{n}-{version}/_SUCCESS"))]
        self._open(*max(whole, default=(0, buckets or partitions(spark))))

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _store(self):
        at = self._hadoop(self.path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), at

    def _open(self, version: int, buckets: int) -> None:
        self.version, self.buckets, self.folder = version, buckets, f"{self.path}/by-{buckets}-{version}"
        self.name = f"digests_{uuid.uuid5(uuid.NAMESPACE_URL, self.folder).hex}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, doc_id {self.id_type}, row BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.folder}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> str:
        """Adds the digests of ``rows`` (doc_id, row, digest) that aren't there yet, each with its least (doc_id, row), null ids last; gives the batch's name.

        Adding a batch again adds nothing, so a job that failed is simply run again.
        """
        batch = uuid.uuid4().hex
        order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
        first = rows.groupBy("digest").agg(F.min(order).alias("f")).select("digest", "f.doc_id", "f.row")
        new = first.hint("merge").join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        new.select("digest", "doc_id", "row", F.lit(batch).alias("batch")).repartition(self.buckets, "digest").write.insertInto(self.name)
        return batch

    def compacted(self) -> None:
        """Each bucket's files, one per batch, become one sorted file; the files before go once the new ones are whole."""
        before, folder = self.name, self.folder
        made = f"{self.path}/by-{self.buckets}-{self.version + 1}"
        self.table().repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").mode("overwrite").option("path", made).saveAsTable(f"{before}_next")
        self.spark.sql(f"DROP TABLE {before}_next")  # the files stay
        self._open(self.version + 1, self.buckets)
        self.spark.sql(f"DROP TABLE {before}")
        self._store()[0].delete(self._hadoop(folder), True)


def _found(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """``rows`` with group_size and with the doc_id, row and batch the index has for their digest.

    Sizes are counted before they are shuffled. A group may hold a third of all rows: of groups larger
    than rows / HOT there are fewer than HOT, so these are sent to all tasks, and only the others'
    rows are shuffled.
    """
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    known = index.table().withColumnsRenamed({"doc_id": "keep_id", "row": "keep_row"})
    groups = stored(sizes.hint("merge").join(known.hint("merge"), "digest"), "groups")
    total = rows.count()
    large = groups.where(F.col("group_size") > total / HOT)
    hot = rows.join(F.broadcast(large), "digest")  # fewer than HOT rows
    rest = rows.join(F.broadcast(large.select("digest")), "digest", "left_anti").join(groups.where(F.col("group_size") <= total / HOT), "digest")
    return hot.unionByName(rest)


def exact_dedup(docs: DataFrame, index: DigestIndex, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): a row per row of ``docs``, after they were added to ``index``.

    Texts are equal if they are once each run of blanks, tabs and line ends is one blank; a null text is
    an empty one. keep_id is the id that the index has for the text: what an earlier batch brought stays, within
    a batch the least doc_id does, null ids last; of rows with one id and one text one stays. group_size
    counts the rows of ``docs``. Different texts of one id are rows of their own, an empty table
    gives an empty one, and other columns are not read.
    """
    rows = stored(digested(docs, doc_id, text), "digests")
    batch = index.append(rows)
    kept = (F.col("batch") == batch) & (F.col("row") == F.col("keep_row"))
    return _found(rows, index).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def dedup_table(docs: DataFrame) -> DataFrame:
    """A whole table against an index of its own: the lower half of the ids comes first, the upper half, and null ids, meet it then."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    index = DigestIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", kind)
    rows = stored(digested(docs), "digests")
    middle = rows.agg(F.percentile_approx("doc_id", F.lit(0.5), F.lit(1000)).alias("m")).first()["m"]
    low = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
    for part in (rows.where(low), rows.where(~low)):
        index.append(part)
    kept = F.col("row") == F.col("keep_row")
    return _found(rows, index).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


DEDUP_SQL = r"""WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, h AS text_sha256 FROM d WINDOW w AS (PARTITION BY h)"""
