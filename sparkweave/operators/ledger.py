"""A stored hash chain: batches are appended to each chain's own head, and segments are verified side by side.

A batch becomes one segment per chain, sealed by the hash before its first row and the hash of its last.
A commit names a batch's folder; of two writers that started from the same heads the second is refused.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import row_hash
from ..sources.commits import Commits, Conflict
from . import store
from .shared import typed

FIELDS = ("id", "ts", "actor", "action", "rtype", "rid")
SEALS = "chain string, segment long, first_prev string, last_hash string, n long, last_id long"


class Ledger:
    """An audit log below ``folder``: rows (chain, segment, id, ts, actor, action, rtype, rid, ..., prev_hash, hash).

    Further columns are kept and not hashed, so they may be redacted. Chains start at ``genesis``.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType | str, genesis: str = "GENESIS"):
        self.spark, self.folder, self.genesis = spark, folder.rstrip("/"), genesis
        self.schema = T.StructType([T.StructField("chain", T.StringType()), T.StructField("segment", T.LongType()), *(f for f in typed(schema) if f.name not in ("chain", "segment")), T.StructField("prev_hash", T.StringType()), T.StructField("hash", T.StringType())])
        self.commits = Commits(spark, f"{self.folder}/versions")

    def _all(self, kind: str, schema) -> DataFrame:
        paths = [f"{self.folder}/{self.commits.read(v)['batch']}/{kind}" for v in self.commits.versions()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def log(self) -> DataFrame:
        return self._all("rows", self.schema)

    def seals(self) -> DataFrame:
        """(chain, segment, first_prev, last_hash, n, last_id): a row per chain and batch."""
        return self._all("seals", SEALS)

    def heads(self) -> DataFrame:
        """(chain, head, last_id): where each chain goes on."""
        last = F.max_by(F.struct("last_hash", "last_id"), "segment").alias("s")
        return self.seals().groupBy("chain").agg(last).select("chain", F.col("s.last_hash").alias("head"), F.col("s.last_id").alias("last_id"))

    def append(self, events: DataFrame, chain: str | None = None, expected: int | None = None) -> int:
        """Appends a batch and gives the version after; a Conflict if another batch came meanwhile, which the caller reads before trying again.

        ``chain`` names the column of independent chains (null is a chain of its own); without one all rows are one chain.
        ``expected`` is the version that the caller saw. Ids must be new and greater than those of the chain's
        head: an older one would have to be hashed before rows that are sealed, so it fails the job.
        A chain's fold is sequential, so a batch's rows of one chain are one task that streams them.
        """
        at = self.commits.latest() if expected is None else expected
        if at != self.commits.latest():
            raise Conflict(f"{self.folder} is at version {self.commits.latest()}, not {at}")
        batch = f"b{at + 1}-{uuid.uuid4().hex}"
        name = F.lit("") if chain is None else F.coalesce(F.col(chain).cast("string"), F.lit("\x00"))
        rows = events.withColumn("chain", name)
        heads = self.heads()
        late = rows.join(heads, "chain").where(F.col("id") <= F.col("last_id")).select("id").take(1)
        if late:
            raise ValueError(f"{self.folder}: id {late[0]['id']} is not after its chain's head")
        hashes = store.chain_append(rows.select("chain", *FIELDS), self.genesis, "chain", heads.select("chain", "head"))
        whole = rows.join(hashes, ["chain", "id"]).withColumn("segment", F.lit(at + 1).cast("long"))
        path = f"{self.folder}/{batch}"
        try:
            whole.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema)).write.parquet(f"{path}/rows")
            made = self.spark.read.schema(self.schema).parquet(f"{path}/rows")
            seal = made.groupBy("chain", "segment").agg(F.min_by("prev_hash", "id").alias("first_prev"), F.max_by("hash", "id").alias("last_hash"), F.count("*").alias("n"), F.max("id").alias("last_id"))
            seal.write.parquet(f"{path}/seals")
            self.commits.commit(at + 1, {"batch": batch})
        except Exception:
            self.commits.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
            raise
        return at + 1

    def verified(self) -> DataFrame:
        """(chain, segment, n, broken, ok): every segment checked on its own, and against the seal before it.

        broken counts rows whose hash or link is wrong. A segment is whole if none is, it has as many
        rows as its seal says, begins where the segment before ended (the first at the genesis) and ends
        as sealed. Segments are checked side by side, whatever a chain's length.
        """
        own = row_hash(F.col("prev_hash"), *(F.col(c) for c in FIELDS))
        before = F.lag("hash").over(Window.partitionBy("chain", "segment").orderBy("id"))
        rows = self.log().withColumn("good", (own == F.col("hash")) & F.coalesce(before == F.col("prev_hash"), before.isNull()))
        per = rows.groupBy("chain", "segment").agg(F.count("*").alias("rows"), F.count_if(~F.coalesce("good", F.lit(False))).alias("broken"), F.min_by("prev_hash", "id").alias("starts"), F.max_by("hash", "id").alias("ends"))
        seals = self.seals().withColumn("link", F.coalesce(F.lag("last_hash").over(Window.partitionBy("chain").orderBy("segment")), F.lit(self.genesis)))  # a row per batch
        both = seals.join(per, ["chain", "segment"], "left")
        whole = (F.col("rows") == F.col("n")) & (F.col("starts") == F.col("link")) & (F.col("first_prev") == F.col("link")) & (F.col("ends") == F.col("last_hash")) & (F.col("broken") == 0)
        return both.select("chain", "segment", "n", F.coalesce("broken", F.lit(0)).cast("long").alias("broken"), F.coalesce(whole, F.lit(False)).alias("ok"))
