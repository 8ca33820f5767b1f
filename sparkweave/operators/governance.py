"""Governance records: policies and purges, subjects' requests, erasure with proof, traces, lineage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEADLINE_DAYS, MAX_DAYS, MIN_DAYS, RETENTION_DAYS, TICKET_STATUS
from ..functions.ids import all_of, any_of
from .store import redact_json


#: Subjects of one search.
SUBJECTS = 1000


def iso(ts: Column) -> Column:
    """ISO 8601 text of a time."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def as_json(table: DataFrame, *columns: str) -> Column:
    """A row as JSON: the named columns, times as ISO 8601 text."""
    times = {f.name for f in table.schema if f.dataType.typeName().startswith("timestamp")}
    return F.to_json(F.struct(*(iso(F.col(c)).alias(c) if c in times else F.col(c) for c in columns)), {"ignoreNullFields": "false"})


def matching(table: DataFrame, equal: Mapping[str, object | None], since: object = None, until: object = None, ts: str = "ts") -> DataFrame:
    """Rows under the conditions that are given; None is no condition."""
    conditions = [F.col(c) == v for c, v in equal.items() if v is not None]
    conditions += [F.col(ts) >= F.lit(since)] if since is not None else []
    conditions += [F.col(ts) < F.lit(until)] if until is not None else []
    return table.where(all_of(conditions))


def by_either_hash(traces: DataFrame, hashes: DataFrame, limit: int | None = None) -> DataFrame:
    """Traces whose word or prompt has one of the hashes, the newest first; each trace once.

    Two joins on a hash each instead of one with OR, which could only compare all with all.
    """
    h = hashes.select(F.col("hash").alias("_h")).distinct()
    word = traces.join(h, F.col("word_sha256") == F.col("_h"), "left_semi")
    prompt = traces.where(F.col("prompt_hash").isNotNull() & ~F.col("prompt_hash").eqNullSafe(F.col("word_sha256")))
    prompt = prompt.join(h, F.col("prompt_hash") == F.col("_h"), "left_semi").join(h, F.col("word_sha256") == F.col("_h"), "left_anti")
    both = word.unionByName(prompt)
    return both if limit is None else both.orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def set_policies(policies: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(policies after, refused changes): changes (key, days, at) of known keys within the bounds, the last of a key counts."""
    ok = F.col("key").isin(*RETENTION_DAYS) & F.coalesce(F.col("days").between(MIN_DAYS, MAX_DAYS), F.lit(False))
    last = changes.where(ok).groupBy("key").agg(F.max_by(F.struct("days", "at"), "at").alias("n")).select("key", "n.days", F.col("n.at").alias("updated_at"))
    rest = policies.join(last, "key", "left_anti")
    return rest.unionByName(last), changes.where(~F.coalesce(ok, F.lit(False)))


def seeded_policies(policies: DataFrame) -> DataFrame:
    """Policies with a row for each key that lacks one."""
    spark = policies.sparkSession
    rows = spark.createDataFrame(list(RETENTION_DAYS.items()), "key string, days int").withColumn("updated_at", F.lit(None).cast("timestamp"))
    return policies.unionByName(rows.join(policies, "key", "left_anti"))


def purged(tables: Mapping[str, DataFrame], policies: DataFrame, now: DataFrame, ts: str = "ts") -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without what their policy lets go, removed rows per key).

    ``now`` is a table of one row (now). A key without a policy, or whose days are null, keeps all and
    isn't counted; a table that lacks the time column stays as it is and counts -1, an empty one 0.
    """
    kept, counts = {}, []
    one = F.broadcast(policies.where(F.col("key").isin(*tables) & F.col("days").isNotNull()).crossJoin(now).select("key", (F.col("now") - F.make_dt_interval(F.col("days"))).alias("cut")))  # a row per key
    for key, table in tables.items():
        cut = one.where(F.col("key") == key)
        if ts not in table.columns:
            kept[key] = table
            counts.append(cut.select("key", F.lit(-1).cast("long").alias("removed")))
            continue
        both = table.join(cut, F.lit(True), "left")
        old = F.coalesce(F.col(ts) < F.col("cut"), F.lit(False))
        kept[key] = both.where(~old).select(*table.columns)
        counts.append(cut.select("key").crossJoin(F.broadcast(both.agg(F.count_if(old).alias("removed")))))  # one row
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return kept, total


def erased(stores: Mapping[str, tuple[DataFrame, str]], traces: DataFrame, audit: DataFrame, term: str, now: Column, details: tuple[str, ...] = ("detail",), country: str | None = None) -> dict[str, DataFrame]:
    """Erasure of a term: the stores without the rows whose word it is, traces without its hashes, the audit log redacted, and one row of proof.

    stores: name -> (table, column of the word). Hard deletion; the audit log's hashes don't cover the
    redacted columns, so its chain stays valid. ``country`` narrows the stores that have one. The audit log is
    redacted value by value, so a term that the JSON text writes with escapes goes as well, and a row counts
    if it changed.
    """
    term_hash = F.sha2(F.lit(term), 256)
    out, counts = {}, []
    spark = traces.sparkSession
    for name, (table, word) in stores.items():
        hit = _is_subject(table, word, term, country)
        out[name] = table.where(~hit)
        counts.append(table.agg(F.count_if(hit).alias("n")).withColumn("what", F.lit("points")))
    named = spark.range(1).select(term_hash.alias("hash"))
    gone = by_either_hash(traces, named)
    out["traces"] = traces.join(gone.select("id"), "id", "left_anti")
    counts.append(gone.agg(F.count("*").alias("n")).withColumn("what", F.lit("traces")))
    # only texts that hold the term, or an escape that might stand for it, are parsed
    may = lambda c: F.contains(F.col(c), F.lit(term)) | F.contains(F.col(c), F.lit("\\"))
    new = {c: F.when(may(c), redact_json(F.col(c), term)).otherwise(F.col(c)) for c in details}
    both = audit.withColumns({f"_new_{c}": x for c, x in new.items()})
    changed = any_of([~F.col(c).eqNullSafe(F.col(f"_new_{c}")) for c in details]) if details else F.lit(False)
    counts.append(both.agg(F.count_if(changed).alias("n")).withColumn("what", F.lit("audit")))
    out["audit"] = both.select(*(F.col(f"_new_{c}").alias(c) if c in details else F.col(c) for c in audit.columns))
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    of = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0)).cast("long")
    out["proof"] = total.agg(of("points").alias("points_deleted"), of("traces").alias("trace_rows_deleted"), of("audit").alias("audit_rows_redacted")).select(term_hash.alias("term_sha256"), "*", iso(now).alias("erased_at"))
    outputs = F.array(F.struct(F.col("term_sha256")))
    out["lineage"] = out["proof"].select(F.lit("dsar_erasure").alias("job_name"), F.lit("ERASE").alias("event_type"), F.to_json(F.struct(outputs.alias("outputs"))).alias("event"))
    return out


def tickets(requests: DataFrame) -> DataFrame:
    """Open tickets from requests (ticket_id, term, contact, note, created_at), due after the legal time."""
    note = F.left("note", F.lit(2000))
    empty = F.lit(None)
    return requests.select("ticket_id", "term", "contact", note.alias("note"), "created_at", (F.col("created_at") + F.make_dt_interval(F.lit(DEADLINE_DAYS))).alias("due_at"), F.lit(TICKET_STATUS[0]).alias("status"), empty.cast("string").alias("findings"), empty.cast("timestamp").alias("completed_at"))


def updated_tickets(open_: DataFrame, updates: DataFrame) -> DataFrame:
    """Tickets after all updates (ticket_id, status, findings, at), as if they came one by one in the order of time.

    The last status counts; a null finding keeps the one before, in this batch or in the ticket; the last
    completion stamps its time, whatever comes after. Unknown states change nothing, nor do updates
    without a time. Of updates at one time the one that is greater by (status, findings) is the later.
    """
    when = F.struct("at", "status", F.coalesce("findings", F.lit("")))
    valid = updates.where(F.col("status").isin(*TICKET_STATUS) & F.col("at").isNotNull())
    last = valid.groupBy("ticket_id").agg(F.max_by("status", when).alias("_s"), F.max_by("findings", F.when(F.col("findings").isNotNull(), when)).alias("_f"), F.max(F.when(F.col("status") == "completed", F.col("at"))).alias("_t"))
    both = open_.join(last, "ticket_id", "left")
    return both.withColumns({"status": F.coalesce("_s", "status"), "findings": F.coalesce("_f", "findings"), "completed_at": F.coalesce("_t", "completed_at")}).select(*open_.columns)


def closed(open_: DataFrame, ticket_id: str, proof: DataFrame) -> DataFrame:
    """Tickets after an erasure: the one it was for is completed, at the time of the proof and with it as its findings. An unknown ticket changes nothing."""
    done = proof.select(F.lit(ticket_id).cast(open_.schema["ticket_id"].dataType).alias("ticket_id"), F.lit("completed").alias("status"), F.to_json(F.struct(*proof.columns)).alias("findings"), F.to_timestamp("erased_at").alias("at"))
    return updated_tickets(open_, done)


def appended(table: DataFrame | None, rows: DataFrame, path: str) -> None:
    """Append rows, with the columns of ``table`` if there is one, to the log below ``path``."""
    (rows if table is None else rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns))).write.mode("append").parquet(path)


def lineage_of(events: DataFrame, run_id: str) -> DataFrame:
    """A run's events in the order of time."""
    return events.where(F.col("run_id") == run_id).orderBy("ts", "id")


def _is_subject(table: DataFrame, column: str, term: str, country: str | None) -> Column:
    hit = F.coalesce(F.col(column) == term, F.lit(False))
    return hit & F.coalesce(F.col("country") == country, F.lit(False)) if country is not None and "country" in table.columns else hit


def _is_traced(term: str) -> Column:
    """Whether a trace's word or prompt is the term, by its hash."""
    named = F.sha2(F.lit(term), 256)
    return F.coalesce(F.col("word_sha256") == named, F.lit(False)) | F.coalesce(F.col("prompt_hash") == named, F.lit(False))


def subjects_data(stores: Mapping[str, tuple[DataFrame, str, Column]], traces: DataFrame, audit: DataFrame, subjects: Sequence[tuple[str, str, str | None]], details: tuple[str, ...] = ("detail",), limit: int = 100) -> DataFrame:
    """(subject, store, rid) of all that is held on each of ``subjects`` (name, term, country or None): one pass over each table, however many they are.

    The stores' rows whose word is the term, exactly, and of the country if the store has one; and each subject's newest
    ``limit`` traces and audit rows. Traces (id, ts, word_sha256, prompt_hash) are found by the term's hash, whether it was the
    word or the prompt; audit rows (id, ts) by ILIKE on their details, so % and _ match as there. The subjects
    are the requests at hand, ``SUBJECTS`` at most.
    """
    if len(subjects) > SUBJECTS:
        raise ValueError(f"{len(subjects)} subjects at once; ask for {SUBJECTS} at most")

    def hits(table: DataFrame, of, *columns: Column) -> DataFrame:
        """A row for each subject that a row is about."""
        named = [F.when(of(term, country), F.lit(name)) for name, term, country in subjects]
        return table.select(F.explode(F.array_compact(F.array(*named))).alias("subject"), *columns) if named else table.limit(0).select(F.lit("").alias("subject"), *columns)

    def newest(found: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("subject").orderBy(F.desc("ts"), F.desc("id"))
        top = found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
        return top.select("subject", F.lit(name).alias("store"), F.col("id").cast("string").alias("rid"))

    out = []
    for name, (table, column, rid) in stores.items():
        out.append(hits(table, lambda t, c: _is_subject(table, column, t, c), F.lit(name).alias("store"), rid.cast("string").alias("rid")))  # noqa: B023
    said = lambda t, c: any_of([F.coalesce(F.col(d).ilike(f"%{t}%"), F.lit(False)) for d in details])
    out.append(newest(hits(traces, lambda t, c: _is_traced(t), F.col("id"), F.col("ts")), "traces"))
    out.append(newest(hits(audit, said, F.col("id"), F.col("ts")), "audit"))
    return reduce(DataFrame.unionByName, out)


def subject_data(stores: Mapping[str, tuple[DataFrame, str, Column]], traces: DataFrame, audit: DataFrame, term: str, country: str | None = None, details: tuple[str, ...] = ("detail",), limit: int = 100) -> DataFrame:
    """(store, rid) of all that is held on one term; see ``subjects_data``."""
    return subjects_data(stores, traces, audit, [("", term, country)], details, limit).drop("subject")


def erasure_counts(stores: Mapping[str, tuple[DataFrame, str]], term: str | Sequence[str], country: str | None = None, traces: DataFrame | None = None) -> DataFrame:
    """(store, erased, kept): what an erasure of the term, or of all of several, would do to the stores and ``traces``; a row that several name counts once.

    As ``erased`` does it: a store's rows go by their word, exactly, and by the country if the store has one; traces (word_sha256,
    prompt_hash) by the term's hash, whether it was the word or the prompt, of whatever country.
    """
    terms = [term] if isinstance(term, str) else term
    hits = {name: (table, [_is_subject(table, column, t, country) for t in terms]) for name, (table, column) in stores.items()}
    if traces is not None:
        hits["traces"] = (traces, [_is_traced(t) for t in terms])
    out = None
    for name, (table, named) in hits.items():
        hit = any_of([F.lit(False), *named])
        row = table.agg(F.count_if(hit).alias("erased"), F.count_if(~hit).alias("kept")).select(F.lit(name).alias("store"), "erased", "kept")
        out = row if out is None else out.unionByName(row)
    return out


def lineage_steps(events: DataFrame, run: str, *order: str) -> DataFrame:
    """Events with their step in their run."""
    return events.withColumn("step", F.row_number().over(Window.partitionBy(run).orderBy(*order)))
