"""Observation ledger: how published rows change between complete polls.

The publisher offers no row ids, so a row is its content and its identity is
the content's hash; multiplicity is data.  A poll is the complete content of
one partition at one instant.  The ledger keeps every poll time and, per row,
the instants at which its count changed — enough to say what was known at any
past time.

Everything is keyed by (partition, row hash): copies collapse map-side before
any shuffle, so neither a hot partition nor a hot row gathers in one task.

The state that a micro-batch continues from is a table of its own: the current
count of every row and the latest poll of every partition, compacted every few
batches into a generation.  A batch reads the last generation's buckets that
its partitions fall into, and the changes written since; never older changes.
A compaction rewrites only buckets that changed, so generations also serve as
snapshots from which past times are read.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

POLL_SCHEMA = StructType(
    [
        StructField("partition", StringType()),
        StructField("observed_at", TimestampType()),
        # Rows the poll holds; lets a half-delivered poll be refused.
        StructField("poll_rows", LongType()),
        # Null in the single record of an empty poll.
        StructField("row", StringType()),
        # When the poll reached the collector; null: as soon as it was made.
        StructField("delivered_at", TimestampType()),
    ]
)
CHANGE_COLUMNS = ["partition", "row_hash", "row", "observed_at", "count"]
CHANGES = "partition string, row_hash string, row string, observed_at timestamp, count long"
POLLS = "partition string, observed_at timestamp, content decimal(38,0)"
HEADS = "partition string, baseline timestamp, observed_at timestamp, content decimal(38,0), closed boolean"


def write_polls(rows: DataFrame, path: str) -> None:
    """Rows (partition, observed_at, row[, delivered_at]) as poll files; all records of a poll land in one file."""
    if "delivered_at" not in rows.columns:
        rows = rows.withColumn("delivered_at", F.lit(None).cast("timestamp"))
    key = ["partition", "observed_at", "delivered_at"]
    sizes = rows.groupBy(*key).agg(F.count("row").alias("poll_rows")).withColumnsRenamed({k: f"_{k}" for k in key})
    complete = rows.join(sizes, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]).select(*POLL_SCHEMA.fieldNames())
    complete.repartition("partition", "observed_at").write.mode("append").json(path)


def read_polls(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of poll records; each file holds whole polls."""
    reader = spark.readStream.schema(POLL_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def row_counts(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(polls, counts per row) of poll records; an incomplete poll raises.

    A poll is what one delivery holds of a partition at an instant.
    """
    if "delivered_at" not in records.columns:
        records = records.withColumn("delivered_at", F.lit(None).cast("timestamp"))
    records = records.withColumn("delivered_at", F.coalesce("delivered_at", "observed_at"))
    polls = records.groupBy("partition", "observed_at", "delivered_at").agg(
        F.max("poll_rows").alias("declared"), F.count("row").alias("held")
    )
    whole = F.when(F.col("declared") == F.col("held"), F.lit(True)).otherwise(
        F.raise_error(F.lit("incomplete polls cannot establish prior absence")).cast("boolean")
    )
    polls = polls.where(whole).select("partition", "observed_at", "delivered_at")
    counts = (
        records.where(F.col("row").isNotNull())
        .groupBy("partition", "observed_at", "delivered_at", F.sha2("row", 256).alias("row_hash"), "row")
        .agg(F.count("*").alias("count"))
    )
    return polls, counts


def ledger_changes(polls: DataFrame, counts: DataFrame, last_polls: DataFrame | None = None,
                   last_counts: DataFrame | None = None) -> DataFrame:
    """Changes of every row's count over ``polls``, continuing from the known state.

    A row is compared with the poll just before; its absence there counts as
    0, and a row missing from the next poll changes to 0 at that poll.
    """
    polls = polls.withColumn("_new", F.lit(True))
    counts = counts.select("partition", "observed_at", "row_hash", "row", "count")
    if last_polls is not None:
        polls = polls.unionByName(last_polls.select("partition", "observed_at", F.lit(False).alias("_new")))
        known = last_counts.where(F.col("count") > 0).drop("observed_at").join(last_polls, "partition")
        counts = counts.unionByName(known.select(*counts.columns))
    # A partition's poll times: as many rows as it was polled.
    times = Window.partitionBy("partition").orderBy("observed_at")
    timeline = polls.withColumns(
        {"_prev": F.lag("observed_at").over(times), "_next": F.lead("observed_at").over(times)}
    )
    per_row = Window.partitionBy("partition", "row_hash").orderBy("observed_at")
    seen = counts.join(timeline, ["partition", "observed_at"]).withColumns(
        {
            "_at_before": F.lag("observed_at").over(per_row),
            "_before": F.lag("count").over(per_row),
            "_at_after": F.lead("observed_at").over(per_row),
        }
    )
    before = F.when(F.col("_at_before") == F.col("_prev"), F.col("_before")).otherwise(0)
    changed = F.col("_new") & (F.col("count") != before)
    vanished = F.col("_next").isNotNull() & (F.col("_at_after").isNull() | (F.col("_at_after") > F.col("_next")))
    events = F.array_compact(
        F.array(
            F.when(changed, F.struct(F.col("observed_at").alias("at"), F.col("count").alias("n"))),
            F.when(vanished, F.struct(F.col("_next").alias("at"), F.lit(0).cast("long").alias("n"))),
        )
    )
    return seen.select("partition", "row_hash", "row", F.explode(events).alias("_e")).select(
        "partition", "row_hash", "row", F.col("_e.at").alias("observed_at"), F.col("_e.n").alias("count")
    )


def with_content(polls: DataFrame, counts: DataFrame) -> DataFrame:
    """Polls with a digest of their rows and counts, in any order; 0 for an empty poll."""
    key = ["partition", "observed_at", "delivered_at"]
    digest = F.sum(F.xxhash64("row_hash", "count").cast("decimal(38,0)"))
    known = counts.groupBy(*key).agg(digest.alias("content"))
    return polls.join(known, key, "left").withColumn("content", F.coalesce("content", F.lit(0).cast("decimal(38,0)")))


def current_counts(changes: DataFrame) -> DataFrame:
    """Latest count of every row signature."""
    return changes.groupBy("partition", "row_hash").agg(
        F.max_by(F.struct("row", "count", "observed_at"), "observed_at").alias("_l")
    ).select("partition", "row_hash", "_l.*")


def guard_time(polls: DataFrame, heads: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(polls that advance time, rejected polls with a reason).

    Polls are judged in the order in which they were delivered, those of this
    batch after the known heads.  One that is older than an earlier delivery,
    or of the same instant with other content, is set aside, never merged.
    The latest poll delivered once more with the same content is a retry: it
    is in neither result.  A poll of a closed partition is rejected.
    """
    known = polls.select("partition", "observed_at", "delivered_at", "content", F.lit(True).alias("_new"), F.lit(False).alias("_closed"))
    if heads is not None:
        touched = heads.join(polls.select("partition").distinct(), "partition", "left_semi")
        # Before any delivery of this batch.
        known = known.unionByName(touched.select("partition", "observed_at", F.lit(None).cast("timestamp").alias("delivered_at"), "content", F.lit(False).alias("_new"), F.col("closed").alias("_closed")))
    # A partition's polls: as many rows as it was polled in this batch.
    arrival = Window.partitionBy("partition").orderBy("_new", "delivered_at", "observed_at", "content").rowsBetween(Window.unboundedPreceding, -1)
    judged = known.withColumns({"_latest": F.max("observed_at").over(arrival), "_shut": F.coalesce(F.max("_closed").over(arrival), F.lit(False))})
    # The content that stands at the latest instant is the one delivered first.
    at_once = Window.partitionBy("partition", "observed_at").orderBy("_new", "delivered_at", "content").rowsBetween(Window.unboundedPreceding, -1)
    judged = judged.withColumn("_content", F.first("content").over(at_once)).where("_new")
    repeated = F.col("observed_at") == F.col("_latest")
    reason = F.when(F.col("_shut"), "partition_closed").when(F.col("observed_at") < F.col("_latest"), "older_than_latest").when(repeated, "repeated_instant")
    retry = F.coalesce(repeated & (F.col("content") == F.col("_content")), F.lit(False))
    judged = judged.where(~retry).withColumn("reason", reason)
    out = judged.select("partition", "observed_at", "delivered_at", "content", "reason")
    return out.where(F.col("reason").isNull()).drop("reason"), out.where(F.col("reason").isNotNull()).drop("content")


class Ledger:
    """Parquet tables below one folder.

    ``changes``, ``polls`` and ``rejected`` have a subfolder per micro-batch;
    ``counts`` and ``heads`` one per generation, ``manifest`` says which
    generation holds which bucket.  A micro-batch writes only folders of its
    own id and reads only smaller ids, so a retried batch rewrites exactly what
    it wrote before.  ``compact_every``: batches between generations.
    ``close_after``: a partition whose latest poll is this much older than the
    newest of all is closed: its counts leave the state with the next
    generation, and further polls of it are rejected.
    """

    BUCKETS = 256

    def __init__(self, spark: SparkSession, path: str, compact_every: int = 16, close_after: dt.timedelta | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.compact_every, self.close_after = compact_every, close_after

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _exists(self, path: str) -> bool:
        at, fs = self._at(path)
        return fs.exists(at)

    def _read(self, name: str, schema: str) -> DataFrame | None:
        if not self._exists(f"{self.path}/{name}"):
            return None
        return self.spark.read.schema(f"{schema}, batch_id long").parquet(f"{self.path}/{name}")

    def _batches(self, name: str, schema: str, after: int, before: int) -> DataFrame | None:
        """Rows of the batches between two ids, found by their folders' names: no other folder is listed."""
        paths = [p for k in range(after + 1, before) if self._exists(p := f"{self.path}/{name}/batch_id={k}")]
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def changes(self) -> DataFrame | None:
        return self._read("changes", CHANGES)

    def polls(self) -> DataFrame | None:
        return self._read("polls", POLLS)

    def rejected(self) -> DataFrame | None:
        return self._read("rejected", "partition string, observed_at timestamp, reason string")

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch_id={batch_id}")

    def generations(self, before: int) -> list[int]:
        """Ids of complete generations below an id, ascending."""
        at, fs = self._at(f"{self.path}/manifest")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        ids = [int(n.split("=")[1]) for n in names if n.startswith("batch_id=") and self._exists(f"{self.path}/manifest/{n}/_SUCCESS")]
        return sorted(k for k in ids if k < before)

    def _manifest(self, generation: int) -> dict[int, int]:
        """The generation that holds each bucket; at most BUCKETS entries."""
        return {r["bucket"]: r["generation"] for r in self.spark.read.schema("bucket int, generation long").parquet(f"{self.path}/manifest/batch_id={generation}").collect()}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("partition"), F.lit(self.BUCKETS)).cast("int")

    def _base(self, generation: int, buckets: set[int] | None = None) -> DataFrame | None:
        held = {b: g for b, g in self._manifest(generation).items() if buckets is None or b in buckets}
        paths = [f"{self.path}/counts/generation={g}/bucket={b}" for b, g in sorted(held.items())]
        return self.spark.read.schema(CHANGES).parquet(*paths) if paths else None

    def heads(self, before: int) -> DataFrame | None:
        """Baseline and latest poll of every partition as known before a batch."""
        last = max(self.generations(before), default=-2)
        polls = self._batches("polls", POLLS, last, before)
        parts = [] if polls is None else [polls.select("partition", F.col("observed_at").alias("baseline"), "observed_at", "content", F.lit(False).alias("closed"))]
        if last > -2:
            parts.append(self.spark.read.schema(HEADS).parquet(f"{self.path}/heads/batch_id={last}"))
        if not parts:
            return None
        return (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).groupBy("partition").agg(
            F.min("baseline").alias("baseline"), F.max("observed_at").alias("observed_at"),
            F.max_by("content", "observed_at").alias("content"), F.max("closed").alias("closed"),
        )

    def state(self, before: int, touched: DataFrame | None = None) -> DataFrame | None:
        """Latest known count of every row before a batch, of the touched partitions only if given."""
        last = max(self.generations(before), default=-2)
        buckets = None if touched is None else {r[0] for r in touched.select(self._bucket()).distinct().collect()}
        parts = [p for p in (self._base(last, buckets) if last > -2 else None, self._batches("changes", CHANGES, last, before)) if p is not None]
        if touched is not None:
            parts = [p.join(touched, "partition", "left_semi") for p in parts]
        if not parts:
            return None
        return current_counts(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))

    def apply(self, records: DataFrame, batch_id: int) -> None:
        """One micro-batch: split off late polls, write changes and accepted poll times."""
        polls, counts = row_counts(records)
        # Written once: the stream's files are read and hashed a single time, and a lost executor takes nothing with it.
        self._write(counts, "incoming", batch_id)
        self._write(polls, "incoming_polls", batch_id)
        at = f"batch_id={batch_id}"
        counts = self.spark.read.schema(counts.schema).parquet(f"{self.path}/incoming/{at}")
        polls = with_content(self.spark.read.schema(polls.schema).parquet(f"{self.path}/incoming_polls/{at}"), counts)
        heads = self.heads(batch_id)
        accepted, rejected = guard_time(polls, heads)
        self._write(accepted, "accepted", batch_id)
        accepted = self.spark.read.schema(accepted.schema).parquet(f"{self.path}/accepted/{at}")
        counts = counts.join(accepted, ["partition", "observed_at", "delivered_at"], "left_semi")
        last_polls = last_counts = None
        if heads is not None:
            touched = accepted.select("partition").distinct()
            last_polls = heads.join(touched, "partition", "left_semi").select("partition", "observed_at")
            last_counts = self.state(batch_id, touched)
        if last_counts is None:
            last_polls = None
        changes = ledger_changes(accepted.select("partition", "observed_at"), counts, last_polls, last_counts)
        self._write(changes.select(*CHANGE_COLUMNS), "changes", batch_id)
        self._write(rejected.drop("delivered_at"), "rejected", batch_id)
        # Poll times last: a batch without them is not part of the known state.
        self._write(accepted.select("partition", "observed_at", "content"), "polls", batch_id)
        for name in ("incoming", "incoming_polls", "accepted"):
            path, fs = self._at(f"{self.path}/{name}/{at}")
            fs.delete(path, True)
        if batch_id - max(self.generations(batch_id), default=-1) >= self.compact_every:
            self.compact(batch_id)

    def compact(self, batch_id: int) -> None:
        """A generation of the state after a batch; buckets without changes since the last one stay where they are."""
        last, upto = max(self.generations(batch_id), default=-2), batch_id + 1
        heads = self.heads(upto)
        if heads is None:
            return
        if self.close_after is not None:
            newest = heads.agg(F.max("observed_at")).first()[0]
            stale = F.col("observed_at") < F.lit(newest - self.close_after).cast("timestamp")
            heads = heads.withColumn("closed", F.col("closed") | stale)
        self._write(heads, "heads", batch_id)
        heads = self.spark.read.schema(HEADS).parquet(f"{self.path}/heads/batch_id={batch_id}")
        # Buckets to rewrite: those polled since, and those with partitions closed now.
        moved = heads if last == -2 else heads.join(
            self.spark.read.schema(HEADS).parquet(f"{self.path}/heads/batch_id={last}").select("partition", F.col("observed_at").alias("_at"), F.col("closed").alias("_closed")), "partition", "left"
        ).where(F.col("_at").isNull() | (F.col("_at") < F.col("observed_at")) | (F.col("_closed") != F.col("closed")))
        dirty = {r[0] for r in moved.select(self._bucket()).distinct().collect()}
        inside = heads.withColumn("_b", self._bucket()).where(F.col("_b").isin(sorted(dirty)))
        counts = self.state(upto, inside.where(~F.col("closed")).select("partition"))
        manifest = {} if last == -2 else self._manifest(last)
        manifest = {b: g for b, g in manifest.items() if b not in dirty}
        if counts is not None:
            counts = counts.where(F.col("count") > 0).select(*CHANGE_COLUMNS).withColumn("bucket", self._bucket())
            counts.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/counts/generation={batch_id}")
            manifest |= {b: batch_id for b in dirty if self._exists(f"{self.path}/counts/generation={batch_id}/bucket={b}")}
        # The manifest last: without it the generation isn't there.
        rows = self.spark.createDataFrame(sorted(manifest.items()), "bucket int, generation long")
        self._write(rows.coalesce(1), "manifest", batch_id)

    def bootstrap(self, snapshot: DataFrame) -> None:
        """An un-ledgered snapshot (partition, fetched_at, row) becomes the baseline at its fetch time."""
        rows = snapshot.withColumnRenamed("fetched_at", "observed_at").withColumn("delivered_at", F.lit(None).cast("timestamp"))
        sizes = rows.groupBy("partition", "observed_at").agg(F.count("row").alias("poll_rows"))
        self.apply(rows.join(sizes, ["partition", "observed_at"]).select(*POLL_SCHEMA.fieldNames()), -1)

    def run(self, source: DataFrame, checkpoint: str) -> None:
        """Drain the poll stream that is available now."""
        query = (
            source.writeStream.foreachBatch(lambda df, batch: self.apply(df, batch))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def known_at(self, as_of: str) -> tuple[DataFrame, DataFrame]:
        """(changes, heads) that settle what was known at a time: the last generation that lies wholly before it, and the changes since."""
        at = F.lit(as_of).cast("timestamp")
        end = max(self._ids("polls"), default=-2) + 1
        heads = self.heads(end)
        if heads is None:
            raise ValueError("nothing had been observed at this time")
        beyond = (F.col("observed_at") > at) | F.col("closed")
        whole = lambda g: self.spark.read.schema(HEADS).parquet(f"{self.path}/heads/batch_id={g}").where(beyond).isEmpty()
        last = next((g for g in reversed(self.generations(end)) if whole(g)), -2)
        parts = [p for p in (self._base(last) if last > -2 else None, self._batches("changes", CHANGES, last, end)) if p is not None]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), heads.withColumn("observed_at", F.col("baseline"))

    def _ids(self, name: str) -> list[int]:
        at, fs = self._at(f"{self.path}/{name}")
        return [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(at) if "=" in s.getPath().getName()] if fs.exists(at) else []

    def rows_as_observed(self, as_of: str) -> DataFrame:
        """Rows known at a time, read from the nearest generation before it."""
        changes, baselines = self.known_at(as_of)
        return rows_as_observed(changes, baselines, as_of)


CHUNK = 1_000_000


def counts_as_observed(changes: DataFrame, polls: DataFrame, as_of: str) -> DataFrame:
    """Last known count of every row at ``as_of``; a partition not yet polled then raises."""
    at = F.lit(as_of).cast("timestamp")
    baseline = polls.groupBy("partition").agg(F.min("observed_at").alias("baseline"))
    # Checked on its own: a lazy check would vanish together with an empty result.
    if baseline.where(F.col("baseline") > at).limit(1).count():
        raise ValueError("nothing had been observed at this time")
    known = changes.where(F.col("observed_at") <= at).groupBy("partition", "row_hash").agg(
        F.max_by(F.struct("row", "count"), "observed_at").alias("_l")
    )
    return known.select("partition", "row_hash", "_l.*").where(F.col("count") > 0)


def rows_as_observed(changes: DataFrame, polls: DataFrame, as_of: str) -> DataFrame:
    """Exactly the rows, with multiplicity, known from the last poll at or before ``as_of``.

    Large multiplicities are cut into chunks and spread before they are expanded.
    """
    counts = counts_as_observed(changes, polls, as_of)
    last = F.floor((F.col("count") - 1) / CHUNK)
    chunks = counts.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    size = F.least(F.lit(CHUNK).cast("long"), F.col("count") - F.col("_chunk") * CHUNK)
    spread = chunks.withColumn("_size", size).repartition("row_hash", "_chunk")
    return spread.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_size")))).select("partition", "row")


# Upper ends of the reporting-age bins in days (fixed values).
AGE_BINS = ((7, "0-7"), (14, "8-14"), (30, "15-30"), (60, "31-60"), (90, "61-90"), (180, "91-180"))


def age_bin(days: Column) -> Column:
    out = F.when(days.isNull(), "invalid_date").when(days < 0, "negative")
    for ceiling, name in AGE_BINS:
        out = out.when(days <= ceiling, name)
    return out.otherwise("181+")


def appearance_events(changes: DataFrame, polls: DataFrame, contract_date: Column) -> DataFrame:
    """First appearance of every row: censored at the baseline, else bounded by the poll before it.

    ``contract_date`` reads the published ``row`` text.  Ages are in Korean
    calendar days.
    """
    from pricetide.functions.calendar import business_day

    times = Window.partitionBy("partition").orderBy("observed_at")
    timeline = polls.select("partition", "observed_at").distinct().withColumns(
        {"prior_poll": F.lag("observed_at").over(times), "_n": F.row_number().over(times)}
    )
    first = changes.groupBy("partition", "row_hash", "row").agg(F.min(F.struct("observed_at", "count")).alias("_f"))
    events = first.select("partition", "row_hash", "row", "_f.observed_at", F.col("_f.count").alias("row_copies")).join(
        timeline, ["partition", "observed_at"]
    )
    width = (F.unix_micros("observed_at") - F.unix_micros("prior_poll")) / 86400000000
    return events.withColumns(
        {
            "left_censored": F.col("prior_poll").isNull(),
            "absence_bound": F.when(F.col("_n") == 2, "baseline").when(F.col("_n") > 2, "explicit_poll"),
            "interval_days": width,
            "age_days": F.datediff(business_day(F.col("observed_at")), contract_date),
            "contract_date": contract_date,
        }
    ).drop("_n")


def reporting_lag_audit(changes: DataFrame, polls: DataFrame, contract_date: Column) -> tuple[DataFrame, DataFrame]:
    """(new signatures and copies by age bin and absence bound, revision counters per partition)."""
    events = appearance_events(changes, polls, contract_date)
    fresh = events.where(~F.col("left_censored"))
    ages = fresh.groupBy(age_bin(F.col("age_days")).alias("age_bin"), "absence_bound").agg(
        F.count("*").alias("new_signatures"), F.sum("row_copies").alias("new_row_copies"),
        F.count_if(F.col("interval_days") > 7).alias("wide_intervals"),
    )
    w = Window.partitionBy("partition", "row_hash").orderBy("observed_at")
    steps = changes.withColumn("_before", F.lag("count").over(w)).where(F.col("_before").isNotNull())
    up, down = F.col("count") > F.col("_before"), F.col("count") < F.col("_before")
    revisions = steps.groupBy("partition").agg(
        F.count("*").alias("revision_events"),
        F.count_if(up).alias("count_increase_events"),
        F.count_if(down).alias("count_decrease_events"),
        F.count_if(up & (F.col("_before") == 0)).alias("reappearance_events"),
        F.coalesce(F.sum(F.when(down, F.col("_before") - F.col("count"))), F.lit(0)).alias("removed_row_copies"),
    )
    censored = events.groupBy("partition").agg(
        F.count("*").alias("ledger_signatures"), F.count_if("left_censored").alias("left_censored_signatures")
    )
    return ages, censored.join(revisions, "partition", "left")
