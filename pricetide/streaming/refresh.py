"""Rolling refresh of monthly partitions and versioned publication."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricetide.operators.quality import partition_digest
from pricetide.session import durable, scratch_path

NORMALISER = "pricetide-rows-v1"
EPOCH_ORDINAL = 719163  # proleptic day number of 1970-01-01


def refresh_plan(scopes: DataFrame, recent: int = 3) -> DataFrame:
    """Spans to poll again per scope (scope, start, cutoff): the last months and one rotating older month.

    Adjacent months of one year merge into one span; the last one ends at the
    cut-off.  A scope has as many rows here as its history has months.
    """
    months = scopes.select(
        "scope",
        "cutoff",
        F.posexplode(F.sequence(F.trunc("start", "MM"), F.trunc("cutoff", "MM"), F.expr("interval 1 month"))).alias("_i", "month"),
    )
    per = Window.partitionBy("scope")
    sized = months.withColumn("_n", F.max("_i").over(per) + 1).withColumn("_old", F.greatest(F.col("_n") - recent, F.lit(0)))
    turn = (F.unix_date("cutoff") + EPOCH_ORDINAL) % F.nullif(F.col("_old"), F.lit(0))
    picked = sized.where((F.col("_i") >= F.col("_old")) | (F.col("_i") == turn))
    order = Window.partitionBy("scope").orderBy("_i")
    follows = (F.lag("_i").over(order) == F.col("_i") - 1) & (F.year(F.lag("month").over(order)) == F.year("month"))
    marked = picked.withColumn("_new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    islands = marked.withColumn("_span", F.sum("_new").over(order))
    return islands.groupBy("scope", "_span").agg(
        F.min("month").alias("first_day"),
        F.max(F.least(F.last_day("month"), F.col("cutoff"))).alias("last_day"),
        F.count("*").alias("months"),
    ).drop("_span")


def write_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    # Rebalanced, not repartitioned: a partition value with many rows is split among tasks and files.
    df.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def apply_refresh(spark: SparkSession, path: str, refreshed: DataFrame, keys: list[str], delivered: DataFrame | None = None) -> DataFrame:
    """Replace only the partitions present in ``refreshed``, and only if all of them reconcile.

    The new partitions are written to a staging folder in the shared folder, and their rows are counted there against ``delivered`` (keys and
    ``delivered_rows``; by default counted from ``refreshed``).  The live table is touched after that, and not at all where a count differs.
    Returns the reconciliation, one row per partition, in which a null key is a partition like any other.
    """
    staged = scratch_path(spark, "staged")
    write_partitions(refreshed, staged, keys)
    kept = spark.read.schema(refreshed.schema).parquet(staged)
    if delivered is None:
        delivered = refreshed.groupBy(*keys).agg(F.count("*").alias("delivered_rows"))
    written = kept.groupBy(*keys).agg(F.count("*").alias("written_rows"))
    both = delivered.select(*keys, "delivered_rows", F.lit(0).cast("long").alias("written_rows")).unionByName(
        written.select(*keys, F.lit(0).cast("long").alias("delivered_rows"), "written_rows")
    )
    sums = both.groupBy(*keys).agg(F.sum("delivered_rows").alias("delivered_rows"), F.sum("written_rows").alias("written_rows"))
    report = durable(sums.withColumn("matches", F.col("written_rows") == F.col("delivered_rows")))
    if report.where(~F.col("matches")).isEmpty():
        kept.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    return report


class VersionedStore:
    """Datasets as immutable ``dataset_key=…/version_id=…`` Parquet folders plus an append-only table of heads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def log(self) -> DataFrame:
        schema = "dataset_key string, version_id string, row_count long, seq long"
        if not self._exists(f"{self.root}/heads"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/heads")

    def heads(self) -> DataFrame:
        return self.log().groupBy("dataset_key").agg(F.max_by(F.struct("version_id", "row_count"), "seq").alias("_h")).select(
            "dataset_key", "_h.*"
        )

    def publish(self, df: DataFrame, dataset: str, row_no: str = "row_no") -> dict:
        """Publish a version named by its content; publishing the current version again changes nothing.

        Rows become readable only when the head row is appended, which is the
        last step, so an interrupted run leaves no half-visible version.
        """
        names = sorted(df.columns)
        stamp = partition_digest(df.withColumn("_all", F.lit(0)), ["_all"], names).first()
        rows = int(stamp["rows"]) if stamp else 0
        if rows == 0:
            raise ValueError("empty import refused")
        version = hashlib.sha256(f"{stamp['digest']}:{rows}:{','.join(names)}:{NORMALISER}".encode()).hexdigest()
        head = self.heads().where(F.col("dataset_key") == dataset).first()
        if head is not None and head["version_id"] == version:
            return {"dataset": dataset, "version": version, "rows": rows, "changed": False}
        path = f"{self.root}/rows/dataset_key={dataset}/version_id={version}"
        df.repartitionByRange(row_no).sortWithinPartitions(row_no).write.mode("overwrite").parquet(path)
        written = self.spark.read.parquet(path).count()
        if written != rows:
            raise ValueError("written row count differs from source")
        seq = self.log().agg(F.coalesce(F.max("seq"), F.lit(0)).alias("s")).first()["s"] + 1
        record = self.spark.createDataFrame([(dataset, version, rows, seq)], "dataset_key string, version_id string, row_count long, seq long")
        record.coalesce(1).write.mode("append").parquet(f"{self.root}/heads")
        return {"dataset": dataset, "version": version, "rows": rows, "changed": True}

    def query(self, dataset: str, version: str | None = None, entity: str | None = None, region: str | None = None,
              start: str | None = None, end: str | None = None, after: int = 0, limit: int = 50) -> DataFrame:
        """Rows of one pinned version after a row number, filtered by entity, region and day range."""
        if version is None:
            head = self.heads().where(F.col("dataset_key") == dataset).first()
            if head is None:
                raise KeyError(f"dataset not found: {dataset}")
            version = head["version_id"]
        rows = self.spark.read.parquet(f"{self.root}/rows/dataset_key={dataset}/version_id={version}")
        rows = rows.where(F.col("row_no") > after)
        for column, value in (("entity_key", entity), ("region_code", region)):
            if value is not None:
                rows = rows.where(F.col(column) == value)
        if start:
            rows = rows.where(F.col("observed_day") >= start)
        if end:
            rows = rows.where(F.col("observed_day") <= end)
        return rows.withColumn("version_id", F.lit(version)).orderBy("row_no").limit(limit)


def changed_months(new: DataFrame, heads: DataFrame) -> DataFrame:
    """Months whose content version differs from the published head, or that have none."""
    joined = new.join(heads.select("dataset_key", F.col("version_id").alias("_head")), "dataset_key", "left")
    return joined.where(~F.col("version_id").eqNullSafe(F.col("_head"))).withColumn("is_new", F.col("_head").isNull()).drop("_head")


def prunable_versions(versions: DataFrame, heads: DataFrame) -> DataFrame:
    """Complete versions that are not the head of their dataset; datasets without a head are left alone."""
    complete = versions.where(F.col("status") == "complete").join(heads.select("dataset_key"), "dataset_key", "left_semi")
    return complete.join(heads.select("dataset_key", "version_id"), ["dataset_key", "version_id"], "left_anti")


def verify_shards(shards: DataFrame, shard_count: int, scope: str = "collection") -> DataFrame:
    """Per collection: all shards present, each once, and bound to one source snapshot."""
    return shards.groupBy(scope).agg(
        F.count("*").alias("shards"),
        F.count_distinct("shard_index").alias("distinct_shards"),
        F.count_distinct("snapshot_id").alias("snapshots"),
        F.count_if(~F.col("shard_index").between(0, shard_count - 1)).alias("unknown_shards"),
    ).withColumn(
        "verified",
        (F.col("shards") == shard_count) & (F.col("distinct_shards") == shard_count) & (F.col("snapshots") == 1) & (F.col("unknown_shards") == 0),
    )
