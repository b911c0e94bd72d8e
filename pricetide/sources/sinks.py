"""Writers.  Each creates new output, verifies what it promises, and leaves nothing to the driver but counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.functions.parsing import formula_guard
from pricetide.operators.quality import partition_digest
from pricetide.session import compiled

ROWS_PER_FILE = 100_000
# Folders that one task writes to at a time; rows of more folders are sorted first.
OPEN_FILES = 128


def write_canonical(canonical: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Canonical JSON records, gzipped, by kind, province and contract year; a hot partition becomes many files, not one task.

    Records without a province or date land in their own partitions.
    """
    keyed = canonical.withColumns(
        {"sido": F.coalesce("address.sido", F.lit("unresolved")), "year": F.coalesce(F.year("contract_date").cast("string"), F.lit("unknown"))}
    )
    writer = keyed.write.mode("errorifexists").partitionBy("kind", "sido", "year").option("maxRecordsPerFile", rows_per_file)
    # The records' parsers and the JSON run in one task; deflating at its default level took longer than making the text.
    with compiled(canonical.sparkSession, OPEN_FILES):
        writer.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").json(path)


def write_trades(dashboard: DataFrame, path: str) -> None:
    """Dashboard rows as gzip CSV by province prefix and year; existing output is refused."""
    keyed = dashboard.withColumns({"sido": F.substring("CGG_CD", 1, 2), "year": F.substring("CTRT_DAY", 1, 4)})
    (
        keyed.write.mode("errorifexists").partitionBy("sido", "year").option("header", True)
        .option("emptyValue", "").option("compression", "gzip").csv(path)
    )


def export_months(rows: DataFrame, path: str, month: str = "month", max_rows: int | None = None) -> DataFrame:
    """One gzip JSON-lines folder per contract month, and the manifest (month, rows, digest).

    The digest does not depend on row order, so an unchanged month keeps it.
    A month above ``max_rows`` raises before anything is written.
    """
    columns = [c for c in rows.columns if c != month]
    manifest = partition_digest(rows, [month], columns)
    if max_rows is not None and manifest.where(F.col("rows") > max_rows).limit(1).count():
        raise ValueError("monthly row budget exceeded")
    rows.write.mode("errorifexists").partitionBy(month).option("compression", "gzip").json(path)
    return manifest


def save_features(df: DataFrame, path: str) -> int:
    """Parquet features, re-read and compared by row count."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    spark = df.sparkSession
    written, expected = spark.read.parquet(path).count(), df.count()
    if written != expected:
        raise OSError(f"incomplete Parquet output: {written} of {expected} rows")
    return written


def publish_bundle(types: DataFrame, attributes: Sequence[str], facts: Sequence[str], period: str) -> tuple[DataFrame, DataFrame]:
    """(catalog of distinct attribute tuples, per-period facts that refer to it by hash id).

    The id is the first 16 hex digits of the tuple's SHA-256; it needs no
    global numbering and is the same in every run.
    """
    body = F.to_json(F.struct(*sorted(attributes)), {"ignoreNullFields": "false"})
    keyed = types.withColumn("catalog_id", F.substring(F.sha2(body, 256), 1, 16))
    catalog = keyed.select("catalog_id", *attributes).distinct()
    return catalog, keyed.select(period, "catalog_id", *facts)


def decode_bundle(catalog: DataFrame, facts: DataFrame) -> DataFrame:
    return facts.join(catalog, "catalog_id").drop("catalog_id")


def export_csv(df: DataFrame, path: str) -> None:
    """Result CSV for spreadsheets: every cell quoted, formula-like text defused."""
    guarded = df.select(*[formula_guard(F.col(c)).alias(c) for c in df.columns])
    guarded.write.mode("errorifexists").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
