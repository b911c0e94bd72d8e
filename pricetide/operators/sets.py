"""Set operations over source tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions import parsing as P


def union_disjoint(older: DataFrame, newer: DataFrame, day: str = "date") -> DataFrame:
    """Both sources; raises when the older one reaches into the newer one's period.

    The two dates are the only values that travel to the driver.
    """
    end = older.agg(F.max(day).alias("d")).first()["d"]
    start = newer.agg(F.min(day).alias("d")).first()["d"]
    if end is not None and start is not None and end >= start:
        raise ValueError(f"source periods overlap: {end} >= {start}")
    return older.unionByName(newer)


def merge_existing(dashboard: DataFrame, owner: Column, wanted: str, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(rows inside the owned scope, counts by reason).  ``owner`` reads the parsed contract date ``_date``."""
    parsed = dashboard.withColumn("_date", P.compact_date(F.col("CTRT_DAY")))
    inside = (F.col("_date") <= F.lit(as_of).cast("date")) & (owner == wanted)
    judged = parsed.withColumn(
        "reason",
        F.when(F.col("_date").isNull(), "invalid_date_excluded")
        .when(~F.coalesce(inside, F.lit(False)), "outside_owned_scope_excluded")
        .otherwise("written_rows"),
    )
    counts = judged.groupBy("reason").agg(
        F.count("*").alias("rows"), F.min("_date").alias("contract_min"), F.max("_date").alias("contract_max")
    )
    return judged.where(F.col("reason") == "written_rows").drop("_date", "reason"), counts


def poll_delta(previous: DataFrame, current: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Rows added, removed or changed in multiplicity between two complete polls.

    Copies are counted before the frames meet, so a row repeated a billion
    times is one row of the exchange.
    """
    count = lambda df, c, other: df.groupBy(*identity).agg(F.count("*").alias(c)).withColumn(other, F.lit(0).cast("long"))
    both = count(previous, "before", "after").unionByName(count(current, "after", "before"))
    delta = both.groupBy(*identity).agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
    kind = F.when(F.col("before") == 0, "added").when(F.col("after") == 0, "removed").otherwise("count_changed")
    return delta.where(F.col("before") != F.col("after")).withColumn("change", kind)


def document_delta(previous: DataFrame, current: DataFrame, key: str, payload: str) -> DataFrame:
    """New and changed documents with the hash of the text they replace; a removal raises."""
    old = previous.select(key, F.sha2(payload, 256).alias("before_sha256"))
    new = current.select(key, payload, F.sha2(payload, 256).alias("_after"))
    joined = new.join(old, key, "full_outer")
    kept = F.when(F.col("_after").isNull(), F.raise_error(F.lit("a document is gone: archive it before its delta is taken")).cast("boolean"))
    changed = kept.otherwise(F.col("before_sha256").isNull() | (F.col("before_sha256") != F.col("_after")))
    return joined.where(changed).drop("_after")


def shared(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values present on both sides; a train/test split needs this to be empty."""
    return a.select(*columns).intersect(b.select(*columns))


def assert_disjoint(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> None:
    if shared(a, b, columns).limit(1).count():
        raise ValueError(f"frames share {list(columns)}")


def select_partitions(df: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exactly the expected partitions; an expected one without rows raises."""
    present = df.select(*keys).distinct().withColumn("_present", F.lit(True))
    found = expected.select(*keys).distinct().join(present, list(keys), "left")
    ok = F.when(F.col("_present"), F.lit(True)).otherwise(F.raise_error(F.lit("expected partition is missing")).cast("boolean"))
    return df.join(found.where(ok).select(*keys), list(keys), "left_semi")
