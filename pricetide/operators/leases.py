"""Lease evidence: snapshots per type, observed lease-to-sale ratios, listing repricing, index vintages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions import calendar as cal
from pricetide.operators.stats import Quantile, quantiles

# Contract types as published (fixed values): new, renewal, unknown.
NEW, RENEWAL, UNKNOWN = "신규", "갱신", "미상"
SIGNATURE = ["key", "date", "floor", "deposit", "monthly_rent", "contract_type"]


def distinct_signature(leases: DataFrame, columns: Sequence[str] = SIGNATURE) -> DataFrame:
    """One row per signature.  Multiplicity is data elsewhere; only this view drops it."""
    return leases.dropDuplicates(list(columns))


def lease_snapshot(leases: DataFrame, origin: str, published: Column | None = None, unique: bool = True) -> DataFrame:
    """New-lease medians over 90/180 days (at least 3), counts by contract type, momentum and last age per key.

    A lease is visible 31 days after its contract and not before its receipt
    year.  ``published`` (a date column) switches to the stricter scenario in
    which the source file itself must be out before the origin.
    """
    at = cal.as_date(origin)
    cutoff = F.date_sub(at, cal.NEW_LAG)
    rows = leases.where((F.col("date") <= cutoff) & (F.col("receipt_year") <= F.year(at)))
    if published is not None:
        rows = rows.where(published < at)
    if unique:
        rows = distinct_signature(rows)
    rows = rows.withColumn("back", F.datediff(cutoff, "date")).where(F.col("back") < 365)
    is_new = F.col("contract_type") == NEW
    flag = lambda c: F.when(c, 1).otherwise(0)
    back = F.col("back")
    medians = quantiles(
        rows.where(is_new),
        ["key"],
        "log_rent",
        {
            "lease_log90": Quantile(0.5, "w90", min_weight=3),
            "lease_log180": Quantile(0.5, "w180", min_weight=3),
            "_prior": Quantile(0.5, "prior", min_weight=3),
        },
        {"w90": flag(back < 90), "w180": flag(back < 180), "prior": flag(back.between(180, 359))},
    ).select("key", "lease_log90", "lease_log180", (F.col("lease_log180") - F.col("_prior")).alias("lease_momentum"))
    counts = rows.groupBy("key").agg(
        F.count_if(is_new & (back < 90)).alias("lease_new_n90"),
        F.count_if(is_new & (back < 180)).alias("lease_new_n180"),
        F.count_if((F.col("contract_type") == RENEWAL) & (back < 180)).alias("lease_renewal_n180"),
        F.count_if((F.col("contract_type") == UNKNOWN) & (back < 180)).alias("lease_unknown_n180"),
        F.datediff(at, F.max(F.when(is_new, F.col("date")))).alias("lease_last_age"),
    )
    return counts.join(medians, "key", "left")


def observable(df: DataFrame, as_of: str | Column) -> DataFrame:
    """Rows already published at ``as_of``; a row without ``available_at`` raises."""
    as_of = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    if "available_at" not in df.columns:
        raise ValueError("the rows say when they were agreed, not when they became public: available_at is needed")
    known = F.when(F.col("available_at").isNull(), F.raise_error(F.lit("a row does not say when it became public")).cast("boolean"))
    return df.where(known.otherwise(F.col("available_at") <= as_of))


def latest_vintage(df: DataFrame, as_of: str, keys: Sequence[str] = ("series_id", "period"),
                   tie: Sequence[str] = ("value",), levels: bool = True) -> DataFrame:
    """The newest published value of each series and period at ``as_of``.

    Equal publication instants are resolved by the largest tie columns.
    ``levels`` says that values are index levels, which must be positive;
    otherwise any number counts, and a missing one is not published.
    """
    seen = observable(df, as_of)
    positive = F.when(F.col("value") > 0, F.col("value")).otherwise(
        F.raise_error(F.lit("index levels must be positive")).cast("double")
    )
    row = F.struct("available_at", *tie, *[c for c in df.columns if c not in (*keys, "available_at", *tie)])
    if not levels:
        return seen.groupBy(*keys).agg(F.max(F.when(F.col("value").isNotNull(), row)).alias("_n")).select(*keys, "_n.*")
    newest = F.max(row)
    return seen.withColumn("value", positive).groupBy(*keys).agg(newest.alias("_n")).select(*keys, "_n.*")


def jeonse_ratio(leases: DataFrame, sales: DataFrame, as_of: str, days: int = 180) -> DataFrame:
    """New-lease median over sale median per key, each from at least 3 rows; renewals never stand in."""
    end = F.lit(as_of).cast("timestamp")
    recent = lambda d: observable(d, as_of).where(
        F.col("contract_date").cast("timestamp").between(end - F.expr(f"interval {days} days"), end)
    )
    pure = recent(leases).where((F.col("monthly_rent") == 0) & (F.col("deposit") > 0))
    counts = pure.groupBy("key").agg(
        F.count_if(F.col("contract_type") == NEW).alias("new_jeonse_count"),
        F.count_if(F.col("contract_type") == RENEWAL).alias("renewal_count"),
        F.count_if(~F.col("contract_type").isin(NEW, RENEWAL)).alias("unknown_contract_type_count"),
    )
    deposit = quantiles(
        pure.where(F.col("contract_type") == NEW), ["key"], "deposit", {"new_jeonse_median": Quantile(0.5, min_weight=3)}
    ).select("key", "new_jeonse_median")
    price = quantiles(
        recent(sales).where((F.col("price") > 0) & ~F.col("cancelled")), ["key"], "price",
        {"sale_median": Quantile(0.5, min_weight=3)},
    ).select("key", "sale_median").where(F.col("sale_median").isNotNull())
    joined = counts.join(deposit, "key", "left").join(price, "key", "full_outer")
    return joined.fillna(0, subset=["new_jeonse_count", "renewal_count", "unknown_contract_type_count"]).withColumn(
        "new_jeonse_ratio", F.try_divide("new_jeonse_median", "sale_median")
    )


def asking_change(snapshots: DataFrame, as_of: str, lookback_days: int = 28, tie: Sequence[str] = ("price",)) -> DataFrame:
    """Repricing of listings present at both instants, per key.

    Entries and exits are not price changes: only identical listing ids count.
    """
    seen = observable(snapshots, as_of).where(F.col("price") > 0)
    end = F.lit(as_of).cast("timestamp")
    before = end - F.expr(f"interval {lookback_days} days")
    latest = lambda until: F.max_by(
        F.struct("status", "price"), F.when(F.col("available_at") <= until, F.struct("available_at", *tie))
    )
    pairs = seen.groupBy("key", "listing_id").agg(latest(end).alias("now"), latest(before).alias("old"))
    active = lambda c: F.col(f"{c}.status") == "active"
    pairs = pairs.where(active("now")).withColumn(
        "change", F.when(active("old"), F.ln(F.col("now.price") / F.col("old.price")))
    )
    counts = pairs.groupBy("key").agg(
        F.count("*").alias("active_listing_ids"),
        F.count("change").alias("matched_listing_ids"),
        F.avg((F.col("change") < 0).cast("double")).alias("_cut"),
    )
    medians = quantiles(pairs, ["key"], "change", {"_median": Quantile(0.5)}).select("key", "_median")
    asking = quantiles(pairs, ["key"], F.col("now.price"), {"asking_q25": Quantile(0.25, min_weight=3)}).select("key", "asking_q25")
    enough = F.col("matched_listing_ids") >= 3
    return (
        counts.join(medians, "key", "left")
        .join(asking, "key", "left")
        .withColumn("matched_change", F.when(enough, F.expm1("_median")))
        .withColumn("price_cut_share", F.when(enough, F.col("_cut")))
        .drop("_median", "_cut")
    )
