"""Data-quality operators.  Checks return rows and counts; ``require`` turns them into errors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions import calendar as cal
from pricetide.functions import parsing as P
from pricetide.operators.normalise import exclusion_class


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """The same rows; evaluating one that breaks ``condition`` raises."""
    failed = F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return df.where(failed)


def inspect_export(df: DataFrame, scope: Sequence[str], province: str | Column, start: str, end: str) -> DataFrame:
    """Per scope: rows, date range, cancelled rows and rows breaking province, date or number rules."""
    date, _ = P.contract_date(F.col("contract_month"), F.col("contract_day"))
    _, area_flag = P.decimal_text(F.col("area"), "area", positive=True)
    _, amount_flag = P.decimal_text(F.col("amount"), "amount", positive=True)
    province = F.lit(province) if isinstance(province, str) else province
    marked = ~P.cleaned(F.col("cancelled_on")).isin(*P.MISSING, "N")
    rows = df.select(
        *scope,
        date.alias("_date"),
        (F.substring_index(F.trim("address_text"), " ", 1) == province).alias("_inside"),
        area_flag.isNotNull().alias("_area"),
        amount_flag.isNotNull().alias("_amount"),
        marked.alias("_cancelled"),
    )
    in_range = F.col("_date").between(cal.as_date(start), cal.as_date(end))
    return rows.groupBy(*scope).agg(
        F.count("*").alias("rows"),
        F.min("_date").alias("minimum_contract_date"),
        F.max("_date").alias("maximum_contract_date"),
        F.count_if("_cancelled").alias("cancellation_marked_rows"),
        F.count_if(F.col("_date").isNull()).alias("invalid_dates"),
        F.count_if(~in_range).alias("outside_dates"),
        F.count_if(~F.col("_inside")).alias("outside_province"),
        F.count_if("_area").alias("invalid_areas"),
        F.count_if("_amount").alias("invalid_amounts"),
    )


def month_counts(df: DataFrame, scope: Sequence[str]) -> DataFrame:
    return df.groupBy(*scope, F.trim("contract_month").alias("contract_month")).agg(F.count("*").alias("rows"))


def monthly_quality(dashboard: DataFrame) -> DataFrame:
    """raw = used + cancelled + property_type + direct + invalid per contract month; the first match wins."""
    rows = dashboard.select(
        F.substring("CTRT_DAY", 1, 6).alias("month"),
        exclusion_class().alias("_class"),
        P.is_missing(F.col("DCLR_SE")).alias("_unknown"),
        P.number_or_null(F.col("FLR")).isNotNull().alias("_floor"),
    )
    used = F.col("_class") == "used"
    classes = ("used", "cancelled", "property_type", "direct", "invalid")
    return rows.groupBy("month").agg(
        F.count("*").alias("raw"),
        *[F.count_if(F.col("_class") == c).alias(c) for c in classes],
        F.count_if(used & F.col("_unknown")).alias("unknown_deal_type"),
        F.count_if(used & F.col("_floor")).alias("floor_observed"),
    )


def source_summary(canonical: DataFrame, reason: Column, examples: int = 20) -> tuple[DataFrame, DataFrame]:
    """(long histogram source_id, what, label, rows; up to ``examples`` distinct unresolved addresses per source)."""
    source = F.col("provenance.source_id").alias("source_id")
    labels = F.concat(
        F.transform("quality_flags", lambda x: F.struct(F.lit("flag").alias("what"), x.alias("label"))),
        F.array(F.struct(F.lit("address_match").alias("what"), F.col("address.match").alias("label"))),
        F.array(F.struct(F.lit("exclusion").alias("what"), reason.alias("label"))),
    )
    long = canonical.select(source, F.inline(labels)).where(F.col("label").isNotNull())
    histogram = long.groupBy("source_id", "what", "label").agg(F.count("*").alias("rows"))
    unresolved = (
        canonical.where(F.col("address.match") != "unique_exact_registry_name")
        .select(source, F.col("address.as_published").alias("address"))
        .distinct()
    )
    w = Window.partitionBy("source_id").orderBy("address")
    kept = unresolved.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= examples)
    return histogram, kept.groupBy("source_id").agg(F.array_sort(F.collect_list("address")).alias("examples"))


def overlapping_sources(sources: DataFrame) -> DataFrame:
    """Sources whose interval meets an earlier one of the same kind and province, or whose file hash repeats.

    One ordered pass per (kind, province) compares each start with the
    furthest end seen so far; intervals are never paired.  Sources are file
    metadata, one row per delivered file.
    """
    order = Window.partitionBy("kind", "sido").orderBy("start", "end", "source_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    same_hash = sources.where(F.col("sha256").isNotNull()).groupBy("sha256").agg(F.count("*").alias("_copies"))
    judged = (
        sources.withColumn("_reach", F.max(F.struct("end", "source_id")).over(before))
        .join(same_hash, "sha256", "left")
        .withColumn("overlaps_with", F.when(F.col("start") <= F.col("_reach.end"), F.col("_reach.source_id")))
        .withColumn("repeated_file", F.coalesce(F.col("_copies") > 1, F.lit(False)))
    )
    return judged.where(F.col("overlaps_with").isNotNull() | F.col("repeated_file")).drop("_reach", "_copies")


def missing_partitions(partitions: DataFrame, regions: DataFrame, first: str, last: str) -> DataFrame:
    """(month, region) cells of the full grid that are absent or present more than once."""
    months = F.sequence(cal.as_date(first), cal.as_date(last), F.expr("interval 1 month"))
    grid = regions.select("region", F.explode(months).alias("m"))
    grid = grid.select("region", F.date_format("m", "yyyy-MM").alias("month"))
    present = partitions.groupBy("month", "region").agg(F.count("*").alias("copies"))
    judged = grid.join(present, ["month", "region"], "left").fillna(0, subset=["copies"])
    return judged.where(F.col("copies") != 1)


def sale_owner(province: Column, date: Column, replaced: bool, capital: str, provinces: Sequence[str]) -> Column:
    """Which source owns a sale; disjoint by construction, null outside every scope.

    2006–2020 of the capital and 2021–2025 belong to the existing files; the
    other provinces' 2006–2020 and, when replaced, 2026 belong to the exports.
    """
    between = lambda a, b: date.between(cal.as_date(a), cal.as_date(b))
    owner = (
        F.when(between("2006-01-01", "2020-12-31"), F.when(province == capital, "existing_history").otherwise("csv"))
        .when(between("2021-01-01", "2025-12-31"), "existing_recent")
        .when(between("2026-01-01", "2026-12-31"), "csv" if replaced else "existing_recent")
    )
    return F.when(province.isin(*provinces), owner)


def row_hash(df: DataFrame, columns: Sequence[str] | None = None, out: str = "row_hash") -> DataFrame:
    """SHA-256 of the row's canonical JSON, columns in name order."""
    names = sorted(columns or df.columns)
    body = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    return df.withColumn(out, F.sha2(body, 256))


def partition_digest(df: DataFrame, partition: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Order-insensitive digest: row count and the decimal sum of 60-bit row hashes."""
    hashed = row_hash(df, columns, "_h")
    number = F.conv(F.substring("_h", 1, 15), 16, 10).cast("decimal(20,0)")
    return hashed.groupBy(*partition).agg(F.count("*").alias("rows"), F.sum(number).cast("string").alias("digest"))


def same_multiset(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose multiplicity differs between the frames; empty when they agree."""
    names = a.columns
    counted = a.withColumn("_n", F.lit(1)).unionByName(b.select(*names).withColumn("_n", F.lit(-1)))
    return counted.groupBy(*names).agg(F.sum("_n").alias("difference")).where(F.col("difference") != 0)


def coverage(types: DataFrame, regions: DataFrame, period: str = "bucket") -> DataFrame:
    """Trades represented by types against the regions' own counts, per period."""
    represented = types.groupBy(period).agg(F.sum("n").alias("represented_trades"), F.count("*").alias("available_types"))
    source = regions.groupBy(period).agg(F.sum("n").alias("source_trades"))
    joined = source.join(represented, period, "left").fillna(0, subset=["represented_trades", "available_types"])
    return joined.withColumns(
        {
            "unrepresented_trades": F.col("source_trades") - F.col("represented_trades"),
            "complete": F.col("source_trades") == F.col("represented_trades"),
        }
    )


def province_year_audit(trades: DataFrame, province: str = "gu") -> DataFrame:
    types = trades.groupBy(province, "year", "key").agg(F.count("*").alias("_n"), F.first("complex").alias("complex"))
    complexes = types.groupBy(province, "year", "complex").agg(F.sum("_n").alias("_n"), F.count("*").alias("_types"))
    return complexes.groupBy(province, "year").agg(
        F.sum("_n").alias("used_rows"), F.sum("_types").alias("exact_types"), F.count("*").alias("complexes")
    )


def boundary_flags(trades: DataFrame, rules: Mapping[str, tuple[Sequence[str], str | None, str | None]], code: str = "gu") -> DataFrame:
    """Rows and types touched by each known boundary issue.

    A rule is (codes, first date or None, last date or None), both inclusive.
    """
    tests = []
    for issue, (codes, first, last) in rules.items():
        hit = F.col(code).isin(*codes)
        if first:
            hit = hit & (F.col("date") >= cal.as_date(first))
        if last:
            hit = hit & (F.col("date") <= cal.as_date(last))
        tests.append(F.when(hit, F.lit(issue)))
    flagged = trades.select("key", F.explode(P.present(*tests)).alias("issue"))
    per_type = flagged.groupBy("issue", "key").agg(F.count("*").alias("_n"))
    return per_type.groupBy("issue").agg(F.sum("_n").alias("rows"), F.count("*").alias("exact_types"))


def key_continuity(trades: DataFrame, year: int, province: str = "gu") -> DataFrame:
    """Of the types traded from ``year`` on, how many already existed before it."""
    life = trades.groupBy(province, "key").agg(F.max("year").alias("_last"), F.min("year").alias("_first"))
    return life.where(F.col("_last") >= year).groupBy(province).agg(
        F.count("*").alias("recent_exact_types"),
        F.count_if(F.col("_first") < year).alias("same_key_existed_before"),
    )


def profile(rows: DataFrame, columns: Sequence[str], entity: str, day: str) -> DataFrame:
    """Per month: rows, mean and largest JSON size, entities and duplicated (entity, day) rows."""
    size = F.octet_length(F.to_json(F.struct(*sorted(columns))))
    base = rows.select(
        F.substring(day, 1, 7).alias("month"), F.col(entity).alias("_e"), F.col(day).alias("_d"), size.alias("_size")
    )
    cells = base.groupBy("month", "_e", "_d").agg(
        F.count("*").alias("_n"), F.sum("_size").alias("_bytes"), F.max("_size").alias("_max")
    )
    return cells.groupBy("month").agg(
        F.sum("_n").alias("rows"),
        (F.sum("_bytes") / F.sum("_n")).alias("mean_json_bytes"),
        F.max("_max").alias("max_json_bytes"),
        F.sum(F.col("_n") - 1).alias("duplicate_entity_days"),
        F.count_distinct("_e").alias("entities"),
    )


def check_training(frame: DataFrame, through: str, first: str = "2007-01-01") -> DataFrame:
    """Counts of rows that may not be trained on, by rule; all zero when the frame is eligible."""
    month = F.to_date(F.concat("month", F.lit("-01")))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    in_scope = (month >= cal.as_date(first)) & (F.last_day(month) <= cal.as_date(through))
    in_time = F.col("feature_cutoff").cast("date") <= F.date_sub(month, cal.NEW_LAG)
    valid = finite("actual") & finite("anchor") & finite("area") & (F.col("area") > 0)
    bad = lambda c: F.count_if(~F.coalesce(c, F.lit(False)))
    return frame.agg(
        F.count("*").alias("rows"),
        bad(in_scope).alias("outside_months"),
        bad(in_time).alias("cutoff_breaches"),
        bad(valid).alias("invalid_values"),
    )


# What a panel may declare itself to be, by its kind, and the evidence of rows (fixed values).
AVAILABILITY = {"historical_research": ("strict_observed", "reconstructed_lag_scenario"), "synthetic_fixture": ("synthetic",)}
SYNTHETIC, ARCHIVED = "synthetic", "observed_archive"
QUOTE_EVIDENCE = (SYNTHETIC, "archived_offer", "transaction_proxy")


def validate_panel(observations: DataFrame, quotes: DataFrame, kind: str = "historical_research", mode: str = "strict_observed") -> DataFrame:
    """One row per (source, rule) with the number of violating rows of a decision panel.

    ``kind`` and ``mode`` are the panel's declarations: history never claims
    synthetic availability, and strict history holds archived observations only.
    """
    if mode not in AVAILABILITY.get(kind, ()):
        raise ValueError(f"a panel of kind {kind} cannot have {mode} availability")
    unknown = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    digest = F.coalesce((F.length("source_sha256") == 64) & (F.translate("source_sha256", "0123456789abcdef", "") == ""), F.lit(False))
    other = lambda *allowed: ~F.coalesce(F.col("evidence_kind").isin(*allowed), F.lit(False))

    def counts(df: DataFrame, name: str, identity: str, extra: Mapping[str, Column]) -> DataFrame:
        rules = {
            "missing_identity": unknown("asset_id") | unknown(identity),
            "missing_source": unknown("source_id"),
            "malformed_source_hash": ~digest,
            "price_not_positive": ~F.coalesce(F.col("price_krw") > 0, F.lit(False)),
            "observed_after_available": ~F.coalesce(F.col("observed_at") <= F.col("available_at"), F.lit(False)),
            "synthetic_row_in_history": F.lit(kind == "historical_research") & F.col("evidence_kind").eqNullSafe(F.lit(SYNTHETIC)),
            **extra,
        }
        wide = df.agg(*[F.count_if(c).alias(rule) for rule, c in rules.items()])
        long = wide.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("rows")) for r in rules])))
        copies = df.groupBy(identity).agg(F.count("*").alias("_n")).agg(
            F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("rows")
        )
        both = long.unionByName(copies.select(F.lit("duplicate_id").alias("rule"), "rows"))
        return both.withColumn("source", F.lit(name))

    score = F.col("score")
    return counts(
        observations,
        "observations",
        "observation_id",
        {
            "score_not_finite": score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")),
            "missing_model_version": unknown("model_version"),
            "missing_feature_time": F.col("max_feature_available_at").isNull() | F.col("max_training_label_available_at").isNull(),
            "not_archived": F.lit(mode == "strict_observed") & other(ARCHIVED),
        },
    ).unionByName(
        counts(
            quotes,
            "quotes",
            "quote_id",
            {
                "unknown_side": ~F.coalesce(F.col("side").isin("buy", "sell"), F.lit(False)),
                "expired_before_available": ~F.coalesce(F.col("valid_until") >= F.col("available_at"), F.lit(False)),
                "undeclared_evidence": other(*QUOTE_EVIDENCE),
            },
        )
    )


def validate_months(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest months whose artifact has another row count or rows of another month."""
    actual = rows.groupBy("month").agg(
        F.count("*").alias("actual_rows"), F.count_if(F.substring("day", 1, 7) != F.col("month")).alias("foreign_rows")
    )
    judged = manifest.select("month", F.col("rows").alias("declared_rows")).join(actual, "month", "full_outer")
    judged = judged.fillna(0, subset=["declared_rows", "actual_rows", "foreign_rows"])
    return judged.where((F.col("declared_rows") != F.col("actual_rows")) | (F.col("foreign_rows") > 0))


def validate_forecast(forecast: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Is the published rank a complete permutation over unique, valid candidates?

    A sum, a sum of squares, minimum, maximum and distinct count identify
    1..n without sorting the candidates.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    valid = finite("area") & finite("entry") & (F.col("entry_n") >= 3) & (F.col("area") > 0)
    rank = F.col("research_rank").cast("decimal(20,0)")
    stats = forecast.groupBy(*scope, "key").agg(
        F.count("*").alias("_copies"), F.sum(rank).alias("_rank"), F.min(rank).alias("_lo"), F.max(rank).alias("_hi"),
        F.count_if(~valid).alias("_bad"),
    )
    n = F.sum("_copies").cast("decimal(20,0)")
    return stats.groupBy(*scope).agg(
        F.sum("_copies").alias("candidates"),
        (F.sum("_copies") - F.count("*")).alias("duplicate_keys"),
        ((F.min("_lo") == 1) & (F.max("_hi") == n) & (F.sum("_rank") == n * (n + 1) / 2)
         & (F.count_distinct("_rank") == n)).alias("ranks_complete"),
        F.sum("_bad").alias("invalid_rows"),
    )


def validate_routes(routes: DataFrame, purposes: Sequence[str] = ("station", "school", "bus_stop")) -> DataFrame:
    """Violations per rule of reviewed walking routes: totals, times, status fields and one route per purpose."""
    close = lambda a, b: F.abs(a - b) < 1e-7
    d, t = F.col("distance"), F.col("time")
    connected = F.col("status") == "assumed_connector_total"
    broken = F.col("status") == "disconnected"
    total = d["origin_m"] + d["network_m"] + d["destination_m"]
    not_ = lambda c: ~F.coalesce(c, F.lit(False))
    rules = {
        "unknown_status": ~(connected | broken),
        "unknown_purpose": ~F.col("purpose").isin(*purposes),
        "total_differs_from_parts": connected & not_(close(d["total_m"], total)),
        "time_differs_from_speed": connected
        & not_(close(t["base_min"], d["total_m"] / 80) & close(t["fast_min"], d["total_m"] / 90) & close(t["slow_min"], d["total_m"] / 60)),
        "disconnected_has_values": broken & (d["total_m"].isNotNull() | t["base_min"].isNotNull()),
    }
    wide = routes.agg(*[F.count_if(c).alias(r) for r, c in rules.items()])
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations")) for r in rules])))
    per = routes.groupBy("complex_id").agg(F.count("*").alias("_n"), F.count_distinct("purpose").alias("_p"))
    odd = per.agg(F.count_if((F.col("_n") != len(purposes)) | (F.col("_p") != len(purposes))).alias("violations"))
    ids = routes.groupBy("id").agg(F.count("*").alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("violations"))
    return long.unionByName(odd.select(F.lit("one_route_per_purpose").alias("rule"), "violations")).unionByName(
        ids.select(F.lit("duplicate_route_id").alias("rule"), "violations")
    )
