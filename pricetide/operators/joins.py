"""Lookup, nearest-point, validity and identity joins.

No side is broadcast by hint: Spark broadcasts what its statistics (or the
finished shuffle) show to be below the configured threshold, and otherwise
sort-merges with skew splitting.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions import parsing as P
from pricetide.operators.stats import Quantile, quantiles, ranked_within

EARTH_RADIUS_M = 6371000.0
EARTH_RADIUS_KM = 6371.0


def unique_lookup(right: DataFrame, keys: Sequence[str], message: str) -> DataFrame:
    """The right side with one row per key; a key present twice raises when it is read."""
    rest = [c for c in right.columns if c not in keys]
    grouped = right.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_r"))
    checked = F.when(F.col("_n") == 1, F.col("_r")).otherwise(F.raise_error(F.lit(message)).cast(grouped.schema["_r"].dataType))
    return grouped.select(*keys, checked.alias("_r")).select(*keys, "_r.*")


def join_snapshot(df: DataFrame, snapshot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Many-to-one left join; duplicate snapshot keys raise instead of multiplying rows."""
    return df.join(unique_lookup(snapshot, keys, "snapshot keys are not unique"), list(keys), "left")


def map_region(df: DataFrame, legal: DataFrame, static: DataFrame, full_code: str, district: str, dong: str, gu_code: str,
               own_code: Column) -> DataFrame:
    """Set of map codes: by full legal code, else by (district, dong) name, else the static district code, else its own.

    ``legal`` has legal_code, admin_code, district_name, dong_name; ``static`` has gu_code, stat_code.
    """
    codes = lambda keys: legal.where(F.col("admin_code") != "").groupBy(*keys).agg(
        F.array_sort(F.collect_set("admin_code")).alias("_codes")
    )
    by_code = codes(["legal_code"]).select(F.col("legal_code").alias("_lc"), F.col("_codes").alias("_by_code"))
    by_name = codes(["district_name", "dong_name"]).select(
        F.col("district_name").alias("_dn"), F.col("dong_name").alias("_on"), F.col("_codes").alias("_by_name")
    )
    fixed = unique_lookup(static, ["gu_code"], "district listed twice").select(
        F.col("gu_code").alias("_gc"), F.col("stat_code").alias("_stat")
    )
    out = (
        df.join(by_code, F.col(full_code) == F.col("_lc"), "left")
        .join(by_name, (F.col(district) == F.col("_dn")) & (F.col(dong) == F.col("_on")), "left")
        .join(fixed, F.col(gu_code) == F.col("_gc"), "left")
    )
    fallback = F.array(F.coalesce("_stat", own_code))
    return out.withColumn("map_codes", F.coalesce("_by_code", "_by_name", fallback)).drop(
        "_lc", "_by_code", "_dn", "_on", "_by_name", "_gc", "_stat"
    )


def join_complex_info(df: DataFrame, info: DataFrame, names: Sequence[str], order: str, district: str, dong: str,
                      building: str, carried: Sequence[str]) -> DataFrame:
    """Complex attributes by (district, dong, normalised name); any of the alternative names matches, the last row wins."""
    candidates = F.array_distinct(F.array(*[P.normalize_name(F.coalesce(F.col(n), F.lit(""))) for n in names]))
    table = (
        info.withColumn("_name", F.explode(candidates))
        .where(F.col("_name") != "")
        .groupBy(F.col("district").alias("_d"), F.col("dong").alias("_o"), "_name")
        .agg(F.max_by(F.struct(*carried), order).alias("_i"))
    )
    keyed = df.withColumns({"_d": P.last_token(F.col(district)), "_o": F.trim(dong), "_name": P.normalize_name(F.col(building))})
    joined = keyed.join(table, ["_d", "_o", "_name"], "left")
    return joined.select("*", *[F.col("_i")[c].alias(f"info_{c}") for c in carried]).drop("_d", "_o", "_name", "_i")


def join_details(df: DataFrame, details: DataFrame, code: str, building: str, carried: Sequence[str], order: str) -> DataFrame:
    """Detail record on (five-digit district code, normalised name); the last delivered row wins."""
    table = (
        details.select(F.substring("bjd_code", 1, 5).alias("_c"), P.normalize_name(F.col("apt_nm")).alias("_n"), order, *carried)
        .where((F.col("_c") != "") & (F.col("_n") != ""))
        .groupBy("_c", "_n")
        .agg(F.max_by(F.struct(*carried), order).alias("_i"))
    )
    keyed = df.withColumns({"_c": F.col(code), "_n": P.normalize_name(F.col(building))})
    joined = keyed.join(table, ["_c", "_n"], "left")
    return joined.select("*", *[F.col("_i")[c].alias(c) for c in carried]).drop("_c", "_n", "_i")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS_M) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    h = F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))
    return radius * 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def nearest(points: DataFrame, targets: DataFrame, cell: float = 0.01, reach: int = 2, name: str = "name") -> DataFrame:
    """Nearest target within ±``reach`` grid cells of each point (lat, lon); null when there is none.

    Both sides are first reduced to distinct coordinates, so the candidates of
    a crowded cell are bounded by the coordinate precision, not by its rows.
    Equal distances keep the smaller name.
    """
    grid = lambda c: F.floor(F.col(c) / cell).cast("int")
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    offsets = F.array(*[F.lit(i) for i in range(-reach, reach + 1)])
    spots = points.where(known).select("lat", "lon").distinct()
    spread = (
        spots.withColumn("_i", F.explode(offsets))
        .withColumn("_j", F.explode(offsets))
        .select("lat", "lon", (grid("lat") + F.col("_i")).alias("_x"), (grid("lon") + F.col("_j")).alias("_y"))
    )
    places = targets.where(known).groupBy("lat", "lon").agg(F.min(name).alias(name)).select(
        F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), name, grid("lat").alias("_x"), grid("lon").alias("_y")
    )
    met = spread.join(places, ["_x", "_y"]).withColumn(
        "_m", haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    )
    best = met.groupBy("lat", "lon").agg(F.min(F.struct("_m", name)).alias("_best"))
    out = points.join(best, ["lat", "lon"], "left")
    return out.withColumns({"nearest_name": F.col("_best")[name], "nearest_m": F.col("_best._m")}).drop("_best")


def access_features(df: DataFrame, hubs: Mapping[str, tuple[float, float]], jobs: Mapping[str, float]) -> DataFrame:
    """Kilometres to each fixed hub and the job-gravity access ``log1p(Σ jobs·exp(−km/10))``."""
    km = {
        f"km_{h}": haversine(F.col("lat"), F.col("lon"), F.lit(a), F.lit(b), EARTH_RADIUS_KM) for h, (a, b) in hubs.items()
    }
    out = df.withColumns(km)
    pull = sum((F.lit(float(n)) * F.exp(-F.col(f"km_{h}") / 10) for h, n in jobs.items()), F.lit(0.0))
    return out.withColumn("log_partial_jobs_access", F.log1p(pull))


def join_coordinates(identity: DataFrame, snapshot: DataFrame, match: str = "match") -> DataFrame:
    """Coordinates per complex, only where the match key names one complex and built years do not conflict.

    ``identity`` has match, region, complex, built; ``snapshot`` has match,
    built_year, latitude, longitude.
    """
    complexes = identity.groupBy(match).agg(F.count_distinct("complex").alias("_n"))
    lat, lon = F.col("latitude"), F.col("longitude")
    found = (
        identity.join(complexes.where(F.col("_n") == 1), match)
        .join(unique_lookup(snapshot, [match], "coordinate key listed twice"), match)
        .where(F.col("built").isNull() | F.col("built_year").isNull() | (F.col("built") == F.col("built_year")))
        .where(lat.between(33, 39) & lon.between(125, 130))
    )
    return found.groupBy("region", "complex").agg(
        F.min(F.struct("latitude", "longitude")).alias("_p")
    ).select("region", "complex", "_p.latitude", "_p.longitude")


def fill_amenities(types: DataFrame, snapshot: DataFrame, fields: Sequence[str], scope: Sequence[str], built_at: str) -> DataFrame:
    """Fill only missing fields from an older snapshot, where the name is unique in its region.

    A conflicting built year never matches; filled rows carry their provenance.
    """
    unique = types.groupBy(*scope, "building_name").agg(F.count_distinct("complex_key").alias("_names"))
    old = unique_lookup(snapshot, [*scope, "building_name"], "amenity key listed twice")
    old = old.select(*scope, "building_name", F.struct(*[c for c in old.columns if c not in (*scope, "building_name")]).alias("_old"))
    joined = types.join(unique, [*scope, "building_name"], "left").join(old, [*scope, "building_name"], "left")
    conflict = F.coalesce(F.col("built_year") != F.col("_old.built_year"), F.lit(False))
    usable = F.col("_old").isNotNull() & (F.col("_names") == 1) & ~conflict
    filled = {c: F.when(usable, F.coalesce(F.col(c), F.col("_old")[c])).otherwise(F.col(c)) for c in fields}
    return joined.withColumns(
        {
            **filled,
            "amenity_source": F.when(usable, "earlier snapshot, same name; check on site"),
            "amenity_snapshot_built_at": F.when(usable, F.lit(built_at)),
        }
    ).drop("_names", "_old")


def apply_households(types: DataFrame, register: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Verified household counts through a reviewed crosswalk; names alone never match.

    The crosswalk (official_id, gu_code, dong_name, complex_key, building_name,
    road_address, approved) must agree on all four parts and the register's
    road address.  Two approved rows for one address raise.
    """
    known = unique_lookup(register, ["official_id"], "duplicate official complex id").withColumnRenamed("road_address", "_road")
    identity = ["gu_code", "dong_name", "complex_key", "building_name"]
    approved = crosswalk.where("approved").join(known, "official_id")
    approved = approved.where((F.col("road_address") == F.col("_road")) & (F.col("whole_complex_households") > 0))
    approved = unique_lookup(
        approved.select(*identity, "official_id", "whole_complex_households"), identity, "ambiguous reviewed address match"
    )
    joined = types.join(approved, identity, "left")
    return joined.withColumns(
        {
            "legacy_households": F.when(F.col("official_id").isNotNull(), F.col("households")),
            "households_verified": F.col("official_id").isNotNull(),
            "households": F.coalesce("whole_complex_households", "households"),
        }
    ).drop("whole_complex_households")


_KST_SHIFT = "interval 9 hours"


def decision_close(day: Column) -> Column:
    """Last microsecond of the Korean calendar day, in UTC."""
    return day.cast("timestamp") + F.expr("interval 15 hours") - F.expr("interval 1 microsecond")


def observations_asof(observations: DataFrame, dates: Sequence[str], max_age_days: int) -> DataFrame:
    """Newest usable observation of each asset at the close of each decision day.

    Usable = itself, its features and its training labels were public, and it
    is not older than ``max_age_days``.  Newest observed wins, then newest
    available, then id.  An observation is copied only to the declared days it
    can serve.
    """
    public = F.greatest("available_at", "max_feature_available_at", "max_training_label_available_at")
    days = F.array(*[F.lit(d).cast("date") for d in dates])
    rows = observations.withColumn("_public", public)
    serves = F.filter(
        days,
        lambda d: (F.col("_public") <= decision_close(d))
        & (decision_close(d) <= F.col("observed_at") + F.make_interval(days=F.lit(max_age_days))),
    )
    order = F.struct("observed_at", "available_at", "observation_id")
    payload = F.struct("observation_id", "price_krw", "score", "observed_at")
    return (
        rows.withColumn("decision_date", F.explode(serves))
        .groupBy("decision_date", "asset_id")
        .agg(F.max_by(payload, order).alias("_o"))
        .select("decision_date", "asset_id", "_o.*")
    )


def quotes_at(orders: DataFrame, quotes: DataFrame, max_age_days: int) -> DataFrame:
    """Newest quote valid at the close of each order's day; null when none is.

    A quote is copied to the days it can serve, at most ``max_age_days`` + 1,
    so the validity join is an equi join on (asset, side, day).
    """
    first = F.to_date(F.col("available_at") + F.expr(_KST_SHIFT))
    tick = F.expr("interval 1 microsecond")
    until = F.date_sub(F.to_date(F.col("valid_until") + F.expr(_KST_SHIFT) + tick), 1)
    fresh = F.date_add(F.to_date(F.col("observed_at") + F.expr(_KST_SHIFT) + tick), max_age_days - 1)
    last = F.least(until, fresh)
    days = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<date>"))
    order = F.struct("observed_at", "available_at", "quote_id")
    usable = (
        quotes.withColumn("order_date", F.explode(days))
        .groupBy("asset_id", "side", "order_date")
        .agg(F.max_by(F.struct("quote_id", "price_krw"), order).alias("_q"))
        .select("asset_id", "side", "order_date", "_q.*")
    )
    return orders.join(usable, ["asset_id", "side", "order_date"], "left")


def occurrence(df: DataFrame, fields: Sequence[str], order: Sequence[Column], out: str = "occurrence") -> DataFrame:
    """1, 2, 3 … inside each group of identical attributes, numbered without gathering the group."""
    return ranked_within(df, fields, order, out)


def multiset_join(a: DataFrame, b: DataFrame, fields: Sequence[str], order_a: Sequence[Column], order_b: Sequence[Column],
                  how: str = "inner") -> DataFrame:
    """One-to-one join of rows without ids: the n-th copy meets the n-th copy.

    Fields are compared null-safely through their JSON form.
    """
    name = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    left = occurrence(a.withColumn("_id", name), ["_id"], order_a)
    right = occurrence(b.withColumn("_id", name).drop(*fields), ["_id"], order_b)
    return left.join(right, ["_id", "occurrence"], how).drop("_id")


def semi(df: DataFrame, keep: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(keep.select(*keys), list(keys), "left_semi")


def anti(df: DataFrame, drop: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(drop.select(*keys), list(keys), "left_anti")


def lag_sensitivity(base: DataFrame, alternate: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Rank of each candidate under the alternate lag scenario and whether both put it in the top decile."""
    other = alternate.select(*keys, F.col("rank").alias("alternate_rank"), F.col("top_percent").alias("alternate_top_percent"))
    joined = base.join(other, list(keys), "left")
    both = (F.col("top_percent") <= 10) & F.coalesce(F.col("alternate_top_percent") <= 10, F.lit(False))
    return joined.withColumns({"alternate_eligible": F.col("alternate_rank").isNotNull(), "both_top_decile": both})


def join_map(features: DataFrame, regions: DataFrame, code: str = "map_code") -> DataFrame:
    """Regions of each map feature: by its full code, else by the five-character prefix."""
    exploded = regions.select(F.explode("map_codes").alias("_c"), "region")
    sets = exploded.groupBy("_c").agg(F.array_sort(F.collect_set("region")).alias("_r"))
    exact = sets.select(F.col("_c").alias("_c1"), F.col("_r").alias("_r1"))
    prefix = sets.select(F.col("_c").alias("_c2"), F.col("_r").alias("_r2"))
    return (
        features.join(exact, F.col(code) == F.col("_c1"), "left")
        .join(prefix, F.substring(code, 1, 5) == F.col("_c2"), "left")
        .withColumn("regions", F.coalesce("_r1", "_r2"))
        .drop("_c1", "_r1", "_c2", "_r2")
    )


def match_offers(types: DataFrame, offers: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """The one offer type whose private-area range holds a type's area; ambiguous matches give nothing.

    Offers are copied to the whole square metres they span, so the range join
    is an equi join on (complex, square metre).
    """
    low, high = F.col("min_area") - tolerance, F.col("max_area") + tolerance
    spread = offers.withColumn("_m", F.explode(F.sequence(F.floor(low), F.floor(high))))
    keyed = types.withColumn("_m", F.floor("area"))
    met = keyed.join(spread, ["complex", "_m"]).where((F.col("area") >= low) & (F.col("area") <= high))
    single = met.groupBy("complex", "key").agg(F.count("*").alias("_n"), F.max("offer_id").alias("offer_id"), F.max("ask").alias("ask"))
    return types.join(single.where(F.col("_n") == 1).drop("_n"), ["complex", "key"], "left")


def asking_by_supply(offers: DataFrame, today: str, max_age_days: int = 30, buckets: Sequence[int] = (20, 30, 40)) -> DataFrame:
    """Lowest recent ask per complex and supply-area bucket (20s, 30s, 40s 평)."""
    age = F.datediff(F.lit(today).cast("date"), "offer_date")
    bucket = (F.floor(F.col("supply") / 10) * 10).cast("int")
    rows = offers.where(age.between(0, max_age_days)).withColumn("bucket", bucket).where(F.col("bucket").isin(*buckets))
    return rows.groupBy("complex", "bucket").agg(F.min("ask").alias("lowest_ask"))


def area_inversions(df: DataFrame, group: str, area: str, value: str) -> DataFrame:
    """Comparable area pairs (ratio 1.1–1.5) per run and how often the larger total is at least 5 % lower.

    Rows are reduced to one median total per (group, area) first; pairs exist
    only between neighbouring bands of that reduced table and are counted, not
    kept.
    """
    mids = quantiles(df, [group, area], value, {"_t": Quantile(0.5)}).select(group, F.col(area).alias("_a"), "_t")
    band = F.floor(F.ln("_a") / F.ln(F.lit(1.5)))
    larger = mids.select(group, F.col("_a").alias("_big"), F.col("_t").alias("_big_t"), F.explode(F.array(band, band - 1)).alias("_b"))
    smaller = mids.select(group, F.col("_a").alias("_small"), F.col("_t").alias("_small_t"), band.alias("_b"))
    pairs = larger.join(smaller, [group, "_b"]).where((F.col("_big") / F.col("_small")).between(1.1, 1.5))
    return pairs.agg(
        F.count("*").alias("comparable_pairs"),
        F.count_if(F.col("_big_t") < F.col("_small_t") * 0.95).alias("larger_total_at_least_5pct_lower"),
    )
