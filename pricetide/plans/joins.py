"""Join queries and the annual reference."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetide.operators import annual
from pricetide.operators import joins as ops
from pricetide.operators.stats import Quantile, crowded, median, quantiles_with
from pricetide.plans.history import tidy
from pricetide.plans.registry import query
from pricetide.session import durable, stored
from pricetide.sources.domain import clean, table, trades, with_trades

LEGAL = """
SELECT CAST(s_suppkey AS STRING) AS legal_code, 'A' || CAST(s_suppkey % 30 AS STRING) AS admin_code, r_name AS district_name, n_name AS dong_name
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE s_acctbal > 2000
"""
TABLES = ("supplier", "nation", "region", "part", "customer", "events")


def _sql(spark, sf_dir, text, **extra):
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used, **extra)


def _plain(text, **extra):
    return text.format(**{t: t for t in TABLES}, **extra)


@query(
    "jn2_map_region",
    with_trades(
        f", l AS ({_plain(LEGAL)})"
        + """, t AS (SELECT complex, gu, CASE WHEN CAST(complex AS BIGINT) % 2 = 0 THEN dong ELSE 'other' END AS dong, count(*) AS n FROM trades GROUP BY ALL),
st AS (SELECT DISTINCT r_name AS gu_code, 'S' || r_regionkey AS stat_code FROM region WHERE r_regionkey <> 2),
c AS (SELECT legal_code, list_sort(list(DISTINCT admin_code)) AS codes FROM l GROUP BY 1),
d AS (SELECT district_name, dong_name, list_sort(list(DISTINCT admin_code)) AS codes FROM l GROUP BY 1, 2)
SELECT complex, gu, t.dong, n, array_to_string(coalesce(c.codes, d.codes, [coalesce(stat_code, gu || ':' || t.dong)]), ',') AS map_codes
FROM t LEFT JOIN c ON c.legal_code = t.complex LEFT JOIN d ON d.district_name = t.gu AND d.dong_name = t.dong LEFT JOIN st ON st.gu_code = t.gu"""
    ),
)
def map_region(spark, sf_dir):
    kept = F.when(F.col("complex").cast("long") % 2 == 0, F.col("dong")).otherwise("other")
    types = trades(spark, sf_dir).groupBy("complex", "gu", kept.alias("dong")).agg(F.count("*").alias("n"))
    static = table(spark, sf_dir, "region").where("r_regionkey <> 2").select(
        F.col("r_name").alias("gu_code"), F.concat(F.lit("S"), F.col("r_regionkey").cast("string")).alias("stat_code")
    )
    own = F.concat_ws(":", "gu", "dong")
    out = ops.map_region(types, _sql(spark, sf_dir, LEGAL), static, "complex", "gu", "dong", "gu", own)
    return out.withColumn("map_codes", F.array_join("map_codes", ","))


INFO = """
SELECT p_partkey AS row_no, 'X ' || p_type AS district_text, p_type AS district, p_brand AS dong, p_name AS name_a, upper(p_name) || ' Apt' AS name_b,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name || '-' || CAST(p_size AS STRING) END AS name_c, p_size * 10 AS households, 1980 + p_size AS approved FROM {part}
"""


@query(
    "jn3_complex_info",
    f"""WITH i AS ({_plain(INFO)}),
k AS (SELECT row_no, district, dong, households, approved, unnest(list_distinct([regexp_replace(lower(name_a), '[^a-z0-9]', '', 'g'),
    regexp_replace(lower(name_b), '[^a-z0-9]', '', 'g'), regexp_replace(lower(name_c), '[^a-z0-9]', '', 'g')])) AS name FROM i),
b AS (SELECT district, dong, name, arg_max(households, row_no) AS h, arg_max(approved, row_no) AS a FROM k WHERE name <> '' GROUP BY ALL)
SELECT row_no, CAST(h AS BIGINT) AS info_households, CAST(a AS BIGINT) AS info_approved FROM i LEFT JOIN b ON b.district = i.district AND b.dong = i.dong
  AND b.name = regexp_replace(lower(i.name_a), '[^a-z0-9]', '', 'g')""",
)
def complex_info(spark, sf_dir):
    info = _sql(spark, sf_dir, INFO)
    out = ops.join_complex_info(
        info.select("row_no", "district_text", F.col("dong").alias("dong_name"), F.upper("name_a").alias("building")),
        info, ["name_a", "name_b", "name_c"], "row_no", "district_text", "dong_name", "building", ["households", "approved"],
    )
    return tidy(out.select("row_no", "info_households", "info_approved"))


DETAILS = """
SELECT p_partkey AS row_no, lpad(CAST(p_size AS STRING), 5, '1') || '00000' AS bjd_code, p_name || ' ' || p_brand AS apt_nm,
  p_type AS subway_line, p_retailprice AS subway_m FROM {part}
"""


@query(
    "jn4_details",
    f"""WITH d AS ({_plain(DETAILS)}),
b AS (SELECT substr(bjd_code, 1, 5) AS c, regexp_replace(lower(apt_nm), '[^a-z0-9]', '', 'g') AS n, arg_max(subway_line, row_no) AS subway_line,
  arg_max(subway_m, row_no) AS subway_m FROM d GROUP BY ALL)
SELECT row_no, b.subway_line, b.subway_m FROM d LEFT JOIN b ON c = substr(bjd_code, 1, 5) AND n = regexp_replace(lower(apt_nm), '[^a-z0-9]', '', 'g')""",
)
def details(spark, sf_dir):
    rows = _sql(spark, sf_dir, DETAILS)
    types = rows.select("row_no", F.substring("bjd_code", 1, 5).alias("code"), F.upper("apt_nm").alias("building"))
    out = ops.join_details(types, rows.withColumnRenamed("row_no", "at"), "code", "building", ["subway_line", "subway_m"], "at")
    return out.select("row_no", "subway_line", "subway_m")


POINTS = "SELECT c_custkey AS id, 37.4 + (c_custkey * 7919 % 1000) / 5000.0 AS lat, 126.8 + (c_custkey * 104729 % 1000) / 5000.0 AS lon FROM {customer}"
TARGETS = "SELECT s_name AS name, 37.4 + (s_suppkey * 6007 % 1000) / 5000.0 AS lat, 126.8 + (s_suppkey * 7001 % 1000) / 5000.0 AS lon FROM {supplier}"


def _points(spark, sf_dir):
    return _sql(spark, sf_dir, POINTS).withColumns({c: F.col(c).cast("double") for c in ("lat", "lon")})


def _targets(spark, sf_dir):
    return _sql(spark, sf_dir, TARGETS).withColumns({c: F.col(c).cast("double") for c in ("lat", "lon")})




@query(
    "jn5_nearest",
    f"""WITH a AS (SELECT id, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM ({_plain(POINTS)})),
b AS (SELECT name, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM ({_plain(TARGETS)})),
m AS (SELECT a.id, b.name, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h
  FROM a JOIN b ON abs(floor(a.lat / 0.01) - floor(b.lat / 0.01)) <= 2 AND abs(floor(a.lon / 0.01) - floor(b.lon / 0.01)) <= 2),
d AS (SELECT id, name, 6371000.0 * 2 * atan2(sqrt(h), sqrt(1 - h)) AS m FROM m),
best AS (SELECT id, arg_min(name, (m, name)) AS nearest_name, min(m) AS nearest_m FROM d GROUP BY id)
SELECT a.id, nearest_name, round(nearest_m, 4) AS nearest_m FROM a LEFT JOIN best USING (id)""",
)
def nearest(spark, sf_dir):
    out = ops.nearest(_points(spark, sf_dir), _targets(spark, sf_dir))
    return out.select("id", "nearest_name", F.round("nearest_m", 4).alias("nearest_m"))


# Representative points and employment counts of the access study (fixed values).
HUBS = {
    "city_hall": (37.566, 126.978), "yeouido": (37.521, 126.924), "gangnam": (37.498, 127.028), "gasan": (37.481, 126.882),
    "pangyo": (37.395, 127.111), "songdo": (37.389, 126.644), "cheongna": (37.532, 126.640), "yeongjong": (37.487, 126.493),
    "namdong": (37.405, 126.690), "bupyeong": (37.507, 126.722),
}
JOBS = {"songdo": 61922, "yeongjong": 22879, "cheongna": 11840}


def _d_km(a, b):
    return (
        f"6371.0 * 2 * asin(sqrt(pow(sin((radians({a}) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians({a})) * "
        f"pow(sin(radians({b} - lon) / 2), 2)))"
    )


@query(
    "jn6_access_features",
    f"""WITH a AS (SELECT id, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM ({_plain(POINTS)}))
SELECT id, {', '.join(f'round({_d_km(*p)}, 6) AS km_{h}' for h, p in HUBS.items())},
  round(ln(1 + {' + '.join(f'{n} * exp(-({_d_km(*HUBS[h])}) / 10)' for h, n in JOBS.items())}), 6) AS log_partial_jobs_access FROM a""",
)
def access_features(spark, sf_dir):
    return tidy(ops.access_features(_points(spark, sf_dir), HUBS, JOBS).drop("lat", "lon"))


COORDS = """
SELECT p_type || '|' || p_name AS match, max(1980 + p_partkey % 15) AS built_year, max(36.0 + p_partkey % 5) AS latitude, max(126.0 + p_partkey % 6) AS longitude
FROM {part} GROUP BY p_type || '|' || p_name
"""
IDENTITY = """
SELECT p_type || '|' || p_name AS match, p_type AS region, CASE WHEN p_size > 25 THEN p_name ELSE p_name || ' ' || p_type END AS complex,
  CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 1980 + p_partkey % 15 END AS built FROM {part} WHERE p_size > 25 OR p_type <> 'PROMO'
"""


@query(
    "jn7_coordinates",
    f"""WITH s AS ({_plain(COORDS)}), i AS ({_plain(IDENTITY)}),
u AS (SELECT match FROM i GROUP BY match HAVING count(DISTINCT complex) = 1)
SELECT DISTINCT region, complex, CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude FROM i JOIN u USING (match) JOIN s USING (match)
WHERE (built IS NULL OR built = built_year) AND latitude BETWEEN 33 AND 39 AND longitude BETWEEN 125 AND 130""",
)
def coordinates(spark, sf_dir):
    out = ops.join_coordinates(_sql(spark, sf_dir, IDENTITY), _sql(spark, sf_dir, COORDS))
    return out.withColumns({c: F.col(c).cast("double") for c in ("latitude", "longitude")})


TYPES = """
SELECT p_partkey, p_type AS sido, p_brand AS dong, p_name AS building_name, p_name || CASE WHEN p_size > 45 THEN 'B' ELSE 'A' END AS complex_key,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE 1980 + p_size END AS built_year, CASE WHEN p_size % 2 = 0 THEN p_size END AS households,
  CASE WHEN p_size % 5 = 0 THEN 'st' END AS subway_station FROM {part}
"""
AMENITIES = """
SELECT p_type AS sido, p_brand AS dong, p_name AS building_name, max(1980 + p_size) AS built_year, max(p_size) * 7 AS households, min(p_brand) AS subway_station
FROM {part} GROUP BY p_type, p_brand, p_name
"""


@query(
    "jn8_fill_amenities",
    f"""WITH t AS ({_plain(TYPES)}), s AS ({_plain(AMENITIES)}),
u AS (SELECT sido, dong, building_name FROM t GROUP BY ALL HAVING count(DISTINCT complex_key) = 1),
j AS (SELECT t.*, u.sido IS NOT NULL AND s.sido IS NOT NULL AND (t.built_year IS NULL OR s.built_year IS NULL OR t.built_year = s.built_year) AS ok,
  s.households AS h, s.subway_station AS st FROM t LEFT JOIN u USING (sido, dong, building_name) LEFT JOIN s USING (sido, dong, building_name))
SELECT p_partkey, CAST(CASE WHEN ok THEN coalesce(households, h) ELSE households END AS BIGINT) AS households,
  CASE WHEN ok THEN coalesce(subway_station, st) ELSE subway_station END AS subway_station,
  CASE WHEN ok THEN '2026-09-01' END AS amenity_snapshot_built_at FROM j""",
)
def fill_amenities(spark, sf_dir):
    out = ops.fill_amenities(
        _sql(spark, sf_dir, TYPES), _sql(spark, sf_dir, AMENITIES), ["households", "subway_station"], ["sido", "dong"], "2026-09-01"
    )
    return tidy(out.select("p_partkey", "households", "subway_station", "amenity_snapshot_built_at"))


HOUSEHOLD_TYPES = "SELECT p_partkey, p_type AS gu_code, p_brand AS dong_name, CAST(p_partkey AS STRING) AS complex_key, p_name AS building_name, p_size AS households FROM {part}"
HOUSEHOLD_REGISTER = "SELECT CAST(p_partkey AS STRING) AS official_id, p_brand || p_type AS road_address, CASE WHEN p_size > 40 THEN NULL ELSE p_size * 100 END AS whole_complex_households FROM {part} WHERE p_retailprice > 920"
CROSSWALK = "SELECT CAST(p_partkey AS STRING) AS official_id, p_type AS gu_code, p_brand AS dong_name, CAST(p_partkey AS STRING) AS complex_key, p_name AS building_name, p_brand || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS road_address, p_partkey % 5 <> 0 AS approved FROM {part}"


@query(
    "jn9_households",
    f"""WITH t AS ({_plain(HOUSEHOLD_TYPES)}), r AS ({_plain(HOUSEHOLD_REGISTER)}), c AS ({_plain(CROSSWALK)}),
a AS (SELECT c.complex_key, c.official_id, whole_complex_households AS w FROM c JOIN r USING (official_id) WHERE approved AND c.road_address = r.road_address AND whole_complex_households > 0)
SELECT p_partkey, CAST(coalesce(w, households) AS BIGINT) AS households, CAST(CASE WHEN w IS NOT NULL THEN households END AS BIGINT) AS legacy_households,
  w IS NOT NULL AS households_verified, official_id FROM t LEFT JOIN a USING (complex_key)""",
)
def households(spark, sf_dir):
    out = ops.apply_households(
        _sql(spark, sf_dir, HOUSEHOLD_TYPES), _sql(spark, sf_dir, HOUSEHOLD_REGISTER), _sql(spark, sf_dir, CROSSWALK)
    )
    return tidy(out.select("p_partkey", "households", "legacy_households", "households_verified", "official_id"))


@query(
    "jn11_join_snapshot",
    with_trades(
        """, s AS (SELECT key, median(price) AS typical, count(*) AS n FROM clean GROUP BY key)
SELECT orderkey, linenumber, t.key, price, round(typical, 6) AS typical, s.n FROM trades t LEFT JOIN s USING (key)"""
    ),
)
def join_snapshot(spark, sf_dir):
    snap = median(clean(spark, sf_dir), ["key"], "price", "typical")
    out = ops.join_snapshot(trades(spark, sf_dir), snap, ["key"])
    return tidy(out.select("orderkey", "linenumber", "key", "price", "typical", "n"))


DATES = ("2024-01-10", "2024-01-17", "2024-01-24")
D_PANEL = """SELECT CAST(user_id AS VARCHAR) AS asset_id, event_id, ts AS observed_at, ts + to_days(CAST(event_id % 3 AS INTEGER)) AS available_at,
  ts + to_days(CAST(event_id % 9 AS INTEGER)) AS valid_until, CAST(floor(value * 100) AS BIGINT) AS price_krw, value AS score,
  CASE WHEN event_type IN ('view', 'click') THEN 'sell' ELSE 'buy' END AS side FROM events"""


def panel(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    days = lambda n: F.make_interval(days=(F.col("event_id") % n).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("asset_id"), F.col("event_id").alias("observation_id"), F.col("event_id").alias("quote_id"),
        ts.alias("observed_at"), (ts + days(3)).alias("available_at"), (ts + days(9)).alias("valid_until"),
        ts.alias("max_feature_available_at"), ts.alias("max_training_label_available_at"),
        F.floor(F.col("value") * 100).alias("price_krw"), F.col("value").alias("score"),
        F.when(F.col("event_type").isin("view", "click"), "sell").otherwise("buy").alias("side"),
    )


D_DAYS = "d AS (SELECT CAST(x AS DATE) AS d FROM (VALUES " + ", ".join(f"('{d}')" for d in DATES) + ") t(x))"


@query(
    "jn13_observations_asof",
    f"""WITH p AS ({D_PANEL}), {D_DAYS}
SELECT CAST(d AS VARCHAR) AS decision_date, asset_id, arg_max(event_id, (observed_at, available_at, event_id)) AS observation_id,
  arg_max(price_krw, (observed_at, available_at, event_id)) AS price_krw FROM p JOIN d ON greatest(available_at, observed_at) <= d + INTERVAL 15 HOUR - INTERVAL 1 MICROSECOND
  AND d + INTERVAL 15 HOUR - INTERVAL 1 MICROSECOND - observed_at <= INTERVAL 7 DAY GROUP BY d, asset_id""",
)
def observations_asof(spark, sf_dir):
    out = ops.observations_asof(panel(spark, sf_dir), DATES, 7)
    return tidy(out.select("decision_date", "asset_id", "observation_id", "price_krw"))


@query(
    "jn14_quotes_at",
    f"""WITH p AS ({D_PANEL}), o AS (SELECT DISTINCT asset_id, side, CAST(observed_at AS DATE) + 2 AS order_date FROM p),
u AS (SELECT o.asset_id, o.side, order_date, arg_max(event_id, (observed_at, available_at, event_id)) AS quote_id,
    arg_max(price_krw, (observed_at, available_at, event_id)) AS price_krw FROM o JOIN p ON p.asset_id = o.asset_id AND p.side = o.side
  AND available_at <= order_date + INTERVAL 15 HOUR - INTERVAL 1 MICROSECOND AND order_date + INTERVAL 15 HOUR - INTERVAL 1 MICROSECOND <= valid_until
  AND order_date + INTERVAL 15 HOUR - INTERVAL 1 MICROSECOND - observed_at <= INTERVAL 5 DAY GROUP BY ALL)
SELECT o.asset_id, o.side, CAST(o.order_date AS VARCHAR) AS order_date, quote_id, price_krw FROM o LEFT JOIN u USING (asset_id, side, order_date)""",
)
def quotes_at(spark, sf_dir):
    rows = panel(spark, sf_dir)
    orders = rows.select("asset_id", "side", F.date_add(F.to_date("observed_at"), 2).alias("order_date")).distinct()
    return tidy(ops.quotes_at(orders, rows, 5))


@query(
    "jn20_area_inversions",
    with_trades(
        """, m AS (SELECT complex, area, median(price) AS t FROM clean GROUP BY ALL)
SELECT count(*) AS comparable_pairs, count(*) FILTER (WHERE b.t < s.t * 0.95) AS larger_total_at_least_5pct_lower
FROM m b JOIN m s ON b.complex = s.complex AND b.area / s.area BETWEEN 1.1 AND 1.5"""
    ),
)
def area_inversions(spark, sf_dir):
    return ops.area_inversions(clean(spark, sf_dir), "complex", "area", "price")


@query(
    "jn22_multiset_join",
    with_trades(
        """, l AS (SELECT key, month, price, row_number() OVER (PARTITION BY key, month ORDER BY price) AS occurrence FROM trades WHERE linestatus = 'F'),
r AS (SELECT key, month, price AS other, row_number() OVER (PARTITION BY key, month ORDER BY price) AS occurrence FROM trades WHERE linestatus = 'O')
SELECT key, month, occurrence, price, other FROM l JOIN r USING (key, month, occurrence)"""
    ),
)
def multiset_join(spark, sf_dir):
    rows = trades(spark, sf_dir)
    left = rows.where("linestatus = 'F'").select("key", "month", "price")
    right = rows.where("linestatus = 'O'").select("key", "month", F.col("price").alias("other"))
    return ops.multiset_join(left, right, ["key", "month"], [F.col("price")], [F.col("other")])


@query(
    "jn23_semi_anti",
    with_trades(
        """SELECT key, count(*) AS n FROM clean WHERE key IN (SELECT key FROM trades WHERE date >= DATE '2001-01-01')
  AND complex NOT IN (SELECT complex FROM trades WHERE floor = 50 AND tax = 0.0 AND discount = 0.0) GROUP BY key"""
    ),
)
def semi_anti(spark, sf_dir):
    rows, every = clean(spark, sf_dir), trades(spark, sf_dir)
    kept = ops.semi(rows, every.where("date >= DATE '2001-01-01'"), ["key"])
    kept = ops.anti(kept, every.where("floor = 50 AND tax = 0.0 AND discount = 0.0"), ["complex"])
    return kept.groupBy("key").agg(F.count("*").alias("n"))


@query(
    "jn24_aligned",
    with_trades(
        """SELECT complex, month, CAST(sum(CASE WHEN cancelled THEN -1 ELSE 1 END) AS BIGINT) AS difference FROM trades GROUP BY ALL
HAVING sum(CASE WHEN cancelled THEN -1 ELSE 1 END) <> 0"""
    ),
)
def aligned(spark, sf_dir):
    from pricetide.operators.quality import same_multiset

    rows = trades(spark, sf_dir)
    side = lambda c: rows.where(c).select("complex", "month")
    return same_multiset(side("NOT cancelled"), side("cancelled"))


MAP_FEATURES = "SELECT CAST(10000 + n_nationkey AS STRING) || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE '7' END AS map_code FROM {nation}"


@query(
    "jn26_join_map",
    with_trades(
        f", f AS ({_plain(MAP_FEATURES)})"
        + """, r AS (SELECT DISTINCT dong AS region, unnest([CAST(10000 + CAST(complex AS BIGINT) % 25 AS VARCHAR), CAST(100007 + (CAST(complex AS BIGINT) % 25) * 10 AS VARCHAR)]) AS c FROM trades),
s AS (SELECT c, array_to_string(list_sort(list(DISTINCT region)), ',') AS regions FROM r GROUP BY c)
SELECT map_code, coalesce(a.regions, b.regions) AS regions FROM f LEFT JOIN s a ON a.c = map_code LEFT JOIN s b ON b.c = substr(map_code, 1, 5)"""
    ),
)
def join_map(spark, sf_dir):
    c = F.col("complex").cast("long") % 25
    regions = trades(spark, sf_dir).select(
        F.col("dong").alias("region"), F.array((10000 + c).cast("string"), (100007 + c * 10).cast("string")).alias("map_codes")
    ).distinct()
    out = ops.join_map(_sql(spark, sf_dir, MAP_FEATURES), regions)
    return out.withColumn("regions", F.array_join("regions", ","))


OFFERS = """
SELECT orderkey * 8 + linenumber AS offer_id, complex, CAST(area AS DOUBLE) - tax * 100 AS min_area, CAST(area AS DOUBLE) + discount * 20 AS max_area,
  price_oku AS ask, floor AS supply, date AS offer_date FROM {trades} WHERE date >= CAST('2001-08-01' AS DATE)
"""


@query(
    "jn27_match_offers",
    with_trades(
        f", o AS ({OFFERS.format(trades='trades')})"
        + """, t AS (SELECT DISTINCT complex, key, CAST(area AS DOUBLE) AS area FROM trades),
m AS (SELECT t.complex, key, count(*) AS n, max(offer_id) AS offer_id, max(ask) AS ask FROM t JOIN o ON o.complex = t.complex
  AND area BETWEEN min_area - 0.005 AND max_area + 0.005 GROUP BY ALL HAVING count(*) = 1)
SELECT t.complex, t.key, area, offer_id, ask FROM t LEFT JOIN m USING (complex, key)"""
    ),
)
def match_offers(spark, sf_dir):
    rows = trades(spark, sf_dir)
    types = rows.select("complex", "key", F.col("area").cast("double").alias("area")).distinct()
    return ops.match_offers(types, spark.sql(OFFERS, trades=rows))


@query(
    "jn27_asking_by_supply",
    with_trades(
        f", o AS ({OFFERS.format(trades='trades')})"
        + """SELECT complex, CAST(floor(supply / 10) * 10 AS BIGINT) AS bucket, round(min(ask), 6) AS lowest_ask FROM o
WHERE DATE '2001-09-15' - offer_date BETWEEN 0 AND 30 AND floor(supply / 10) * 10 IN (20, 30, 40) GROUP BY ALL"""
    ),
)
def asking_by_supply(spark, sf_dir):
    return tidy(ops.asking_by_supply(spark.sql(OFFERS, trades=trades(spark, sf_dir)), "2001-09-15"))


# --- Annual reference -----------------------------------------------------

ANNUAL_TYPES = """
, types AS (SELECT sido, gu, dong, key, complex, any_value(built) AS built, any_value(area / 3.3058) AS area, year,
  median(price / (area / 3.3058)) AS price, count(*) AS n FROM clean GROUP BY sido, gu, dong, key, complex, year)
"""
ANNUAL = (
    ANNUAL_TYPES
    + """
, peers AS (SELECT dong, year, median(price) AS m, sum(n) AS n FROM types GROUP BY ALL),
p0 AS (SELECT t.*, ln(a.price) AS prior_price, a.n AS prior_count, ln(a.price / b.price) AS momentum, ln(peers.m) AS prior_peer,
  peers.n AS peer_count, ln(t.price) AS target, CASE WHEN t.built <= t.year THEN t.year - t.built END AS age, floor(t.area / 5) AS area_band
  FROM types t LEFT JOIN types a ON a.dong = t.dong AND a.key = t.key AND a.year = t.year - 1
  LEFT JOIN types b ON b.dong = t.dong AND b.key = t.key AND b.year = t.year - 2
  LEFT JOIN peers ON peers.dong = t.dong AND peers.year = t.year - 1),
p1 AS (SELECT *, CASE WHEN year - lag(year) OVER w <= 3 THEN lag(target) OVER w END AS last_price,
  CASE WHEN year - lag(year) OVER w <= 3 THEN year - lag(year) OVER w END AS history_gap FROM p0 WINDOW w AS (PARTITION BY dong, key ORDER BY year)),
pd AS (SELECT dong, area_band, year, median(target) AS m, count(*) AS n FROM p0 GROUP BY ALL HAVING count(*) >= 5),
pg AS (SELECT gu, area_band, year, median(target) AS m, count(*) AS n FROM p0 GROUP BY ALL HAVING count(*) >= 10),
ps AS (SELECT sido, area_band, year, median(target) AS m, count(*) AS n FROM p0 GROUP BY ALL HAVING count(*) >= 20),
p2 AS (SELECT p1.*, coalesce(pd.m, pg.m, ps.m) AS matched_peer, coalesce(pd.n, pg.n, ps.n) AS matched_peer_count FROM p1
  LEFT JOIN pd ON pd.dong = p1.dong AND pd.area_band = p1.area_band AND pd.year = p1.year - 1
  LEFT JOIN pg ON pg.gu = p1.gu AND pg.area_band = p1.area_band AND pg.year = p1.year - 1
  LEFT JOIN ps ON ps.sido = p1.sido AND ps.area_band = p1.area_band AND ps.year = p1.year - 1),
sib AS (SELECT a.dong, a.key, a.year, s.target AS sibling_price, a.area / s.area AS sibling_area_ratio, s.n AS sibling_count, a.year - s.year AS sibling_gap
  FROM p0 a JOIN p0 s ON s.dong = a.dong AND s.complex = a.complex AND s.built = a.built AND s.key <> a.key AND s.n >= 3
    AND a.year - s.year BETWEEN 1 AND 3 AND a.area / s.area BETWEEN 1 / 1.5 AND 1.5 AND abs(a.area - s.area) > 1e-6
  WHERE s.year = (SELECT max(z.year) FROM p0 z WHERE z.dong = s.dong AND z.key = s.key AND z.n >= 3 AND z.year < a.year)
  QUALIFY row_number() OVER (PARTITION BY a.dong, a.key, a.year ORDER BY s.year DESC, abs(ln(a.area / s.area)), s.n DESC, s.key) = 1),
panel AS (SELECT p2.*, sibling_price, sibling_area_ratio, sibling_count, sibling_gap,
  coalesce(prior_price, last_price, sibling_price, matched_peer, prior_peer) AS reference_anchor FROM p2 LEFT JOIN sib USING (dong, key, year))
"""
)


def annual_types(spark, sf_dir):
    """Median price per type and year with the type's built year and area: one shuffle of trades that are joined once."""
    rows = clean(spark, sf_dir).withColumn("_p", F.col("price") / (F.col("area") / F.lit(3.3058)))
    keys = ["sido", "gu", "dong", "key", "complex", "year"]
    rows = stored(rows.select(*keys, "built", "area", "_p"))
    facts = [F.first("built").alias("built"), (F.first("area") / F.lit(3.3058)).alias("area")]
    found = quantiles_with(rows, keys, "_p", {"price": Quantile(0.5)}, None, facts, ["built", "area"], crowded(rows, ["key"]))
    return found.select(*keys, F.col("total_one").cast("long").alias("n"), "price", "built", "area")


@query(
    "ag39_annual_panel",
    with_trades(
        ANNUAL
        + """SELECT dong, key, CAST(year AS BIGINT) AS year, n, round(prior_price, 6) AS prior_price, prior_count, round(momentum, 6) + 0.0 AS momentum,
  round(prior_peer, 6) AS prior_peer, CAST(peer_count AS BIGINT) AS peer_count, round(target, 6) AS target, age, CAST(area_band AS BIGINT) AS area_band FROM p0"""
    ),
)
def annual_panel(spark, sf_dir):
    out = annual.annual_panel(annual_types(spark, sf_dir))
    return tidy(
        out.select(
            "dong", "key", "year", "n", "prior_price", "prior_count", "momentum", "prior_peer", "peer_count", "target", "age", "area_band"
        )
    )


@query(
    "jn17_last_price_asof",
    with_trades(ANNUAL + "SELECT dong, key, CAST(year AS BIGINT) AS year, round(last_price, 6) AS last_price, history_gap FROM p1"),
)
def last_price_asof(spark, sf_dir):
    out = annual.last_price_asof(annual.annual_panel(annual_types(spark, sf_dir)))
    return tidy(out.select("dong", "key", "year", "last_price", "history_gap"))


@query(
    "jn18_matched_peer",
    with_trades(
        ANNUAL + "SELECT dong, key, CAST(year AS BIGINT) AS year, round(matched_peer, 6) AS matched_peer, matched_peer_count FROM p2"
    ),
)
def matched_peer(spark, sf_dir):
    out = annual.matched_peer(durable(annual.annual_panel(annual_types(spark, sf_dir))))
    return tidy(out.select("dong", "key", "year", "matched_peer", "matched_peer_count"))


@query(
    "jn16_sibling_anchor",
    with_trades(
        ANNUAL
        + """SELECT dong, key, CAST(year AS BIGINT) AS year, round(sibling_price, 6) AS sibling_price, round(sibling_area_ratio, 6) AS sibling_area_ratio,
  sibling_count, sibling_gap FROM panel"""
    ),
)
def sibling_anchor(spark, sf_dir):
    out = annual.sibling_anchor(durable(annual.annual_panel(annual_types(spark, sf_dir))))
    return tidy(out.select("dong", "key", "year", "sibling_price", "sibling_area_ratio", "sibling_count", "sibling_gap"))


@query(
    "ag40_reference_anchor",
    with_trades(ANNUAL + "SELECT dong, key, CAST(year AS BIGINT) AS year, round(reference_anchor, 6) AS reference_anchor FROM panel"),
)
def reference_anchor(spark, sf_dir):
    return tidy(annual.reference_frame(annual_types(spark, sf_dir)).select("dong", "key", "year", "reference_anchor"))


@query(
    "ag28_hash_split",
    with_trades(
        """SELECT complex, CAST('0x' || substr(sha256(complex), 1, 8) AS BIGINT) % 2 = 0 AS tuning, count(*) AS n FROM clean GROUP BY ALL"""
    ),
)
def hash_split(spark, sf_dir):
    return annual.hash_split(clean(spark, sf_dir), "complex").groupBy("complex", "tuning").agg(F.count("*").alias("n"))


LEVELS = {"history": ("gu", "has_prior"), "gu": ("gu",), "all": ()}
RADIUS = (
    ANNUAL
    + """
, err AS (SELECT *, prior_price IS NOT NULL AS has_prior, abs(target - reference_anchor) / sqrt(1 + 2 / greatest(n, 1)) AS e FROM panel
  WHERE reference_anchor IS NOT NULL),
lv AS (SELECT 'history' AS level, gu || '|' || CAST(has_prior AS VARCHAR) AS grp, e FROM err UNION ALL SELECT 'gu', gu, e FROM err UNION ALL SELECT 'all', '', e FROM err),
ranked AS (SELECT *, row_number() OVER (PARTITION BY level, grp ORDER BY e) AS r, count(*) OVER (PARTITION BY level, grp) AS n FROM lv),
radii AS (SELECT level, grp, any_value(n) AS n, min(e) FILTER (WHERE r = least(n, CAST(ceil((n + 1) * 0.8) AS BIGINT))) AS radius FROM ranked
  GROUP BY level, grp HAVING any_value(n) >= 100 OR level = 'all')
"""
)


def _errors(spark, sf_dir):
    frame = annual.reference_frame(annual_types(spark, sf_dir)).where("reference_anchor IS NOT NULL")
    return frame.withColumn("has_prior", F.col("prior_price").isNotNull())


def _scaled_error():
    return F.abs(F.col("target") - F.col("reference_anchor")) / annual.sample_scale(F.col("n"))


@query("ag27_conformal_radius", with_trades(RADIUS + 'SELECT level, grp AS "group", n, round(radius, 6) AS radius FROM radii'))
def conformal_radius(spark, sf_dir):
    return tidy(annual.conformal_radius(_errors(spark, sf_dir), _scaled_error(), LEVELS))


@query(
    "ag41_annual_review",
    with_trades(
        RADIUS
        + """, r AS (SELECT err.*, coalesce(h.radius, g.radius, a.radius) AS radius, exp(reference_anchor) AS fair FROM err
  LEFT JOIN radii h ON h.level = 'history' AND h.grp = err.gu || '|' || CAST(has_prior AS VARCHAR)
  LEFT JOIN radii g ON g.level = 'gu' AND g.grp = err.gu LEFT JOIN radii a ON a.level = 'all')
SELECT dong, key, CAST(year AS BIGINT) AS year, round(fair * exp(-radius * sqrt(1 + 2 / greatest(n, 1))), 4) AS reference_low,
  round(fair * exp(radius * sqrt(1 + 2 / greatest(n, 1))), 4) AS reference_high,
  round(50 + 40 * tanh(ln(fair / price) / greatest(radius, 0.05)) * (n / (n + 5)), 6) AS house_match_score, round(n / (n + 5), 6) AS sample_confidence,
  array_to_string(list_filter([CASE WHEN n < 3 THEN 'fewer_than_3_trades' END, CASE WHEN prior_price IS NULL THEN 'no_prior_year_of_type' END,
    CASE WHEN abs(ln(fair / price)) > 2 * radius THEN 'large_price_gap' END], lambda x: x IS NOT NULL), ',') AS flags,
  CASE WHEN prior_price IS NOT NULL THEN 'exact_prior' WHEN last_price IS NOT NULL THEN 'exact_history' WHEN sibling_price IS NOT NULL THEN 'same_complex_area'
    ELSE 'external_peer' END AS reference_basis FROM r"""
    ),
)
def annual_review(spark, sf_dir):
    frame = durable(_errors(spark, sf_dir))
    radii = annual.conformal_radius(frame, _scaled_error(), LEVELS)
    rows = annual.with_radius(frame, radii, LEVELS).withColumn("fair", F.exp("reference_anchor"))
    out = annual.annual_review(rows)
    out = out.withColumns({c: F.round(c, 4) for c in ("reference_low", "reference_high")})
    return tidy(
        out.select(
            "dong", "key", "year", "reference_low", "reference_high", "house_match_score", "sample_confidence",
            F.array_join("quality_flags", ",").alias("flags"), "reference_basis",
        )
    )
