"""Row-level normalisation queries (text exports derived from the transactions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetide.functions import parsing as P
from pricetide.functions import scores
from pricetide.operators import history, normalise, summary
from pricetide.operators.stats import crowded
from pricetide.plans.history import SERVED, UNIFORM, decay_sql, tidy
from pricetide.plans.registry import query
from pricetide.sources import domain
from pricetide.session import stored
from pricetide.sources.domain import EXPORT_SQL, LAW_CHANGE, LEASE_SQL, clean, table, trades, with_trades

# --- DuckDB spellings of the parsers, used only by the twins ---------------


def d_clean(c):
    return f"trim(coalesce({c}, ''))"


def d_number(c):
    return f"replace({d_clean(c)}, ',', '')"


def d_plain(c):
    return rf"regexp_replace(regexp_replace({d_number(c)}, '^\+', ''), '^(-?)0+(\d)', '\1\2')"


def d_flag(c, field, rule="false"):
    n = d_number(c)
    return (
        f"CASE WHEN {n} IN ('', '-', '--') THEN '{field}_missing' "
        rf"WHEN NOT regexp_full_match({n}, '[+-]?\d+(\.\d+)?') THEN '{field}_invalid' "
        f"WHEN {rule.replace('?', f'TRY_CAST({n} AS DOUBLE)')} THEN '{field}_out_of_range' END"
    )


def d_strip(c):
    return rf"regexp_replace({c}, '^0+(\d)', '\1')"


def d_tail(c):
    return f"regexp_replace({c}, '^0+', '')"


def d_lot(main, sub):
    return f"{d_strip(main)} || CASE WHEN {d_tail(sub)} <> '' THEN '-' || {d_tail(sub)} ELSE '' END"


D_DATE = "try_strptime(contract_month || lpad(contract_day, 2, '0'), '%Y%m%d')"
D_LOT = d_lot("main", "sub")
D_SOURCE_LOT = r"""CASE WHEN regexp_full_match(lot, '\d+(-\d+)?') THEN """ + d_lot(
    "split_part(lot, '-', 1)", "split_part(lot, '-', 2)"
) + " END"
D_LOT_FLAG = f"CASE WHEN lot NOT IN ('', '-', '--') AND ({D_SOURCE_LOT}) IS DISTINCT FROM ({D_LOT}) THEN 'lot_source_disagrees' END"


def _counted(df, *columns):
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


@query(
    "prj1_decimal_text",
    with_trades(
        EXPORT_SQL
        + f""", p AS (SELECT amount, {d_flag('amount', 'amount', '? <= 0')} AS flag, {d_plain('amount')} AS text FROM sales)
SELECT amount, CASE WHEN flag IS NULL THEN text END AS value, flag, count(*) AS n FROM p GROUP BY ALL"""
    ),
)
def decimal_text(spark, sf_dir):
    value, flag = P.decimal_text(F.col("amount"), "amount", positive=True)
    return _counted(domain.sale_export(spark, sf_dir).select("amount", value.alias("value"), flag.alias("flag")), "amount", "value", "flag")


@query(
    "prj2_contract_date",
    with_trades(
        EXPORT_SQL
        + f"""SELECT contract_month, contract_day, CAST(CAST({D_DATE} AS DATE) AS VARCHAR) AS date,
  CASE WHEN {D_DATE} IS NULL THEN 'contract_date_invalid' END AS flag, count(*) AS n FROM sales GROUP BY ALL"""
    ),
)
def contract_date(spark, sf_dir):
    date, flag = P.contract_date(F.col("contract_month"), F.col("contract_day"))
    rows = domain.sale_export(spark, sf_dir).select(
        "contract_month", "contract_day", date.cast("string").alias("date"), flag.alias("flag")
    )
    return _counted(rows, *rows.columns)


@query(
    "prj3_normalize_lot",
    with_trades(
        EXPORT_SQL
        + f"SELECT main, sub, lot, {D_LOT} AS lot_normalized, {D_LOT_FLAG} AS flag, count(*) AS n FROM sales GROUP BY ALL"
    ),
)
def normalize_lot(spark, sf_dir):
    lot, flag = P.normalize_lot(F.col("main"), F.col("sub"), F.col("lot"))
    rows = domain.sale_export(spark, sf_dir).select("main", "sub", "lot", lot.alias("lot_normalized"), flag.alias("flag"))
    return _counted(rows, *rows.columns)


@query(
    "prj4_export_parcel",
    with_trades(
        EXPORT_SQL
        + rf""", p AS (SELECT main, sub, lot, regexp_extract(lot, '^산(\d+)', 1) AS hill,
    regexp_full_match(lot, '산\d+') AND {d_tail('main')} = {d_tail("regexp_extract(lot, '^산(.*)$', 1)")} AND {d_tail('sub')} = '' AS accepted
  FROM sales)
SELECT main, sub, lot, CASE WHEN accepted THEN '산' || hill ELSE {d_strip('main')} END AS parcel_main,
  CASE WHEN accepted THEN '' ELSE {d_tail('sub')} END AS parcel_sub, accepted, count(*) AS n FROM p GROUP BY ALL"""
    ),
)
def export_parcel(spark, sf_dir):
    main, sub, accepted = P.export_parcel(F.col("lot"), F.col("main"), F.col("sub"))
    rows = domain.sale_export(spark, sf_dir).select(
        "main", "sub", "lot", main.alias("parcel_main"), sub.alias("parcel_sub"), accepted.alias("accepted")
    )
    return _counted(rows, *rows.columns)


MATCH = """
, addresses AS (SELECT DISTINCT address_text FROM sales),
hits AS (SELECT address_text, code, sido, district, substr(address_text, length(sido || ' ' || district) + 2) AS legal_dong,
    length(sido || ' ' || district) AS len
  FROM addresses JOIN (SELECT DISTINCT * FROM registry) ON starts_with(address_text, sido || ' ' || district || ' ')
    AND length(address_text) > length(sido || ' ' || district) + 1),
tops AS (SELECT * FROM hits QUALIFY len = max(len) OVER (PARTITION BY address_text)),
matched AS (SELECT a.address_text, CASE WHEN count(code) = 1 THEN 'unique_exact_registry_name'
    WHEN count(code) > 1 THEN 'ambiguous' ELSE 'unresolved' END AS address_match,
  CASE WHEN count(code) = 1 THEN min(code) END AS district_code, CASE WHEN count(code) = 1 THEN min(sido) END AS sido,
  CASE WHEN count(code) = 1 THEN min(district) END AS district, CASE WHEN count(code) = 1 THEN min(legal_dong) END AS legal_dong
  FROM addresses a LEFT JOIN tops USING (address_text) GROUP BY a.address_text)
"""


@query(
    "jn1_match_address",
    with_trades(
        EXPORT_SQL
        + MATCH
        + """SELECT address_text, address_match, district_code, sido, district, legal_dong, count(*) AS n
FROM sales JOIN matched USING (address_text) GROUP BY ALL"""
    ),
)
def match_address(spark, sf_dir):
    out = normalise.match_address(domain.sale_export(spark, sf_dir), domain.registry(spark, sf_dir))
    return _counted(out, "address_text", "address_match", "district_code", "sido", "district", "legal_dong")


D_COMMON_FLAGS = f"""
  CASE WHEN address_match <> 'unique_exact_registry_name' THEN 'address_' || address_match END,
  CASE WHEN sido IS NOT NULL AND sido <> source_sido THEN 'source_sido_mismatch' END,
  CASE WHEN {D_DATE} IS NULL THEN 'contract_date_invalid' END,
  CASE WHEN CAST({D_DATE} AS DATE) NOT BETWEEN source_start AND source_end THEN 'contract_date_outside_request' END,
  {d_flag('area', 'area', '? <= 0')}, {d_flag('floor', 'floor')}, {d_flag('built', 'built_year')}, {D_LOT_FLAG},
  CASE WHEN trim(building) IN ('', '-', '--') THEN 'building_name_missing' END"""
CANONICAL_SALES = f"""
, canonical AS (SELECT sales.*, district_code, sido, district, legal_dong, address_match,
  CAST({D_DATE} AS DATE) AS contract_date, {D_LOT} AS lot_normalized,
  CASE WHEN {d_flag('amount', 'amount', '? <= 0')} IS NULL THEN {d_plain('amount')} END AS amount_10k_krw,
  CASE WHEN {d_flag('area', 'area', '? <= 0')} IS NULL THEN {d_plain('area')} END AS area_sqm,
  trim(cancelled_on) NOT IN ('', '-', '--') AS was_cancelled,
  CASE WHEN deal_type NOT IN ('', '-', '--') THEN deal_type END AS deal,
  CASE WHEN deal_type IN ('직거래', '중개거래') THEN deal_type = '직거래' END AS direct_trade,
  list_filter([{D_COMMON_FLAGS},
    CASE WHEN deal_type IN ('', '-', '--') THEN 'deal_type_unknown' WHEN deal_type NOT IN ('직거래', '중개거래') THEN 'deal_type_unrecognized' END,
    {d_flag('amount', 'amount', '? <= 0')}], lambda x: x IS NOT NULL) AS flags
  FROM sales JOIN matched USING (address_text))
"""


def canonical_sales(spark, sf_dir):
    return normalise.normalize_sale(domain.sale_export(spark, sf_dir), domain.registry(spark, sf_dir))


@query(
    "prj5_normalize_sale",
    with_trades(
        EXPORT_SQL
        + MATCH
        + CANONICAL_SALES
        + """SELECT row_number, CAST(contract_date AS VARCHAR) AS contract_date, lot_normalized, area_sqm, amount_10k_krw,
  was_cancelled AS cancelled, deal AS deal_type, direct_trade, array_to_string(flags, ',') AS flags, count(*) AS n
FROM canonical GROUP BY ALL"""
    ),
)
def normalize_sale(spark, sf_dir):
    rows = canonical_sales(spark, sf_dir).select(
        F.col("provenance.row_number").alias("row_number"), F.col("contract_date").cast("string").alias("contract_date"),
        F.col("address.lot_normalized").alias("lot_normalized"), "area_sqm", "amount_10k_krw", "cancelled", "deal_type",
        "direct_trade", F.array_join("quality_flags", ",").alias("flags"),
    )
    return _counted(rows, *rows.columns)


D_LEASE_FLAGS = f"""
    CASE WHEN trim(contract_type) NOT IN ('신규', '갱신') THEN 'contract_type_unknown' END,
    {d_flag('deposit', 'deposit', '? < 0')}, {d_flag('monthly_rent', 'monthly_rent', '? < 0')},
    {d_flag('previous_deposit', 'previous_deposit', '? < 0')}, {d_flag('previous_monthly_rent', 'previous_monthly_rent', '? < 0')},
    CASE WHEN lease_type NOT IN ('전세', '월세') THEN 'lease_type_unknown'
      WHEN pure IS NOT NULL AND ((lease_type = '전세' AND NOT pure) OR (lease_type = '월세' AND rent = 0))
      THEN 'lease_type_financials_disagree' END,
    'cancellation_status_unavailable'"""
CANONICAL_LEASES = (
    LEASE_SQL
    + MATCH.replace("FROM sales", "FROM leases")
    + f"""
, typed AS (SELECT leases.*, district_code, sido, district, legal_dong, address_match, CAST({D_DATE} AS DATE) AS contract_date,
    CASE WHEN {d_flag('deposit', 'deposit', '? < 0')} IS NULL THEN {d_plain('deposit')} END AS dep,
    CASE WHEN {d_flag('monthly_rent', 'm', '? < 0')} IS NULL THEN {d_plain('monthly_rent')} END AS rent_text,
    TRY_CAST({d_number('monthly_rent')} AS DOUBLE) AS rent
  FROM leases JOIN matched USING (address_text)),
judged AS (SELECT *, CASE WHEN dep IS NOT NULL AND rent_text IS NOT NULL
    THEN rent = 0 AND CAST(dep AS DOUBLE) > 0 AND property_type = '아파트' END AS pure FROM typed),
canonical AS (SELECT *, list_filter([{D_COMMON_FLAGS}, {D_LEASE_FLAGS}], lambda x: x IS NOT NULL) AS flags FROM judged)
"""
)


def canonical_leases(spark, sf_dir):
    return normalise.normalize_lease(domain.lease_export(spark, sf_dir), domain.registry(spark, sf_dir))


@query(
    "prj6_normalize_lease",
    with_trades(
        EXPORT_SQL
        + CANONICAL_LEASES
        + """SELECT row_number, dep AS deposit_10k_krw, rent_text AS monthly_rent_10k_krw, nullif(lease_type, '') AS lease_type,
  CASE WHEN contract_type IN ('신규', '갱신') THEN contract_type ELSE '미상' END AS contract_kind, pure AS is_pure_jeonse,
  array_to_string(flags, ',') AS flags, count(*) AS n FROM canonical GROUP BY ALL"""
    ),
)
def normalize_lease(spark, sf_dir):
    rows = canonical_leases(spark, sf_dir).select(
        F.col("provenance.row_number").alias("row_number"), "deposit_10k_krw", "monthly_rent_10k_krw",
        F.col("lease_type_raw").alias("lease_type"), "contract_kind", "is_pure_jeonse",
        F.array_join("quality_flags", ",").alias("flags"),
    )
    return _counted(rows, *rows.columns)


ANNUAL_LEASES = """
SELECT CASE WHEN linenumber = 7 THEN '연립' ELSE '아파트' END AS usage, replace(CAST(date AS STRING), '-', '') AS contract_day,
  CAST(area AS STRING) || '.50' AS area, CAST(CAST(price AS DECIMAL(18,2)) AS STRING) AS deposit,
  CASE WHEN linestatus = 'F' THEN '0' ELSE '12' END AS monthly_rent, CAST(CAST(floor AS INT) AS STRING) AS floor,
  CASE WHEN linenumber = 2 THEN '월세' ELSE '전세' END AS lease_type, lpad(complex, 4, '0') AS main,
  CASE WHEN linenumber = 3 THEN 'x' ELSE '0000' END AS sub, gu AS district, dong, building_name AS building, gu AS district_code,
  CASE WHEN direct THEN '갱신' WHEN cancelled THEN '' ELSE '신규' END AS contract_type, CAST(receipt_year AS STRING) AS receipt_year
FROM {trades}
"""


def annual_leases(spark, sf_dir):
    return spark.sql(ANNUAL_LEASES, trades=trades(spark, sf_dir))


@query(
    "prj7_clean_leases",
    with_trades(
        f", a AS ({ANNUAL_LEASES.format(trades='trades')})"
        + rf""", k AS (SELECT *, district || ' ' || dong || ' ' || {d_lot('main', 'sub')} || ' ' || building AS complex,
    regexp_replace(area, '0+$', '') AS area_text FROM a WHERE usage = '아파트' AND monthly_rent = '0' AND lease_type = '전세'
    AND regexp_full_match(sub, '\d+'))
SELECT complex || ' | ' || area_text || '㎡' AS key, district_code || '|' || dong || '|' || {d_lot('main', 'sub')} || '|' || area_text AS lot_key,
  CASE WHEN contract_type = '' THEN '미상' ELSE contract_type END AS contract_type, CAST(receipt_year AS INTEGER) AS receipt_year,
  count(*) AS n, round(sum(ln(CAST(deposit AS DOUBLE) / CAST(area AS DOUBLE))), 5) AS log_rent_sum,
  min(CAST(strptime(contract_day, '%Y%m%d') AS DATE) - DATE '1970-01-01') AS first_day FROM k GROUP BY ALL"""
    ),
)
def clean_leases(spark, sf_dir):
    out = normalise.clean_leases(annual_leases(spark, sf_dir))
    return tidy(
        out.groupBy("key", "lot_key", "contract_type", "receipt_year").agg(
            F.count("*").alias("n"), F.sum("log_rent").alias("log_rent_sum"), F.min(F.unix_date("date")).alias("first_day")
        ),
        5,
    )


D_REASON = (
    "array_to_string(list_sort(list_filter(flags, lambda x: x IN ("
    + ", ".join(f"'{f}'" for f in normalise.BLOCKING_FLAGS)
    + "))), '|')"
)
DASHBOARD = (
    EXPORT_SQL
    + MATCH
    + CANONICAL_SALES
    + f"""
, judged AS (SELECT *, nullif({D_REASON}, '') AS reason FROM canonical),
dashboard AS (SELECT CAST(year(contract_date) AS VARCHAR) AS "RCPT_YR", district_code AS "CGG_CD", district AS "CGG_NM",
  legal_dong AS "STDG_NM", main AS "MNO", sub AS "SNO", trim(building) AS "BLDG_NM", strftime(contract_date, '%Y%m%d') AS "CTRT_DAY",
  amount_10k_krw AS "THING_AMT", area_sqm AS "ARCH_AREA", floor AS "FLR", built AS "ARCH_YR", '아파트' AS "BLDG_USG",
  coalesce(deal, '') AS "DCLR_SE", CASE WHEN was_cancelled THEN cancelled_on ELSE '' END AS "RTRCN_DAY",
  agent AS "OPBIZ_RESTAGNT_SGG_NM" FROM judged WHERE reason IS NULL)
"""
)


def dashboard(spark, sf_dir):
    """Accepted rows, kept once because several passes read them."""
    return stored(normalise.to_dashboard(canonical_sales(spark, sf_dir))[0], many_expressions=True)


@query("prj8_to_dashboard", with_trades(DASHBOARD + "SELECT *, count(*) AS n FROM dashboard GROUP BY ALL"))
def to_dashboard(spark, sf_dir):
    rows = dashboard(spark, sf_dir).drop("STDG_CD", "LOTNO_SE", "LOTNO_SE_NM", "LAND_AREA", "RGHT_SE")
    return _counted(rows, *rows.columns)


@query(
    "prj8_rejections",
    with_trades(DASHBOARD + "SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY reason"),
)
def rejections(spark, sf_dir):
    return _counted(normalise.to_dashboard(canonical_sales(spark, sf_dir))[1], "reason")


D_COMPLEX = f""""CGG_NM" || ' ' || "STDG_NM" || ' ' || {d_lot('"MNO"', '"SNO"')} || ' ' || "BLDG_NM" """
D_AREA_TEXT = """CASE WHEN contains("ARCH_AREA", '.') THEN regexp_replace(regexp_replace("ARCH_AREA", '0+$', ''), '\\.$', '') ELSE "ARCH_AREA" END"""


@query(
    "prj9_identity",
    with_trades(
        DASHBOARD
        + f"""SELECT {D_COMPLEX} AS complex, {D_COMPLEX} || ' | ' || {D_AREA_TEXT} || '㎡' AS key, "CGG_CD" AS gu,
  "CGG_CD" || ':' || "STDG_NM" AS dong, "CGG_CD" || ':' || CAST(CAST(floor(CAST("ARCH_AREA" AS DOUBLE) / 15) AS BIGINT) AS VARCHAR) AS peer,
  CASE WHEN "CGG_CD" LIKE '11%' THEN '서울특별시' WHEN "CGG_CD" LIKE '28%' OR "CGG_CD" LIKE '23%' THEN '인천광역시'
    WHEN "CGG_CD" LIKE '41%' OR "CGG_CD" LIKE '31%' THEN '경기도' ELSE '기타' END AS region, count(*) AS n
FROM dashboard GROUP BY ALL"""
    ),
)
def identity(spark, sf_dir):
    out = normalise.with_identity(dashboard(spark, sf_dir))
    return _counted(out, "complex", "key", "gu", "dong", "peer", "region")


@query(
    "prj10_price_metrics",
    with_trades(
        """SELECT orderkey, linenumber, price / 10000 AS price_billion, area / 3.3058 AS area_pyeong,
  round(price / (area / 3.3058), 6) AS price_per_pyeong, round(floor / 3.3058, 6) AS land_pyeong, round(floor / area, 6) AS land_ratio,
  round((floor / 3.3058) / (price / 10000), 6) AS land_efficiency FROM trades"""
    ),
)
def price_metrics(spark, sf_dir):
    out = summary.price_metrics(trades(spark, sf_dir), land="floor")
    return out.select(
        "orderkey", "linenumber", "price_billion", "area_pyeong",
        *[F.round(c, 6).alias(c) for c in ("price_per_pyeong", "land_pyeong", "land_ratio", "land_efficiency")],
    )


D_CLASS = """CASE WHEN trim("RTRCN_DAY") NOT IN ('', '-', '--') THEN 'cancelled' WHEN "BLDG_USG" <> '아파트' THEN 'property_type'
  WHEN "DCLR_SE" = '직거래' THEN 'direct' ELSE 'used' END"""


@query(
    "prj11_clean_trades",
    with_trades(
        DASHBOARD
        + f""", c AS (SELECT *, CAST(strptime("CTRT_DAY", '%Y%m%d') AS DATE) AS date FROM dashboard WHERE {D_CLASS} = 'used')
SELECT {D_COMPLEX} || ' | ' || {D_AREA_TEXT} || '㎡' AS key, CAST(date AS VARCHAR) AS date, CAST("THING_AMT" AS DOUBLE) AS price,
  CAST("ARCH_AREA" AS DOUBLE) AS area, CAST("FLR" AS DOUBLE) AS floor,
  round(ln(CAST("THING_AMT" AS DOUBLE) / CAST("ARCH_AREA" AS DOUBLE)), 6) AS log_price, count(*) AS n FROM c GROUP BY ALL"""
    ),
)
def clean_trades(spark, sf_dir):
    typed, _ = normalise.clean_trades(dashboard(spark, sf_dir))
    rows = typed.select(
        "key", F.col("date").cast("string").alias("date"), "price", "area", "floor", F.round("log_price", 6).alias("log_price")
    )
    return _counted(rows, *rows.columns)


@query(
    "prj11_trade_quality",
    with_trades(
        DASHBOARD
        + f""", c AS (SELECT *, {D_CLASS} AS class, CAST(strptime("CTRT_DAY", '%Y%m%d') AS DATE) AS date FROM dashboard)
SELECT count(*) AS raw_rows, count(*) FILTER (WHERE class = 'used') AS used_rows,
  count(*) FILTER (WHERE class = 'cancelled') AS cancelled, count(*) FILTER (WHERE class = 'direct') AS direct_excluded,
  count(*) FILTER (WHERE class = 'used' AND "DCLR_SE" = '') AS unknown_deal_type,
  CAST(min(date) FILTER (WHERE class = 'used') AS VARCHAR) AS min_date, CAST(max(date) FILTER (WHERE class = 'used') AS VARCHAR) AS max_date FROM c"""
    ),
)
def trade_quality(spark, sf_dir):
    return tidy(normalise.clean_trades(dashboard(spark, sf_dir))[1])


PLACES = """
SELECT CASE WHEN n_nationkey % 5 = 0 THEN '11' WHEN n_nationkey % 5 = 1 THEN '28' WHEN n_nationkey % 5 = 2 THEN '41'
    WHEN n_nationkey % 5 = 3 THEN '23' ELSE '99' END || lpad(CAST(n_nationkey AS STRING), 3, '0') AS gu_code,
  CASE WHEN s_suppkey % 3 = 0 THEN lpad(CAST(s_suppkey AS STRING), 5, '0') ELSE '' END AS dong_code,
  CASE WHEN s_suppkey % 3 = 1 THEN n_name ELSE '' END AS dong_name, s_suppkey
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
"""


@query(
    "prj12_region_code",
    f"""WITH p AS ({PLACES.format(supplier='supplier', nation='nation')})
SELECT s_suppkey, CASE WHEN dong_code <> '' THEN gu_code || substr(dong_code, 1, 3) WHEN dong_name <> '' THEN gu_code || ':' || dong_name
    ELSE gu_code END AS code,
  CASE substr(gu_code, 1, 2) WHEN '11' THEN '서울특별시' WHEN '28' THEN '인천광역시' WHEN '23' THEN '인천광역시' WHEN '41' THEN '경기도'
    ELSE '기타' END AS sido FROM p""",
)
def region_code(spark, sf_dir):
    places = spark.sql(PLACES, supplier=table(spark, sf_dir, "supplier"), nation=table(spark, sf_dir, "nation"))
    return places.select(
        "s_suppkey",
        P.legal_dong_code(F.col("gu_code"), F.col("dong_code"), F.col("dong_name")).alias("code"),
        P.province(F.col("gu_code")).alias("sido"),
    )


NAMES = """
SELECT p_partkey, p_name || ' (' || p_brand || ')' AS name, p_type || ' ' || p_name AS district,
  CASE WHEN p_partkey % 3 = 0 THEN p_name || '역, 서울역' WHEN p_partkey % 3 = 1 THEN p_brand || '지하철역' ELSE '' END AS station,
  CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS STRING) || ' 호선' WHEN p_partkey % 4 = 1 THEN '수도권 ' || CAST(p_size AS STRING)
    WHEN p_partkey % 4 = 2 THEN '분당선' ELSE '' END AS line FROM {part}
"""


@query(
    "prj13_name_keys",
    f"""WITH p AS ({NAMES.format(part='part')})
SELECT p_partkey, regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS name_key, list_last(string_split(district, ' ')) AS last_token,
  nullif(trim(regexp_replace(trim(string_split(station, ',')[1]), '(지하철역|전철역|역)$', '')), '') AS station,
  CASE WHEN line = '' THEN '' WHEN line = '분당선' THEN line ELSE regexp_extract(line, '\\d+') || '호선' END AS line FROM p""",
)
def name_keys(spark, sf_dir):
    rows = spark.sql(NAMES, part=table(spark, sf_dir, "part"))
    return rows.select(
        "p_partkey",
        P.normalize_name(F.col("name")).alias("name_key"),
        P.last_token(F.col("district")).alias("last_token"),
        P.normalize_station(F.col("station")).alias("station"),
        P.normalize_line(F.col("line")).alias("line"),
    )


WALKS = """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '도보 ' || CAST(p_size AS STRING) || '~' || CAST(p_size + 3 AS STRING) || '분'
  WHEN p_partkey % 5 = 1 THEN CAST(p_size AS STRING) || '.5 KM' WHEN p_partkey % 5 = 2 THEN '약 ' || CAST(p_size * 10 AS STRING) || 'm 이내'
  WHEN p_partkey % 5 = 3 THEN '미상' ELSE '5-' || CAST(p_size AS STRING) || ' min' END AS walk,
  p_name || ' / ' || p_type || CASE WHEN p_partkey % 2 = 0 THEN ', ,' || p_brand ELSE '' END AS facilities FROM {part}
"""


@query(
    "prj14_walk_metres",
    f"""WITH p AS ({WALKS.format(part='part')}),
n AS (SELECT *, list_max(list_transform(regexp_extract_all(walk, '\\d+(\\.\\d+)?'), lambda x: CAST(x AS DOUBLE))) AS v FROM p)
SELECT p_partkey, CAST(floor(CASE WHEN contains(walk, '분') OR contains(walk, 'min') THEN v * 80
  WHEN contains(lower(walk), 'km') THEN v * 1000 ELSE v END) AS BIGINT) AS metres FROM n""",
)
def walk_metres(spark, sf_dir):
    rows = spark.sql(WALKS, part=table(spark, sf_dir, "part"))
    return rows.select("p_partkey", P.walk_metres(F.col("walk")).alias("metres"))


@query(
    "prj15_facility_count",
    f"""WITH p AS ({WALKS.format(part='part')})
SELECT p_partkey, len(list_filter(regexp_split_to_array(facilities, '[,/|;]'), lambda x: trim(x) <> '')) AS facilities FROM p""",
)
def facility_count(spark, sf_dir):
    rows = spark.sql(WALKS, part=table(spark, sf_dir, "part"))
    return rows.select("p_partkey", P.facility_count(F.col("facilities")).cast("long").alias("facilities"))


ADDRESSES = """
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN '서울특별시  ' WHEN s_suppkey % 4 = 1 THEN '경기도 화성시 병점구 ' WHEN s_suppkey % 4 = 2
  THEN '인천광역시 ' ELSE '서울시 ' END || n_name || '  ' || CAST(s_suppkey AS STRING) || '번지' AS address
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
"""


@query(
    "prj16_canonical_address",
    f"""WITH p AS ({ADDRESSES.format(supplier='supplier', nation='nation')})
SELECT s_suppkey, regexp_replace(regexp_replace(replace(replace(replace(replace(
    regexp_replace(address, '화성시\\s+병점구\\s+', '화성시 '), '서울특별시', '서울'), '서울시', '서울'), '인천광역시', '인천'),
    '경기도', '경기'), '\\s+', ' ', 'g'), '번지$', '') AS address FROM p""",
)
def canonical_address(spark, sf_dir):
    rows = spark.sql(ADDRESSES, supplier=table(spark, sf_dir, "supplier"), nation=table(spark, sf_dir, "nation"))
    return rows.select("s_suppkey", P.canonical_address(F.col("address")).alias("address"))


REGISTER = """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN '12.5' ELSE CAST(c_custkey + 1 AS STRING) END AS tnohsh,
  CASE WHEN c_custkey % 7 = 0 THEN '0' ELSE '3' END AS whol_dong_cnt, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS apt_rdn_addr,
  CASE WHEN c_custkey % 13 = 0 THEN 'x' ELSE CAST(1700000000000 + c_custkey * 1000 AS STRING) END AS mdfcn_ymd FROM {customer}
"""


@query(
    "prj17_register_fields",
    f"""WITH r AS ({REGISTER.format(customer='customer')})
SELECT c_custkey, CASE WHEN c_custkey % 5 > 1 THEN c_custkey + 1 END AS whole_complex_households,
  CASE WHEN c_custkey % 7 <> 0 THEN 3 END AS whole_complex_buildings, nullif(apt_rdn_addr, '') AS road_address,
  CASE WHEN c_custkey % 13 <> 0 THEN CAST(epoch_ms(1700000000000 + c_custkey * 1000) AS VARCHAR) END AS source_modified_at,
  c_custkey % 5 > 1 AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AS complete FROM r""",
)
def register_fields(spark, sf_dir):
    rows = normalise.register_fields(spark.sql(REGISTER, customer=table(spark, sf_dir, "customer")))
    return rows.select(
        "c_custkey", "whole_complex_households", "whole_complex_buildings", "road_address",
        F.col("source_modified_at").cast("string").alias("source_modified_at"), "complete",
    )


@query(
    "prj18_row_keys",
    with_trades(
        DASHBOARD
        + """SELECT sha256('["' || "CGG_CD" || '","","' || "STDG_NM" || '","' || "MNO" || '","' || "SNO" || '","' || "BLDG_NM" || '"]') AS entity_key,
  CAST(CAST(strptime("CTRT_DAY", '%Y%m%d') AS DATE) AS VARCHAR) AS observed_day, "CGG_CD" AS region_code, count(*) AS n
FROM dashboard GROUP BY ALL"""
    ),
)
def row_keys(spark, sf_dir):
    return _counted(normalise.row_keys(dashboard(spark, sf_dir)), "entity_key", "observed_day", "region_code")


@query(
    "prj19_available_date",
    with_trades(
        """SELECT CAST(date AS VARCHAR) AS date, CAST(available_date AS VARCHAR) AS historical, CAST(date + 61 AS VARCHAR) AS uniform,
  count(*) AS n FROM trades GROUP BY ALL"""
    ),
)
def available_date(spark, sf_dir):
    from pricetide.functions.calendar import available_date as available

    rows = trades(spark, sf_dir).select(
        F.col("date").cast("string").alias("date"),
        available(F.col("date"), LAW_CHANGE).cast("string").alias("historical"),
        available(F.col("date"), None).cast("string").alias("uniform"),
    )
    return _counted(rows, *rows.columns)


@query(
    "prj20_relative_inputs",
    with_trades(
        SERVED
        + ", d AS ("
        + decay_sql("served")
        + """), m AS (SELECT origin, key, arg_max(log_price, (date, log_price)) AS last, median(log_price) AS median365,
  median(log_price) FILTER (WHERE age <= lag + 90) AS median90 FROM served GROUP BY ALL)
SELECT CAST(origin AS VARCHAR) AS origin, key, round(ew30 - ew90, 6) + 0.0 AS ew30, round(ew180 - ew90, 6) + 0.0 AS ew180,
  round(median365 - ew90, 6) + 0.0 AS median365, round(median90 - ew90, 6) + 0.0 AS median90 FROM d JOIN m USING (origin, key)"""
    ),
)
def relative_inputs(spark, sf_dir):
    trades = stored(clean(spark, sf_dir).select("key", "date", "log_price"))
    crowd = crowded(trades, ["key"])
    # Trades of a type meet once, before they are copied to origins; those of crowded types stay spread.
    rows = history.dealt(trades, "key") if crowd is None else trades
    served = history.history_join(rows, UNIFORM, "1995-07-01", "2001-12-01", every=6)
    ew, windows = (stats(served, crowd=crowd, counted=True) for stats in (history.ew_medians, history.window_stats))
    frame = ew.join(windows, ["origin", "key"]).withColumn("anchor", F.col("ew90"))
    frame = frame.withColumns({c: F.lit(None).cast("double") for c in history.PRICE_LEVELS if c not in frame.columns})
    return tidy(history.relative_inputs(frame).select("origin", "key", "ew30", "ew180", "median365", "median90"))


@query(
    "prj21_facet_bins",
    with_trades(
        """, t AS (SELECT DISTINCT key, built, area, area / 3.3058 AS pyeong, greatest(0, 2001 - built) AS age FROM trades)
SELECT key, age AS building_age, CASE WHEN age <= 5 THEN 'new' WHEN age <= 15 THEN 'semi_new' WHEN age <= 20 THEN 'middle'
    WHEN age < 30 THEN 'old' ELSE 'very_old' END AS age_category,
  CASE WHEN pyeong <= 14 THEN 'lte14' WHEN pyeong <= 26 THEN 'gt14_lte26' WHEN pyeong <= 34 THEN 'gt26_lte34' ELSE 'gt34' END AS area_category FROM t"""
    ),
)
def facet_bins(spark, sf_dir):
    types = summary.price_metrics(trades(spark, sf_dir)).select("key", "built", "area_pyeong").distinct()
    return scores.facet_bins(types, F.lit(2001)).select("key", "building_age", "age_category", "area_category")


def d_canonical(c):
    return f"floor(({c}) * 10000 + 0.5) / 10000"


@query(
    "prj22_score",
    with_trades(
        f""", n AS (SELECT *, {d_canonical('floor * area / 250.0')} AS f, {d_canonical('price_oku')} AS p FROM trades)
SELECT orderkey, linenumber, f AS neutral, p AS price, CASE WHEN f = p THEN 50.0 ELSE
  floor((50 + 40 * tanh(ln(f / p) / 0.2)) * 10 + 0.5) / 10 END AS score, round((1 - p / f) * 100, 6) + 0.0 AS discount_pct FROM n"""
    ),
)
def score(spark, sf_dir):
    rows = trades(spark, sf_dir).select("orderkey", "linenumber", "floor", "area", "price_oku")
    out = scores.with_score(rows, F.col("floor") * F.col("area") / 250.0, F.col("price_oku"), F.lit(0.2))
    return tidy(out.select("orderkey", "linenumber", "neutral", "price", "score", "discount_pct"))


@query(
    "prj23_grade",
    with_trades(
        f""", r AS (SELECT *, discount * 4 AS radius FROM trades)
SELECT orderkey, linenumber, CASE WHEN radius <= ln(1.1) THEN 'A' WHEN radius <= ln(1.2) THEN 'B' WHEN radius <= ln(1.35) THEN 'C' ELSE 'D' END AS grade,
  {d_canonical('price_oku * exp(-radius)')} AS lower, {d_canonical('price_oku * exp(radius)')} AS upper FROM r"""
    ),
)
def grade(spark, sf_dir):
    radius = F.col("discount") * 4
    lower, upper = scores.band(F.col("price_oku"), radius)
    return trades(spark, sf_dir).select(
        "orderkey", "linenumber", scores.grade(radius).alias("grade"), lower.alias("lower"), upper.alias("upper")
    )


RATES = {"acquisition_tax": "0.011", "buy_broker": "0.004", "sell_broker": "0.0045", "gain_tax": "0.22"}


@query(
    "prj24_cost_columns",
    with_trades(
        """, w AS (SELECT orderkey, linenumber, CAST(floor(price * 10000) AS BIGINT) AS p, CAST(floor(price * 9000) AS BIGINT) AS basis FROM trades),
b AS (SELECT *, CAST(ceil(CAST(p AS DECIMAL(18,0)) * 0.011) AS BIGINT) AS buy_tax, CAST(ceil(CAST(p AS DECIMAL(18,0)) * 0.004) AS BIGINT) AS buy_broker,
  CAST(ceil(CAST(p AS DECIMAL(18,0)) * 0.0045) AS BIGINT) AS sell_broker FROM w),
g AS (SELECT *, CAST(ceil(CAST(greatest(0, p - sell_broker - 50000 - basis) AS DECIMAL(18,0)) * 0.22) AS BIGINT) AS gain_tax FROM b)
SELECT orderkey, linenumber, p AS price_krw, buy_tax, buy_broker, p + buy_tax + buy_broker + 1100000 AS buy_total, sell_broker, gain_tax,
  p - sell_broker - gain_tax - 50000 AS sell_net FROM g"""
    ),
)
def cost_columns(spark, sf_dir):
    won = trades(spark, sf_dir).select(
        "orderkey", "linenumber", F.floor(F.col("price") * 10000).alias("price_krw"), F.floor(F.col("price") * 9000).alias("basis")
    )
    return scores.cost_columns(won, "price_krw", RATES, 100000, 50000, 1000000, "basis").drop("basis")


@query(
    "prj25_walk_time",
    """SELECT event_id, user_id + value + CASE WHEN event_type = 'error' THEN NULL ELSE event_id % 100 END AS total_m,
  (user_id + value + CASE WHEN event_type = 'error' THEN NULL ELSE event_id % 100 END) / 80 AS base_min,
  (user_id + value + CASE WHEN event_type = 'error' THEN NULL ELSE event_id % 100 END) / 90 AS fast_min,
  (user_id + value + CASE WHEN event_type = 'error' THEN NULL ELSE event_id % 100 END) / 60 AS slow_min FROM events""",
)
def walk_time(spark, sf_dir):
    parts = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "value", F.when(F.col("event_type") != "error", F.col("event_id") % 100).alias("tail")
    )
    return scores.walk_time(parts, "user_id", "value", "tail").drop("user_id", "value", "tail")


@query(
    "prj26_route_by_region",
    with_trades(
        """SELECT orderkey, linenumber, CASE WHEN gu IN ('ASIA', 'EUROPE') THEN price_oku ELSE price_oku * 2 END AS prediction,
  CASE WHEN gu IN ('ASIA', 'EUROPE') THEN 'full-history' ELSE 'legacy' END AS component_version FROM trades"""
    ),
)
def route_by_region(spark, sf_dir):
    rows = trades(spark, sf_dir).withColumns({"a": F.col("price_oku"), "b": F.col("price_oku") * 2})
    out = scores.route_by_region(rows, ["ASIA", "EUROPE"], "a", "b", ("full-history", "legacy"), region="gu")
    return out.select("orderkey", "linenumber", "prediction", "component_version")
