"""The driver's star-schema tables seen as property transactions.

One DataFrame function and one SQL common table expression per view, so that
every operator can be checked value by value against DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Reporting-law change date used with the driver tables (day / ISO text).
LAW_CHANGE = "1998-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transactions, cancelled and direct ones included."""
    t = lambda name: table(spark, sf_dir, name)
    wide = (
        t("lineitem")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    area = (F.floor(F.col("p_size") / 10) * 10 + 5).cast("int")
    complex_ = F.col("l_suppkey").cast("string")
    date = F.to_date("l_shipdate")
    return wide.select(
        complex_.alias("complex"),
        area.alias("area"),
        F.concat_ws("|", complex_, area.cast("string")).alias("key"),
        F.col("n_name").alias("dong"),
        F.col("r_name").alias("gu"),
        F.lit("ALL").alias("sido"),
        F.concat_ws(":", F.col("r_name"), F.floor(area / 15).cast("string")).alias("peer"),
        date.alias("date"),
        F.unix_date(date).alias("day"),
        F.year(date).alias("year"),
        F.date_format(date, "yyyy-MM").alias("month"),
        F.year("o_orderdate").alias("receipt_year"),
        F.col("l_extendedprice").alias("price"),
        F.ln(F.col("l_extendedprice") / area).alias("log_price"),
        (F.col("l_extendedprice") / 10000).alias("price_oku"),
        F.col("l_quantity").alias("floor"),
        (F.col("l_returnflag") == "R").alias("cancelled"),
        (F.col("o_orderpriority") == "5-LOW").alias("direct"),
        (1980 + F.col("l_suppkey") % 15).cast("int").alias("built"),
        F.date_add(date, F.when(date < F.lit(LAW_CHANGE).cast("date"), 61).otherwise(31)).alias("available_date"),
        F.col("l_tax").alias("tax"),
        F.col("l_discount").alias("discount"),
        F.col("l_linestatus").alias("linestatus"),
        F.col("o_orderpriority").alias("priority"),
        F.col("p_name").alias("building_name"),
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_linenumber").alias("linenumber"),
        F.col("l_partkey").alias("partkey"),
        F.to_date("o_orderdate").alias("order_date"),
    )


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions that are neither cancelled nor direct."""
    return trades(spark, sf_dir).where(~F.col("cancelled") & ~F.col("direct"))


TRADES_SQL = f"""
trades AS (
  SELECT *, ln(price / area) AS log_price, price / 10000 AS price_oku,
    CAST(complex AS VARCHAR) || '|' || CAST(area AS VARCHAR) AS key,
    gu || ':' || CAST(area // 15 AS VARCHAR) AS peer,
    date - DATE '1970-01-01' AS day,
    CAST(year(date) AS INTEGER) AS year, strftime(date, '%Y-%m') AS month,
    date + CASE WHEN date < DATE '{LAW_CHANGE}' THEN 61 ELSE 31 END AS available_date
  FROM (
    SELECT CAST(l_suppkey AS VARCHAR) AS complex, CAST((p_size // 10) * 10 + 5 AS INTEGER) AS area,
      n_name AS dong, r_name AS gu, 'ALL' AS sido, CAST(l_shipdate AS DATE) AS date,
      CAST(year(o_orderdate) AS INTEGER) AS receipt_year, l_extendedprice AS price, l_quantity AS floor,
      l_returnflag = 'R' AS cancelled, o_orderpriority = '5-LOW' AS direct,
      CAST(1980 + l_suppkey % 15 AS INTEGER) AS built, l_tax AS tax, l_discount AS discount,
      l_linestatus AS linestatus, o_orderpriority AS priority, p_name AS building_name,
      l_orderkey AS orderkey, l_linenumber AS linenumber, l_partkey AS partkey,
      CAST(o_orderdate AS DATE) AS order_date
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
      JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey)),
clean AS (SELECT * FROM trades WHERE NOT cancelled AND NOT direct)
"""


def with_trades(body: str) -> str:
    """Prefix a SELECT (or further CTEs starting with a comma) with the views."""
    body = body.strip()
    return "WITH " + TRADES_SQL.strip() + ("" if body.startswith(",") else "\n") + body


# --- Text exports derived from the transactions.  Each SELECT is valid in both
# --- dialects and reads the relation named in braces, so it is written once.

SALE_EXPORT = """
SELECT CAST(orderkey AS STRING) AS no,
  gu || ' ' || dong || ' DONG' || CAST(partkey % 7 AS STRING) AS address_text,
  CASE WHEN linenumber = 7 THEN CAST(partkey AS STRING) WHEN linenumber = 6 THEN '산' || CAST(built AS STRING)
    WHEN linenumber = 5 THEN '-' ELSE CAST(built AS STRING) || '-' || CAST(partkey % 3 AS STRING) END AS lot,
  lpad(CAST(built AS STRING), 6, '0') AS main, lpad(CAST(partkey % 3 AS STRING), 4, '0') AS sub,
  CASE WHEN tax = 0.0 THEN '-' ELSE building_name END AS building,
  CASE WHEN linenumber = 4 THEN CAST(area AS STRING) || '.9100' ELSE CAST(area AS STRING) || '.50' END AS area,
  CASE WHEN linenumber = 1 AND tax = 0.01 THEN 'NaN' WHEN linenumber = 2 AND tax = 0.01 THEN '-'
    WHEN linenumber = 3 AND tax = 0.01 THEN '0' WHEN linenumber = 4 AND tax = 0.01 THEN '-1'
    ELSE CAST(CAST(floor(price / 1000) AS INT) AS STRING) || ',' || right(CAST(CAST(price AS DECIMAL(18,2)) AS STRING), 6) END AS amount,
  replace(substr(CAST(date AS STRING), 1, 7), '-', '') AS contract_month,
  CASE WHEN discount = 0.08 THEN '31' ELSE CAST(CAST(substr(CAST(date AS STRING), 9, 2) AS INT) AS STRING) END AS contract_day,
  CAST(CAST(floor AS INT) AS STRING) AS floor, CAST(built AS STRING) AS built,
  CASE WHEN cancelled THEN CAST(date AS STRING) WHEN linenumber = 2 THEN '-' ELSE '' END AS cancelled_on,
  CASE WHEN direct THEN '직거래' WHEN priority = '1-URGENT' THEN '-' WHEN priority = '2-HIGH' THEN '교환'
    ELSE '중개거래' END AS deal_type,
  dong AS agent, gu AS source_id, orderkey AS row_number, '2002-01-01' AS observed_at,
  CASE WHEN partkey % 50 = 0 THEN 'ASIA' ELSE gu END AS source_sido,
  CAST('1995-06-01' AS DATE) AS source_start, CAST('2001-06-30' AS DATE) AS source_end
FROM {trades}
"""

LEASE_EXPORT = """
SELECT address_text, lot, main, sub, building, area, contract_month, contract_day, floor, built, source_id, row_number,
  observed_at, source_sido, source_start, source_end, amount AS deposit,
  CASE WHEN linestatus = 'F' THEN '0' ELSE CAST(CAST(tax * 100 AS INT) AS STRING) END AS monthly_rent,
  CASE WHEN linenumber = 1 THEN '월세' WHEN linenumber = 2 THEN '' ELSE '전세' END AS lease_type,
  CASE WHEN linestatus = 'F' THEN '신규' WHEN direct THEN '갱신' ELSE '-' END AS contract_type,
  CASE WHEN direct THEN '1,000' ELSE '-' END AS previous_deposit, '' AS previous_monthly_rent,
  CASE WHEN linenumber = 7 THEN '연립' ELSE '아파트' END AS property_type
FROM ({sales})
"""

REGISTRY = """
SELECT CAST(n_nationkey AS STRING) AS code, r_name AS sido, n_name AS district
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE n_nationkey <> 9
UNION ALL SELECT 'L' || CAST(n_nationkey AS STRING), r_name, n_name || ' DONG3' FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT 'D' || CAST(n_nationkey AS STRING), r_name, n_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
WHERE n_nationkey = 7
"""


def _with_extra(text: str, *columns: str) -> str:
    return text.replace("FROM {trades}", "".join(f", {c}" for c in columns) + " FROM {trades}", 1)


def sale_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SALE_EXPORT, trades=trades(spark, sf_dir))


_SALES_FOR_LEASES = _with_extra(SALE_EXPORT, "linestatus", "linenumber", "tax", "direct")


def lease_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LEASE_EXPORT.replace("{sales}", _SALES_FOR_LEASES), trades=trades(spark, sf_dir))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REGISTRY, nation=table(spark, sf_dir, "nation"), region=table(spark, sf_dir, "region"))


EXPORT_SQL = f"""
, sales AS ({SALE_EXPORT.format(trades='trades')}),
registry AS ({REGISTRY.format(nation='nation', region='region')})
"""
LEASE_SQL = f"""
, leases AS ({LEASE_EXPORT.replace('{sales}', _SALES_FOR_LEASES).replace('{trades}', 'trades')})
"""
