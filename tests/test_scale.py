"""Steps that grew faster than their input: what moves, what is read again, and equal results."""

import contextlib
import datetime as dt

import pytest
from pyspark.sql import functions as F

from pricetide.functions import parsing as P
from pricetide.operators import dashboard, normalise, summary
from pricetide.sources import sinks


def test_rows_meet_decided_addresses_where_they_are(spark):
    """Before, the size of the decided addresses was unknown, and all rows of an address moved to one task."""
    rows = spark.range(3_000_000).select(F.concat(F.lit("A B DONG"), (F.col("id") % 7).cast("string")).alias("address_text"), "id")
    registry = spark.createDataFrame([("1", "A", "B")], "code string, sido string, district string")
    out = normalise.match_address(rows, registry)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert out.groupBy("address_match").count().collect()[0].asDict() == {"address_match": "unique_exact_registry_name", "count": 3_000_000}


def test_odd_numbers_lots_and_days(spark):
    value, flag = P.decimal_text(F.col("t"), "a")
    rows = {"000.5": ("0.5", None), "-007": ("-7", None), "-0": ("-0", None), "+0": ("0", None), "0\n": ("0\n", None), "+-5": (None, "a_invalid"), "--": (None, "a_missing")}
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", value, flag).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == rows
    days = spark.createDataFrame([("20000229",), ("20010229",), ("2000-2-9",), ("20000101\n",), (None,)], "t string")
    assert [r[0] for r in days.select(P.compact_date(F.col("t")).cast("string")).collect()] == ["2000-02-29", None, None, None, None]


def test_paging_reads_its_rows_once(spark):
    """Before, every step computed the rows again."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(200).select("id", (F.col("id") % 5).alias("n")).mapInArrow(count, "id long, n long")
    got = dashboard.paginate(rows, [("n", "desc")], ["id"], page=2, size=50).orderBy("position").collect()
    assert [r["id"] for r in got] == sorted((k for k in range(200)), key=lambda k: (-(k % 5), k))[50:100]
    assert seen.value == 200


RULES = summary.Attributes(order=("date", "price"), nearest={"school_m": ["school"]}, first_known=["built"])


def _trades(spark):
    rows = [("g", None if k % 9 == 0 else "d", f"c{k % 3}", f"k{k % 3}", None if k % 10 == 0 else 2000 + k % 2, f"2000-01-{k % 28 + 1:02d}", float(k * 37 % 101), None if k % 4 == 0 else float(k % 13), k % 5, f"s{k}", 1990 + k % 7)
            for k in range(240)]
    return spark.createDataFrame(rows, "gu string, dong string, complex string, key string, year int, date string, price double, floor double, school_m int, school string, built int")


def test_type_summary_reads_its_trades_once(spark):
    """Before, statistics and medians each computed the trades."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = _trades(spark)
    summary.type_summary(df.mapInArrow(count, df.schema), attributes=RULES).collect()
    assert seen.value == 240


def test_type_summary_of_crowded_types(spark, monkeypatch):
    import statistics

    df = _trades(spark)
    plain = {(r["dong"], r["bucket"], r["key"]): r for r in summary.type_summary(df, attributes=RULES).collect()}
    monkeypatch.setattr(summary, "crowded", lambda rows, by: rows.groupBy(*by).count().where("count > 30").select(*by))
    crowded = {(r["dong"], r["bucket"], r["key"]): r for r in summary.type_summary(df, attributes=RULES).collect()}
    assert plain == crowded and len(plain) > 12
    values = [r["price"] for r in df.where("dong = 'd' AND key = 'k1' AND year IS NOT NULL").collect()]
    assert plain["d", "all", "k1"]["price_median"] == statistics.median(values)
    assert plain["d", "all", "k1"]["n"] == df.where("dong = 'd' AND key = 'k1'").count()


@pytest.mark.parametrize("open_files", [128, 2])
def test_canonical_records_are_written_compiled_and_unsorted(spark, tmp_path, monkeypatch, open_files):
    """Before, the records' parsers ran in methods too long to be compiled, and every task sorted its wide rows by folder."""
    names = ("spark.sql.codegen.hugeMethodLimit", "spark.sql.maxConcurrentOutputFileWriters")
    before, inside, real = [spark.conf.get(n) for n in names], [], sinks.compiled

    @contextlib.contextmanager
    def noted(*args):
        with real(*args):
            inside.append([spark.conf.get(n) for n in names])
            yield

    monkeypatch.setattr(sinks, "compiled", noted)
    monkeypatch.setattr(sinks, "OPEN_FILES", open_files)
    rows = [("sale", (f"s{k % 3}" if k % 4 else None,), None if k % 5 == 0 else dt.date(2000 + k % 6, 1, 1), k) for k in range(300)]
    records = spark.createDataFrame(rows, "kind string, address struct<sido: string>, contract_date date, k long")
    sinks.write_canonical(records, f"{tmp_path}/out", rows_per_file=4)
    assert inside == [["8000", str(open_files)]] and [spark.conf.get(n) for n in names] == before
    back = spark.read.schema("k long, kind string, sido string, year string").json(f"{tmp_path}/out").collect()
    assert sorted((r["k"], r["sido"], r["year"]) for r in back) == [(k, a[0] or "unresolved", str(d.year) if d else "unknown") for _, a, d, k in rows]


def test_annual_types_read_their_trades_once(spark, monkeypatch):
    """Before, medians and facts each computed the trades.  Crowded keys and pools give the same panel."""
    import statistics

    from pricetide.operators import annual, stats
    from pricetide.plans import joins

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [("s", "g", f"d{k % 2}", None if k % 31 == 0 else f"k{k % 6}", f"c{k % 3}", 2000 + k % 4, 1990 + k % 3, 15 + 10 * (k % 6), None if k % 17 == 0 else float(k * 37 % 101)) for k in range(400)]
    df = spark.createDataFrame(rows, "sido string, gu string, dong string, key string, complex string, year int, built int, area int, price double")
    monkeypatch.setattr(joins, "clean", lambda spark, sf_dir: df.mapInArrow(count, df.schema))
    pool = lambda: sorted(map(str, annual.matched_peer(annual.annual_panel(joins.annual_types(spark, ""))).collect()))
    types = {(r["key"], r["year"]): r for r in joins.annual_types(spark, "").collect()}
    assert seen.value == 400
    for (key, year), r in types.items():
        mine = [x for x in rows if x[3] == key and x[5] == year and x[8] is not None]
        assert r["n"] == len(mine) and r["built"] == mine[0][6] and abs(r["area"] - mine[0][7] / 3.3058) < 1e-12
        assert abs(r["price"] - statistics.median(x[8] / (x[7] / 3.3058) for x in mine)) < 1e-9
    plain = pool()
    for module in (joins, annual):
        monkeypatch.setattr(module, "crowded", lambda rows, by: stats.crowded(rows, by, 3))
    assert pool() == plain and plain


def test_counted_histories_take_one_shuffle(spark):
    """Before, either statistic counted its values bin by bin and joined them again; crowded keys still do."""
    from pricetide.operators import history

    rows = [(f"k{k % 5}", None if k % 41 == 0 else dt.date(2000, 1, 1) + dt.timedelta(k * 7 % 400), None if k % 29 == 0 else float(k * 37 % 101) / 10) for k in range(600)]
    t = spark.createDataFrame(rows, "key string, date date, log_price double")
    served = lambda rows: history.history_join(rows, history.Lag(uniform=31), "2000-01-01", "2001-12-01", every=6)
    hot = spark.createDataFrame([("k1",)], "key string")
    for stats in (history.ew_medians, history.window_stats):
        one = stats(served(history.dealt(t, "key")), counted=True)
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(origin" not in plan and "Join" not in plan
        told = lambda df: sorted(map(str, df.collect()))
        assert told(one) == told(stats(served(t))) == told(stats(served(t), crowd=hot, counted=True)) and one.count() > 10
