from pyspark.sql import functions as F

from pricetide.functions import parsing as P
from pricetide.functions import scores


def one(spark, text, *columns, schema="t string"):
    row = spark.createDataFrame([(text,)] if not isinstance(text, tuple) else [text], schema).select(*columns).first()
    return tuple(row)


def test_decimal_text_keeps_digits_and_flags(spark):
    cases = {"84.9100": ("84.9100", None), " 1,234.50 ": ("1234.50", None), "-": (None, "a_missing"), "NaN": (None, "a_invalid"),
             "-1": (None, "a_out_of_range"), "0": (None, "a_out_of_range"), "+007": ("7", None), "inf": (None, "a_invalid"), "1.": (None, "a_invalid")}
    for text, expected in cases.items():
        value, flag = P.decimal_text(F.col("t"), "a", positive=True)
        assert one(spark, text, value, flag) == expected, text
    value, flag = P.decimal_text(F.col("t"), "d", minimum=0)
    assert one(spark, "0", value, flag) == ("0", None)


def test_contract_date_rejects_impossible_days(spark):
    for (ym, d), expected in {("202302", "30"): None, ("202302", "8"): "2023-02-08", ("2023-2", "1"): None}.items():
        date, flag = P.contract_date(F.col("ym"), F.col("d"))
        got = one(spark, (ym, d), date.cast("string"), flag, schema="ym string, d string")
        assert got == (expected, None if expected else "contract_date_invalid")


def test_lots(spark):
    for (main, sub, pub), expected in {
        ("0012", "0003", "12-3"): ("12-3", None), ("0012", "0000", "-"): ("12", None), ("0012", "0000", "산12"): ("12", "lot_source_disagrees"),
        ("x", "0", "1"): (None, "lot_numbers_unresolved"), ("0000", "0000", "0"): ("0", None),
    }.items():
        lot, flag = P.normalize_lot(F.col("m"), F.col("s"), F.col("p"))
        assert one(spark, (main, sub, pub), lot, flag, schema="m string, s string, p string") == expected, (main, sub, pub)


def test_special_parcels(spark):
    for (pub, main, sub), expected in {
        ("산12-3", "0012", "0003"): ("산12", "3", True), ("가-7", "0007", "0000"): ("가", "7", True), ("BL-", "0000", "0000"): ("BL", "", True),
        ("산13", "0012", "0000"): ("12", "", False), ("12-3", "0012", "0003"): ("12", "3", False),
    }.items():
        got = one(spark, (pub, main, sub), *P.export_parcel(F.col("p"), F.col("m"), F.col("s")), schema="p string, m string, s string")
        assert got == expected, pub


def test_text_helpers(spark):
    assert one(spark, "84.9100", P.area_text(F.col("t"))) == ("84.91",)
    assert one(spark, "100", P.area_text(F.col("t"))) == ("100",)
    assert one(spark, "강남지하철역, 역삼역", P.normalize_station(F.col("t"))) == ("강남",)
    assert one(spark, " 2 호선", P.normalize_line(F.col("t"))) == ("2호선",)
    assert one(spark, "도보 5~10분 이내", P.walk_metres(F.col("t"))) == (800,)
    assert one(spark, "1.2km", P.walk_metres(F.col("t"))) == (1200,)
    assert one(spark, "없음", P.walk_metres(F.col("t"))) == (None,)
    assert one(spark, ", /", P.facility_count(F.col("t"))) == (1,)
    assert one(spark, "", P.facility_count(F.col("t"))) == (None,)
    assert one(spark, "경기도 화성시 병점구 진안동  12번지", P.canonical_address(F.col("t"))) == ("경기 화성시 진안동 12",)
    assert one(spark, "-1+2", P.formula_guard(F.col("t"))) == ("'-1+2",)
    assert one(spark, "inf", P.number_or_null(F.col("t"))) == (None,)


def test_score_golden_values(spark):
    df = spark.createDataFrame([(0.5181, 0.52, 0.08), (0.52, 0.52, 0.08), (-1.0, 0.5, 0.1), (0.5, float("nan"), 0.1), (0.5, 0.4, 0.0)], "f double, p double, s double")
    got = [(r["score"], None if r["discount_pct"] is None else round(r["discount_pct"], 2)) for r in scores.with_score(df, F.col("f"), F.col("p"), F.col("s")).collect()]
    assert got[0] == (48.2, -0.37)
    assert got[1] == (50.0, 0.0)
    assert [g[0] for g in got[2:]] == [None, None, None]


def test_score_falls_as_the_price_rises(spark):
    df = spark.range(1, 200).select((F.col("id") / 20).alias("p"))
    rows = scores.with_score(df, F.lit(5.0), F.col("p"), F.lit(0.3)).orderBy("price").collect()
    values = [r["score"] for r in rows]
    assert values == sorted(values, reverse=True)


def test_grades_and_charges(spark):
    assert one(spark, 0.05, scores.grade(F.col("t")), schema="t double") == ("A",)
    assert one(spark, 0.4, scores.grade(F.col("t")), schema="t double") == ("D",)
    assert one(spark, 1000001, scores.charge(F.col("t"), "0.004"), schema="t long") == (4001,)
