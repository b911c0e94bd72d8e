import csv
import os

import pytest
from pyspark.sql import functions as F

from pricetide.operators import normalise
from pricetide.session import scratch_path
from pricetide.sources import readers, sinks

PREAMBLE = ["안내", "계약일자 : 2023-01-01 ~ 2023-12-31", "실거래구분 : 아파트(매매)", "주소구분 : 지번주소", "시도 : 경기도", "시군구 : 전체", "읍면동 : 전체", "면적 : 전체", "금액선택 : 전체"]


def export_text(rows):
    header = ",".join(f'"{h}"' for h in normalise.SALE_HEADERS)
    lines = [f'"{p}"' for p in PREAMBLE] + [header]
    for r in rows:
        lines.append(",".join(f'"{r.get(n, "")}"' for n in normalise.SALE_HEADERS.values()))
    return "\n".join(lines + ["", ""])


SALE = dict(no="1", address_text="경기도 화성시 병점구 진안동", lot="산12", main="0012", sub="0000", building="한신", area="84.9100", contract_month="202302",
            contract_day="8", amount="52,000", floor="3", built="1999", cancelled_on="-", deal_type="중개거래", agent="경기 화성시")


@pytest.fixture()
def folder(spark, tmp_path):
    return str(tmp_path)


@pytest.mark.parametrize("encoding,spark_name", [("utf-8-sig", "UTF-8"), ("cp949", "x-windows-949")])
def test_export_reader_finds_the_header_and_numbers_rows(spark, folder, encoding, spark_name):
    rows = [SALE, {**SALE, "no": "2", "contract_day": "30"}, SALE]
    with open(os.path.join(folder, "a.csv"), "w", encoding=encoding) as f:
        f.write(export_text(rows))
    got = readers.read_export(spark, folder, "sale", spark_name).orderBy("row_number").collect()
    assert [(r["row_number"], r["no"], r["amount"], r["building"]) for r in got] == [(1, "1", "52,000", "한신"), (2, "2", "52,000", "한신"), (3, "1", "52,000", "한신")]
    assert got[0]["raw"]["거래금액(만원)"] == "52,000"
    scope = readers.proven_scope(readers.export_scope(spark, folder, "sale", spark_name), "sale").first()
    assert (scope["sido"], str(scope["start"]), scope["proven"]) == ("경기도", "2023-01-01", True)


def test_missing_header_raises(spark, folder):
    with open(os.path.join(folder, "a.csv"), "w", encoding="utf-8") as f:
        f.write("a,b,c\n1,2,3\n")
    with pytest.raises(Exception, match="no line of the file is a header"):
        readers.read_export(spark, folder, "sale").collect()


def canonical(spark, rows):
    df = spark.createDataFrame([{**SALE, **r} for r in rows]).withColumns(
        {"source_id": F.lit("s"), "row_number": F.monotonically_increasing_id(), "observed_at": F.lit("2024-01-01"), "source_sido": F.lit("경기도"),
         "source_start": F.lit("2023-01-01").cast("date"), "source_end": F.lit("2023-12-31").cast("date")}
    )
    registry = spark.createDataFrame([("41590", "경기도", "화성시"), ("41595", "경기도", "화성시 병점구"), ("1", "경기도", "쌍둥이시"), ("2", "경기도", "쌍둥이시")], "code string, sido string, district string")
    return normalise.normalize_sale(df, registry)


def test_longest_registry_name_wins_and_ambiguity_is_flagged(spark):
    rows = canonical(spark, [{}, {"address_text": "경기도 화성시 남양읍"}, {"address_text": "경기도 쌍둥이시 가동"}, {"address_text": "경기도 화성시"}]).collect()
    got = {r["address"]["as_published"]: (r["address"]["match"], r["address"]["district_code"]) for r in rows}
    assert got["경기도 화성시 병점구 진안동"] == ("unique_exact_registry_name", "41595")
    assert got["경기도 화성시 남양읍"] == ("unique_exact_registry_name", "41590")
    assert got["경기도 쌍둥이시 가동"] == ("ambiguous", None)
    assert got["경기도 화성시"] == ("unresolved", None)


def test_flags_tristate_and_rejection_reason(spark):
    rows = canonical(spark, [{"lot": "12", "deal_type": "-", "amount": "NaN", "contract_day": "31"}])
    r = rows.first()
    assert r["quality_flags"] == ["contract_date_invalid", "deal_type_unknown", "amount_invalid"]
    assert r["direct_trade"] is None and r["cancelled"] is False
    accepted, rejected = normalise.to_dashboard(rows)
    assert accepted.count() == 0
    assert rejected.first()["reason"] == "amount_invalid|contract_date_invalid"


def test_raw_equals_used_plus_exclusions(spark):
    rows = canonical(spark, [{"lot": "12"}] * 3 + [{"lot": "12", "cancelled_on": "20230301"}, {"lot": "12", "deal_type": "직거래"}])
    accepted, _ = normalise.to_dashboard(rows)
    typed, quality = normalise.clean_trades(accepted)
    q = quality.first()
    assert (q["raw_rows"], q["used_rows"], q["cancelled"], q["direct_excluded"]) == (5, 3, 1, 1)
    assert {r["key"] for r in typed.collect()} == {"화성시 병점구 진안동 12 한신 | 84.91㎡"}
    assert typed.count() == 3


def test_trade_csv_round_trip_and_changed_header(spark, folder):
    accepted, _ = normalise.to_dashboard(canonical(spark, [{"lot": "12"}]))
    path = scratch_path(spark, "test-trades")
    accepted.write.option("header", True).option("emptyValue", "").csv(path)
    assert readers.read_trades(spark, path).collect() == accepted.collect()
    with open(os.path.join(folder, "bad.csv"), "w") as f:
        f.write(",".join(reversed(normalise.DASHBOARD_COLUMNS)) + "\n" + "," * 20 + "\n")
    with pytest.raises(Exception):
        readers.read_trades(spark, folder).collect()


def test_xml_items_know_both_cancellation_schemas(spark, folder):
    items = "".join(f"<item><dealYear>2023</dealYear><dealMonth>2</dealMonth><dealDay>8</dealDay><dealAmount>52,000</dealAmount><jibun>12-3</jibun>{x}</item>"
                    for x in ("<cdealType>O</cdealType>", "<cancelDealDate>20230301</cancelDealDate>", "<cdealDay>-</cdealDay>"))
    with open(os.path.join(folder, "a.xml"), "w", encoding="utf-8") as f:
        f.write(f"<response><items>{items}</items></response>")
    rows = readers.read_xml_items(spark, folder).collect()
    assert sorted(r["RTRCN_DAY"] for r in rows) == ["", "20230301", "cancelled"]
    assert {(r["CTRT_DAY"], r["MNO"], r["SNO"], r["THING_AMT"]) for r in rows} == {("20230208", "12", "3", "52000")}


def test_index_sheet_inherits_years_and_rejects_bad_months(spark):
    sheet = lambda rows: spark.createDataFrame(rows, "line int, token string, A string, B string")
    good = sheet([(1, "'99.12", "10", "x"), (2, "2000.1", "11", ""), (3, "2", "12", "-3"), (4, "note", "1", "1")])
    got = sorted((str(r["period"]), r["gu"], r["value"]) for r in readers.unpivot_index(good, "token", "line", ["A", "B"], "sale").collect())
    assert got == [("1999-12-01", "A", 10.0), ("2000-01-01", "A", 11.0), ("2000-02-01", "A", 12.0)]
    with pytest.raises(Exception, match="invalid index month"):
        readers.unpivot_index(sheet([(1, "2000.13", "1", "1")]), "token", "line", ["A", "B"], "sale").collect()


def test_sinks_refuse_existing_output_and_keep_every_row(spark):
    path = scratch_path(spark, "test-sink")
    rows = spark.range(0, 30).select((F.col("id") % 3).cast("string").alias("month"), F.col("id").alias("v"))
    manifest = sinks.export_months(rows, path)
    assert {r["month"]: r["rows"] for r in manifest.collect()} == {"0": 10, "1": 10, "2": 10}
    with pytest.raises(Exception):
        sinks.export_months(rows, path)
    with pytest.raises(ValueError):
        sinks.export_months(rows, path + "-b", max_rows=9)
    catalog, facts = sinks.publish_bundle(rows.withColumn("n", F.lit(1)), ["month"], ["v", "n"], "month")
    assert catalog.count() == 3 and sinks.decode_bundle(catalog, facts.drop("month")).count() == 30


def export_of(folder, lines, name="a.csv"):
    header = ",".join(f'"{h}"' for h in normalise.SALE_HEADERS)
    with open(os.path.join(folder, name), "w", encoding="utf-8", newline="") as f:
        f.write("\n".join([f'"{p}"' for p in PREAMBLE] + [header, *lines]) + "\n")


def cells(**changes):
    return ",".join(f'"{ {**SALE, **changes}.get(n, "")}"' for n in normalise.SALE_HEADERS.values())


@pytest.mark.parametrize("line", [cells() + ',"more"', cells().rsplit(",", 1)[0], '"only one"'])
def test_export_record_of_another_width_raises(spark, folder, line):
    export_of(folder, [cells(), line, cells()])
    with pytest.raises(Exception, match="more or fewer cells"):
        readers.read_export(spark, folder, "sale").collect()


def test_export_header_with_a_repeated_name_raises(spark, folder):
    with open(os.path.join(folder, "a.csv"), "w", encoding="utf-8") as f:
        f.write(",".join(f'"{h}"' for h in [*normalise.SALE_HEADERS, "계약일"]) + "\n" + cells() + ',"8"\n')
    with pytest.raises(Exception, match="names a column twice"):
        readers.read_export(spark, folder, "sale").collect()


@pytest.mark.parametrize("text,message", [(cells(agent='a" b'), "never closed"), (cells(agent='a" b "c'), "text around"), (cells() + "x", "text around")])
def test_export_with_stray_quotes_raises(spark, folder, text, message):
    export_of(folder, [cells(), text])
    with pytest.raises(Exception, match=message):
        readers.read_export(spark, folder, "sale").collect()


def test_undecodable_export_raises(spark, folder):
    export_of(folder, [cells()])
    with open(os.path.join(folder, "a.csv"), "ab") as f:
        f.write(b'"\xff\xfe"\n')
    with pytest.raises(Exception, match="(?i)utf-?8"):
        readers.read_export(spark, folder, "sale").collect()


@pytest.mark.parametrize("size", ["64", "300", "100000"])
def test_quoted_breaks_and_quotes_are_joined_across_splits(spark, folder, size):
    """However a file is cut into splits, its records are those of the standard reader."""
    agents = ["plain", "two\nlines", 'with ""quotes""', "a\n\n\nb,c\r\n", ' "" \n "" ', "x" * 500 + "\n" + "y" * 500, "", "\n"]
    body = [cells(no=str(k), agent=agents[k % len(agents)]) for k in range(40)]
    body.insert(7, "")
    body.insert(20, "," * (len(normalise.SALE_HEADERS) - 1))
    export_of(folder, body)
    with open(os.path.join(folder, "a.csv"), encoding="utf-8", newline="") as f:
        rows = [r for r in csv.reader(f, strict=True)][len(PREAMBLE) + 1 :]
    names = list(normalise.SALE_HEADERS)
    want = [dict(zip(names, r, strict=True)) for r in rows if any(c.strip() for c in r)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = readers.read_export(spark, folder, "sale").orderBy("row_number").collect()
        scope = readers.proven_scope(readers.export_scope(spark, folder, "sale"), "sale").first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["row_number"] for r in got] == list(range(1, 41))
    assert [r["raw"] for r in got] == want
    assert scope["proven"] and scope["sido"] == "경기도"


def test_other_charsets_need_a_session_that_allows_them(spark, folder):
    export_of(folder, [cells()])
    spark.conf.set("spark.sql.legacy.javaCharsets", "false")
    try:
        with pytest.raises(ValueError, match="javaCharsets"):
            readers.read_export(spark, folder, "sale", "x-windows-949")
    finally:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def test_lines_of_plain_files_stay_where_they_are(spark, folder):
    with open(os.path.join(folder, "plain.csv"), "w") as f:
        f.write('"a","b"\n"1","x ""y"""\n')
    plain = readers._records(spark, folder, "UTF-8")
    assert "Window" not in plain._jdf.queryExecution().optimizedPlan().toString()
    with open(os.path.join(folder, "several.csv"), "w") as f:
        f.write('"a","b"\n"1","x\ny"\n"2",""\n')
    got = [r["cells"] for r in readers._records(spark, folder, "UTF-8").orderBy("file", "_block", "_line").collect()]
    assert got == [["a", "b"], ["1", 'x "y"'], ["a", "b"], ["1", "x\ny"], ["2", ""]]


def test_canonical_records_are_compressed(spark, tmp_path):
    rows = canonical(spark, [{"lot": "12"}])
    sinks.write_canonical(rows, str(tmp_path / "out"))
    files = [f for _, _, fs in os.walk(tmp_path / "out") for f in fs if f.startswith("part-")]
    assert files and all(f.endswith(".json.gz") for f in files)


@pytest.mark.parametrize("text,want", [
    ('"a","b"', ["a", "b"]), ('"a","","b"', ["a", "", "b"]), ('"a",",","b"', ["a", ",", "b"]), ('"","",""', ["", "", ""]), ('""', [""]), ('","', [","]), ('',  [""]), (",,", ["", "", ""]), ("a,b\r", ["a", "b"]),
    ('"a\r","b"\r', ["a\r", "b"]), ('"a","b""c"', ["a", 'b"c']), ('a,"b"', ["a", "b"]), ('"","a""",""', ["", 'a"', ""]), ('""""', ['"']), ('"",""""', ["", '"']), ('"a""b"', ['a"b']), ('"""",""', ['"', ""]), (None, None),
    ('"a" ,"b"', "text around"), ('a"","b', "text around"), ('"a"b","c"', "text around"), ('"', "text around"), ('x"a","b"', "text around"),
])
def test_records_are_cut_as_the_standard_reader_does(spark, text, want):
    one = spark.createDataFrame([("f", 0, 0, text)], "file string, _block long, _line long, _text string")
    if isinstance(want, str):
        with pytest.raises(Exception, match=want):
            readers._cells(one).collect()
    else:
        assert readers._cells(one).first()["cells"] == want
        assert text is None or text == "" or "\r" in text or [want] == list(csv.reader([text], strict=True))


def test_headers_are_found_without_moving_or_matching_every_record(spark, folder):
    """Before, all records met their file's header in one task a file, and each was cut into cells twice over."""
    export_of(folder, [cells(), cells(building='""'), cells(building="", agent=" ")])
    rows = readers._with_header(readers._records(spark, folder, "UTF-8"))
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert rows.where("cells[0] = '1'").count() == 3
