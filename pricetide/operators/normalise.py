"""From published rows to typed, flagged, identity-keyed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions import parsing as P
from pricetide.session import stored

# Published Korean headers and the column names used here (fixed values).
SALE_HEADERS = {
    "NO": "no", "시군구": "address_text", "번지": "lot", "본번": "main", "부번": "sub", "단지명": "building",
    "전용면적(㎡)": "area", "계약년월": "contract_month", "계약일": "contract_day", "거래금액(만원)": "amount",
    "동": "block", "층": "floor", "매수자": "buyer", "매도자": "seller", "건축년도": "built", "도로명": "road",
    "해제사유발생일": "cancelled_on", "거래유형": "deal_type", "중개사소재지": "agent", "등기일자": "registered_on",
}
LEASE_HEADERS = {
    "NO": "no", "시군구": "address_text", "번지": "lot", "본번": "main", "부번": "sub", "단지명": "building",
    "전월세구분": "lease_type", "전용면적(㎡)": "area", "계약년월": "contract_month", "계약일": "contract_day",
    "보증금(만원)": "deposit", "월세금(만원)": "monthly_rent", "층": "floor", "건축년도": "built", "도로명": "road",
    "계약기간": "period", "계약구분": "contract_type", "갱신요구권 사용": "renewal_right",
    "종전계약 보증금(만원)": "previous_deposit", "종전계약 월세(만원)": "previous_monthly_rent", "주택유형": "property_type",
}
APARTMENT, DIRECT, BROKERED = "아파트", "직거래", "중개거래"

# Flags that keep a sale out of the dashboard table (fixed values).
BLOCKING_FLAGS = (
    "address_unresolved", "address_ambiguous", "source_sido_mismatch",
    "contract_date_invalid", "contract_date_outside_request",
    "area_missing", "area_invalid", "area_out_of_range",
    "amount_missing", "amount_invalid", "amount_out_of_range",
    "lot_numbers_unresolved", "lot_source_disagrees", "building_name_missing",
    "cancellation_status_unavailable",
)
# The 21 columns of the dashboard trade table, in order (fixed values).
DASHBOARD_COLUMNS = (
    "RCPT_YR CGG_CD CGG_NM STDG_CD STDG_NM LOTNO_SE LOTNO_SE_NM MNO SNO BLDG_NM CTRT_DAY THING_AMT "
    "ARCH_AREA LAND_AREA FLR RGHT_SE RTRCN_DAY ARCH_YR BLDG_USG DCLR_SE OPBIZ_RESTAGNT_SGG_NM"
).split()


def match_address(df: DataFrame, registry: DataFrame, address: str = "address_text") -> DataFrame:
    """Longest exact registry name that is a word-boundary prefix of the address.

    ``registry`` has code, sido, district.  Adds district_code, sido, district,
    legal_dong and ``address_match`` (unique / ambiguous / unresolved).  Prefixes
    are generated once per distinct address and meet the registry in an equi
    join, so the registry is never scanned per row.  What is decided is stored:
    its size is known before the rows meet it, and as long as addresses are few
    rows don't move to one task per address.
    """
    text = F.trim(F.col(address))
    distinct = df.select(text.alias("_a")).where(F.col("_a").isNotNull()).distinct()
    words = F.split("_a", " ", -1)
    last = F.size(words) - 1
    prefixes = distinct.where(last >= 1).select(
        "_a",
        F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, 1, i), " "))).alias("_p"),
    )
    names = registry.select("code", "sido", "district", F.concat_ws(" ", "sido", "district").alias("_p")).distinct()
    found = prefixes.join(names, "_p").withColumn("_dong", F.expr("substr(_a, length(_p) + 2)")).where(F.col("_dong") != "")
    best = found.groupBy("_a").agg(
        F.max(F.struct(F.length("_p").alias("len"))).alias("_best"),
        F.count("*").alias("_any"),
    )
    top = found.join(best, "_a").where(F.length("_p") == F.col("_best.len"))
    decided = stored(
        top.groupBy("_a").agg(
            F.count_distinct("code", "sido", "district", "_dong").alias("_n"),
            F.min(F.struct("code", "sido", "district", "_dong")).alias("_m"),
        )
    )
    joined = df.withColumn("_a", text).join(decided, "_a", "left")
    unique = F.col("_n") == 1
    return joined.withColumns(
        {
            "district_code": F.when(unique, F.col("_m.code")),
            "sido": F.when(unique, F.col("_m.sido")),
            "district": F.when(unique, F.col("_m.district")),
            "legal_dong": F.when(unique, F.col("_m._dong")),
            "address_match": F.when(unique, "unique_exact_registry_name")
            .when(F.col("_n") > 1, "ambiguous")
            .otherwise("unresolved"),
        }
    ).drop("_a", "_n", "_m")


def _raw_map(headers: dict[str, str], columns: list[str]) -> Column:
    pairs = []
    for header, name in headers.items():
        if name in columns:
            pairs += [F.lit(header), F.col(name)]
    return F.create_map(*pairs)


def _common(df: DataFrame, registry: DataFrame, headers: dict[str, str], kind: str) -> tuple[DataFrame, list[Column]]:
    raw = _raw_map(headers, df.columns)
    out = match_address(df, registry).withColumn("raw", raw)
    date, date_flag = P.contract_date(F.col("contract_month"), F.col("contract_day"))
    area, area_flag = P.decimal_text(F.col("area"), "area", positive=True)
    floor, floor_flag = P.decimal_text(F.col("floor"), "floor")
    built, built_flag = P.decimal_text(F.col("built"), "built_year")
    lot, lot_flag = P.normalize_lot(F.col("main"), F.col("sub"), F.col("lot"))
    matched = F.col("address_match") == "unique_exact_registry_name"
    when = F.col("contract_date")
    flags = [
        F.when(~matched, F.concat(F.lit("address_"), F.col("address_match"))),
        F.when(F.col("sido").isNotNull() & (F.col("sido") != F.col("source_sido")), "source_sido_mismatch"),
        date_flag,
        F.when(when.isNotNull() & ~when.between(F.col("source_start"), F.col("source_end")), "contract_date_outside_request"),
        area_flag,
        floor_flag,
        built_flag,
        lot_flag,
        F.when(P.is_missing(F.col("building")), "building_name_missing"),
    ]
    out = out.withColumn("contract_date", date).withColumns(
        {
            "kind": F.lit(kind),
            "area_sqm": area,
            "floor_text": floor,
            "built_year": built,
            "lot_normalized": lot,
            "building_name": P.cleaned(F.col("building")),
        }
    )
    return out, flags


def _canonical(df: DataFrame, flags: Column, measures: list[str]) -> DataFrame:
    return df.withColumn("quality_flags", flags).select(
        "kind",
        "raw",
        F.struct("source_id", "row_number", "observed_at").alias("provenance"),
        "contract_date",
        F.struct(
            F.col("address_text").alias("as_published"),
            "district_code",
            "sido",
            "district",
            "legal_dong",
            F.col("address_match").alias("match"),
            "lot_normalized",
        ).alias("address"),
        "building_name",
        "area_sqm",
        F.col("floor_text").alias("floor"),
        "built_year",
        "property_type",
        *measures,
        "quality_flags",
    )


def normalize_sale(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Canonical sale records.

    Input: the renamed export columns plus source_id, row_number, observed_at,
    source_sido, source_start and source_end.  ``cancelled`` and
    ``direct_trade`` are tri-state: unknown is null, not false.
    """
    out, flags = _common(df, registry, SALE_HEADERS, "sale")
    amount, amount_flag = P.decimal_text(F.col("amount"), "amount", positive=True)
    has_status = "cancelled_on" in df.columns
    deal = P.cleaned(F.col("deal_type"))
    unknown_deal = deal.isin(*P.MISSING)
    flags += [
        F.lit(None).cast("string") if has_status else F.lit("cancellation_status_unavailable"),
        F.when(unknown_deal, "deal_type_unknown").when(~deal.isin(BROKERED, DIRECT), "deal_type_unrecognized"),
        amount_flag,
    ]
    out = out.withColumn("_flags", P.present(*flags))
    out = out.withColumns(
        {
            "property_type": F.lit(APARTMENT),
            "amount_10k_krw": amount,
            "cancelled": ~P.is_missing(F.col("cancelled_on")) if has_status else F.lit(None).cast("boolean"),
            "cancellation_date_raw": F.col("cancelled_on") if has_status else F.lit(None).cast("string"),
            "deal_type": F.when(~unknown_deal, deal),
            "direct_trade": F.when(deal.isin(BROKERED, DIRECT), deal == DIRECT),
        }
    )
    return _canonical(
        out, F.col("_flags"), ["amount_10k_krw", "cancelled", "cancellation_date_raw", "deal_type", "direct_trade"]
    )


def normalize_lease(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Canonical lease records: contract type, tri-state pure-deposit test and a type/financials check."""
    out, flags = _common(df, registry, LEASE_HEADERS, "rent")
    money = lambda c: P.decimal_text(F.col(c), c, minimum=0)
    deposit, deposit_flag = money("deposit")
    rent, rent_flag = money("monthly_rent")
    old_deposit, old_deposit_flag = money("previous_deposit")
    old_rent, old_rent_flag = money("previous_monthly_rent")
    contract = P.cleaned(F.col("contract_type"))
    known_contract = contract.isin("신규", "갱신")
    lease_type = F.nullif(P.cleaned(F.col("lease_type")), F.lit(""))
    property_type = P.cleaned(F.col("property_type"))
    known = deposit.isNotNull() & rent.isNotNull()
    rent_number, deposit_number = rent.try_cast("double"), deposit.try_cast("double")
    pure = F.when(known, (rent_number == 0) & (deposit_number > 0) & (property_type == APARTMENT))
    disagrees = known & (((lease_type == "전세") & ~pure) | ((lease_type == "월세") & (rent_number == 0)))
    flags += [
        F.when(~known_contract, "contract_type_unknown"),
        deposit_flag,
        rent_flag,
        old_deposit_flag,
        old_rent_flag,
        F.when(lease_type.isNull() | ~lease_type.isin("전세", "월세"), "lease_type_unknown").when(
            disagrees, "lease_type_financials_disagree"
        ),
        F.lit("cancellation_status_unavailable"),
    ]
    measures = {
        "deposit_10k_krw": deposit,
        "monthly_rent_10k_krw": rent,
        "previous_deposit_10k_krw": old_deposit,
        "previous_monthly_rent_10k_krw": old_rent,
        "lease_type_raw": lease_type,
        "contract_kind": F.when(known_contract, contract).otherwise("미상"),
        "is_pure_jeonse": pure,
    }
    # Flags read the published text, so they are fixed before columns take its names.
    out = out.withColumn("_flags", P.present(*flags))
    out = out.withColumns({**measures, "property_type": property_type})
    return _canonical(out, F.col("_flags"), list(measures))


def clean_leases(df: DataFrame) -> DataFrame:
    """Pure-deposit apartment leases with numeric lots, keyed like sales.

    Input columns are the annual file's: usage, contract_day (YYYYMMDD), area,
    deposit, monthly_rent, floor, lease_type, main, sub, district, dong,
    building, district_code, contract_type, receipt_year.
    """
    t = lambda c: P.cleaned(F.col(c))
    area, deposit, rent = (P.number_or_null(F.col(c)) for c in ("area", "deposit", "monthly_rent"))
    date = P.compact_date(F.col("contract_day"))
    kept = (
        (t("usage") == APARTMENT)
        & date.isNotNull()
        & (area > 0)
        & (deposit > 0)
        & (rent == 0)
        & (t("lease_type") == "전세")
        & P.is_digits(t("main"))
        & P.is_digits(t("sub"))
    )
    tail = F.ltrim(t("sub"), F.lit("0"))
    lot = F.concat(P.strip_zeros(t("main")), F.when(tail != "", F.concat(F.lit("-"), tail)).otherwise(""))
    complex_ = F.concat_ws(" ", t("district"), t("dong"), lot, t("building"))
    contract = t("contract_type")
    return df.where(kept).select(
        F.concat(complex_, F.lit(" | "), P.area_text(F.col("area")), F.lit("㎡")).alias("key"),
        complex_.alias("complex"),
        F.concat_ws("|", t("district_code"), t("dong"), lot, P.area_text(F.col("area"))).alias("lot_key"),
        t("district_code").alias("gu"),
        date.alias("date"),
        area.alias("area"),
        P.number_or_null(F.col("floor")).alias("floor"),
        deposit.alias("deposit"),
        rent.alias("monthly_rent"),
        F.when(contract.isin("신규", "갱신"), contract).otherwise("미상").alias("contract_type"),
        t("receipt_year").cast("int").alias("receipt_year"),
        F.ln(deposit / area).alias("log_rent"),
    )


def to_dashboard(canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows in the 21-column layout, rejected rows with their sorted reasons)."""
    bad = F.array_intersect("quality_flags", F.array(*[F.lit(f) for f in BLOCKING_FLAGS]))
    reason = F.when(F.col("kind") != "sale", "not_sale").when(
        F.size(bad) > 0, F.array_join(F.array_sort(bad), "|")
    )
    judged = canonical.withColumn("reason", reason)
    text = lambda c: F.coalesce(c, F.lit(""))
    values = {
        "RCPT_YR": F.year("contract_date").cast("string"),
        "CGG_CD": F.col("address.district_code"),
        "CGG_NM": F.col("address.district"),
        "STDG_NM": F.col("address.legal_dong"),
        "MNO": F.trim(F.col("raw")["본번"]),
        "SNO": F.trim(F.col("raw")["부번"]),
        "BLDG_NM": F.col("building_name"),
        "CTRT_DAY": F.date_format("contract_date", "yyyyMMdd"),
        "THING_AMT": F.col("amount_10k_krw"),
        "ARCH_AREA": F.col("area_sqm"),
        "FLR": F.col("floor"),
        "ARCH_YR": F.col("built_year"),
        "BLDG_USG": F.col("property_type"),
        "DCLR_SE": F.col("deal_type"),
        "RTRCN_DAY": F.when(
            F.col("cancelled"), F.coalesce(F.nullif(F.trim("cancellation_date_raw"), F.lit("")), F.lit("cancelled"))
        ),
        "OPBIZ_RESTAGNT_SGG_NM": F.trim(F.col("raw")["중개사소재지"]),
    }
    accepted = judged.where(F.col("reason").isNull()).select(
        *[text(values.get(c, F.lit(""))).alias(c) for c in DASHBOARD_COLUMNS]
    )
    rejected = judged.where(F.col("reason").isNotNull())
    return accepted, rejected


def with_identity(df: DataFrame) -> DataFrame:
    """Complex, type key, district, dong and peer of dashboard rows, from exact published text."""
    t = lambda c: P.cleaned(F.col(c))
    tail = F.ltrim(t("SNO"), F.lit("0"))
    lot = F.concat(
        F.coalesce(F.nullif(F.ltrim(t("MNO"), F.lit("0")), F.lit("")), F.lit("0")),
        F.when(tail != "", F.concat(F.lit("-"), tail)).otherwise(""),
    )
    area = P.number_or_null(F.col("ARCH_AREA"))
    complex_ = F.concat_ws(" ", t("CGG_NM"), t("STDG_NM"), lot, t("BLDG_NM"))
    return df.withColumns(
        {
            "complex": complex_,
            "key": F.concat(complex_, F.lit(" | "), P.area_text(F.col("ARCH_AREA")), F.lit("㎡")),
            "region": P.province(F.col("CGG_CD")),
            "gu": t("CGG_CD"),
            "dong": F.concat_ws(":", t("CGG_CD"), t("STDG_NM")),
            "peer": F.concat_ws(":", t("CGG_CD"), F.floor(area / 15).cast("string")),
        }
    )


def exclusion_class(include_direct: bool = False) -> Column:
    """First matching reason a dashboard row is not used, or ``used``."""
    price, area = P.number_or_null(F.col("THING_AMT")), P.number_or_null(F.col("ARCH_AREA"))
    usable = (price > 0) & (area > 0) & P.compact_date(F.col("CTRT_DAY")).isNotNull()
    out = F.when(~P.is_missing(F.col("RTRCN_DAY")), "cancelled").when(
        P.cleaned(F.col("BLDG_USG")) != APARTMENT, "property_type"
    )
    if not include_direct:
        out = out.when(P.cleaned(F.col("DCLR_SE")) == DIRECT, "direct")
    return out.when(~F.coalesce(usable, F.lit(False)), "invalid").otherwise("used")


def clean_trades(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed usable trades, one row of quality counters) from dashboard rows."""
    judged = df.withColumn("_class", exclusion_class())
    price, area = P.number_or_null(F.col("THING_AMT")), P.number_or_null(F.col("ARCH_AREA"))
    date = P.compact_date(F.col("CTRT_DAY"))
    typed = with_identity(judged.where(F.col("_class") == "used").drop("_class")).withColumns(
        {
            "date": date,
            "day": F.unix_date(date),
            "year": F.year(date),
            "month": F.date_format(date, "yyyy-MM"),
            "area": area,
            "floor": P.number_or_null(F.col("FLR")),
            "built": P.number_or_null(F.col("ARCH_YR")),
            "price": price,
            "log_price": F.ln(price / area),
            "price_oku": price / 10000,
        }
    )
    used = F.col("_class") == "used"
    quality = judged.agg(
        F.count("*").alias("raw_rows"),
        F.count_if(used).alias("used_rows"),
        F.count_if(F.col("_class") == "cancelled").alias("cancelled"),
        F.count_if(F.col("_class") == "direct").alias("direct_excluded"),
        F.count_if(used & P.is_missing(F.col("DCLR_SE"))).alias("unknown_deal_type"),
        F.min(F.when(used, date)).alias("min_date"),
        F.max(F.when(used, date)).alias("max_date"),
    )
    return typed, quality


def row_keys(df: DataFrame) -> DataFrame:
    """entity_key, observed_day and region_code of loosely shaped source rows.

    Names alone are not unique, so an apartment's entity is the hash of its
    district, dong, lot and name; a ticker or explicit id is used as it is.
    """
    have = set(df.columns)
    text = lambda c: P.cleaned(F.col(c)) if c in have else F.lit("")
    first = lambda *cs: F.coalesce(*[F.nullif(text(c), F.lit("")) for c in cs])
    address = F.sha2(
        F.to_json(F.array(*[text(c) for c in ("CGG_CD", "STDG_CD", "STDG_NM", "MNO", "SNO", "BLDG_NM")])), 256
    )
    day = F.substring(first("date", "CTRT_DAY", "observed_day"), 1, 10)
    iso = F.coalesce(P.compact_date(day), F.try_to_date(day, "yyyy-MM-dd"))
    return df.withColumns(
        {
            "entity_key": F.coalesce(
                first("ticker", "symbol"), F.when(text("BLDG_NM") != "", address), first("complex_id", "entity_key")
            ),
            "observed_day": iso.cast("string"),
            "region_code": first("CGG_CD", "region_code", "code"),
        }
    )


def register_fields(df: DataFrame) -> DataFrame:
    """Typed fields of a complex register row; ``complete`` needs all four denominators."""
    out = df.withColumns(
        {
            "whole_complex_households": P.positive_integer(F.col("tnohsh")),
            "whole_complex_buildings": P.positive_integer(F.col("whol_dong_cnt")),
            "road_address": F.nullif(P.cleaned(F.col("apt_rdn_addr")), F.lit("")),
            "source_modified_at": P.epoch_millis(F.col("mdfcn_ymd")),
        }
    )
    fields = ("whole_complex_households", "whole_complex_buildings", "road_address", "source_modified_at")
    complete = F.lit(True)
    for c in fields:
        complete = complete & F.col(c).isNotNull()
    return out.withColumn("complete", complete)
