"""Column parsers for published text fields: value and quality flag, never an exception."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholders the publisher uses for "no value" (fixed values).
MISSING = ("", "-", "--")


def cleaned(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def is_missing(c: Column) -> Column:
    return cleaned(c).isin(*MISSING)


def present(*flags: Column) -> Column:
    """Array of the flags that are set, in order.

    Spelled with ``array_remove``: dropping nulls with a lambda would take the
    whole flag computation out of generated code.
    """
    return F.array_remove(F.array(*[F.coalesce(f, F.lit("")) for f in flags]), "")


def without_commas(c: Column) -> Column:
    return F.replace(cleaned(c), F.lit(","), F.lit(""))


def strip_zeros(c: Column) -> Column:
    """Digits without leading zeros; a bare zero stays."""
    rest = F.ltrim(c, F.lit("0"))
    # A text from "0" to below ":" starts with a digit.
    return F.when((rest >= "0") & (rest < ":"), rest).when(c.startswith("0"), F.concat(F.lit("0"), rest)).otherwise(c)


def is_digits(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d+$"), F.lit(False))


def decimal_text(c: Column, field: str, minimum: float | None = None, positive: bool = False) -> tuple[Column, Column]:
    """(exact decimal text, flag).  All published decimal places survive; no binary float is the result."""
    text = without_commas(c)
    valid = text.rlike(r"^[+-]?\d+(\.\d+)?$")
    # What is valid has one sign at most.
    plain = F.concat(F.when(text.startswith("-"), "-").otherwise(""), strip_zeros(F.ltrim(text, F.lit("+-"))))
    number = text.try_cast("double")
    out = F.lit(False)
    if positive:
        out = out | (number <= 0)
    if minimum is not None:
        out = out | (number < minimum)
    # The pattern comes first: most texts are valid, and filters compute every mention anew.
    flag = F.when(valid, F.when(out, f"{field}_out_of_range")).when(text.isin(*MISSING), f"{field}_missing").otherwise(f"{field}_invalid")
    return F.when(flag.isNull(), plain), flag


def contract_date(month: Column, day: Column) -> tuple[Column, Column]:
    """(date, flag) from ``YYYYMM`` and a one- or two-digit day."""
    ym, d = cleaned(month), cleaned(day)
    shaped = (F.length(ym) == 6) & F.length(d).between(1, 2)
    date = F.when(shaped, _digits_date(F.concat(ym, F.lpad(d, 2, "0"))))
    return date, F.when(date.isNull(), "contract_date_invalid")


def compact_date(c: Column) -> Column:
    """``YYYYMMDD`` text to a date; anything else is null."""
    return _digits_date(cleaned(c))


def _digits_date(text: Column) -> Column:
    """Eight digits to a date, by a cast: it makes no formatter and raises nothing inside for days that don't exist."""
    iso = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
    return F.when(text.rlike(r"^\d{8}\z"), iso.try_cast("date"))


def normalize_lot(main: Column, sub: Column, published: Column) -> tuple[Column, Column]:
    """(``main[-sub]`` without zero padding, flag).

    Flags unresolved numbers, and a published lot that names another parcel.
    """
    m, s, p = cleaned(main), cleaned(sub), cleaned(published)
    numeric = is_digits(m) & is_digits(s)
    tail = F.ltrim(s, F.lit("0"))
    lot = F.when(numeric, F.concat(strip_zeros(m), F.when(tail != "", F.concat(F.lit("-"), tail)).otherwise("")))
    p_tail = F.when(F.contains(p, F.lit("-")), F.ltrim(F.substring_index(p, "-", -1), F.lit("0"))).otherwise("")
    source = F.when(
        p.rlike(r"^\d+(-\d+)?$"),
        F.concat(strip_zeros(F.substring_index(p, "-", 1)), F.when(p_tail != "", F.concat(F.lit("-"), p_tail)).otherwise("")),
    )
    disagrees = ~p.isin(*MISSING) & ~(source.eqNullSafe(lot))
    flag = F.when(~numeric, "lot_numbers_unresolved").when(disagrees, "lot_source_disagrees")
    return lot, flag


def export_parcel(published: Column, main: Column, sub: Column) -> tuple[Column, Column, Column]:
    """(main, sub, accepted) for mountain (산n-m) and provisional (가-n, BL-) parcels.

    ``accepted`` says the label explains a disagreement with the numeric fields.
    """
    p, m, s = cleaned(published), cleaned(main), cleaned(sub)
    numeric = is_digits(m) & is_digits(s)
    shape = r"^산(\d+)(?:-(\d+))?$"
    hill_main, hill_sub = F.regexp_extract(p, shape, 1), F.regexp_extract(p, shape, 2)
    value = lambda c: F.regexp_replace(c, "^0+", "")
    mountain = numeric & (hill_main != "") & (value(m) == value(hill_main)) & (value(s) == value(hill_sub))
    label = F.regexp_extract(p, r"^가-(\d+)$", 1)
    provisional = numeric & (value(s) == "") & (
        (p.isin("가-", "BL-", "지구BL") & (value(m) == "")) | ((label != "") & (value(m) == value(label)))
    )
    dash = F.instr(p, "-")
    main_out = (
        F.when(mountain, F.concat(F.lit("산"), strip_zeros(hill_main)))
        .when(provisional, F.when(dash > 0, F.substring_index(p, "-", 1)).otherwise(p))
        .when(numeric, strip_zeros(m))
    )
    sub_out = (
        F.when(mountain, value(hill_sub))
        .when(provisional, F.when(dash > 0, F.substr(p, dash + 1)).otherwise(""))
        .when(numeric, value(s))
    )
    return main_out, sub_out, mountain | provisional


def area_text(c: Column) -> Column:
    """Exact area without trailing zeros and without passing through a float."""
    text = F.regexp_replace(cleaned(c), ",", "")
    trimmed = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
    return F.when(F.instr(text, ".") > 0, trimmed).otherwise(text)


def number_or_null(c: Column) -> Column:
    """Finite number from text with thousands separators; NaN, infinities and words become null."""
    value = without_commas(c).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def positive_integer(c: Column) -> Column:
    value = number_or_null(c.cast("string"))
    return F.when((value > 0) & (value == F.floor(value)), value.cast("long"))


def epoch_millis(c: Column) -> Column:
    """UTC timestamp from Unix milliseconds; null when not a number."""
    return F.timestamp_millis(c.cast("string").try_cast("double").cast("long"))


def normalize_name(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def last_token(c: Column) -> Column:
    return F.element_at(F.split(F.trim(c), r"\s+"), -1)


def normalize_station(c: Column) -> Column:
    """First listed station without its 'station' suffix (지하철역, 전철역, 역)."""
    parts = F.filter(F.transform(F.split(cleaned(c), "[,/|ㆍ]"), F.trim), lambda x: x != "")
    name = F.trim(F.regexp_replace(F.try_element_at(parts, F.lit(1)), "(지하철역|전철역|역)$", ""))
    return F.when(name != "", name)


def normalize_line(c: Column) -> Column:
    """Canonical subway line: numbered lines end in 호선, named lines keep their 선."""
    text = F.regexp_replace(cleaned(c), " ", "")
    text = F.regexp_replace(F.regexp_replace(text, "수도권|도시철도", ""), "호선호선", "호선")
    named = text.endswith("선") & ~text.endswith("호선")
    bare = F.regexp_replace(text, "호선", "")
    return F.when(named, text).otherwise(F.when(bare != "", F.concat(bare, F.lit("호선"))).otherwise(""))


def walk_metres(c: Column) -> Column:
    """Metres from free text: the largest number, minutes × 80, kilometres × 1000."""
    text = F.regexp_replace(cleaned(c), "ｍ|M", "m")
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))
    largest = F.array_max(numbers)
    low = F.lower(text)
    minutes = text.contains("분") | low.contains("min")
    kilometres = low.contains("km") | text.contains("㎞")
    return F.floor(F.when(minutes, largest * 80).when(kilometres, largest * 1000).otherwise(largest))


def facility_count(c: Column) -> Column:
    """Entries of a list separated by , / | or ;.  Text of separators only counts as one."""
    text = cleaned(c)
    n = F.size(F.filter(F.split(text, "[,/|;]"), lambda x: F.trim(x) != ""))
    return F.when(text != "", F.greatest(n, F.lit(1)))


# Province spellings reduced to their short form, and the wards older pages omit (fixed values).
PROVINCE_ALIASES = (("서울특별시", "서울"), ("서울시", "서울"), ("인천광역시", "인천"), ("경기도", "경기"))
OMITTED_WARDS = r"(화성시)\s+(만세구|효행구|병점구|동탄구)\s+"


def canonical_address(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    for long_form, short in PROVINCE_ALIASES:
        text = F.regexp_replace(text, long_form, short)
    text = F.regexp_replace(text, r"(?<=\d)번지(?=\s|$)", "")
    text = F.regexp_replace(text, OMITTED_WARDS, "$1 ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


# Province of a district code by its prefix (fixed values).
PROVINCE_BY_PREFIX = (
    ("11", "서울특별시"),
    ("28", "인천광역시"),
    ("23", "인천광역시"),
    ("41", "경기도"),
    ("31", "경기도"),
)


def province(code: Column) -> Column:
    text = cleaned(code)
    chain = F
    for prefix, name in PROVINCE_BY_PREFIX:
        chain = chain.when(text.startswith(prefix), name)
    return chain.otherwise("기타")


def legal_dong_code(district: Column, dong_code: Column, dong_name: Column) -> Column:
    """District code plus three digits of the dong code, else the dong's name, else the district."""
    gu, code, name = cleaned(district), cleaned(dong_code), cleaned(dong_name)
    return (
        F.when(code != "", F.concat(gu, F.substring(code, 1, 3)))
        .when(name != "", F.concat_ws(":", gu, name))
        .otherwise(gu)
    )


def formula_guard(c: Column) -> Column:
    """Prefix text a spreadsheet would run as a formula."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike("^[=+@\\-\\t\\r]"), F.concat(F.lit("'"), text)).otherwise(text)
