"""Price-versus-reference score, grades, costs and other row-level arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def positive_finite(c: Column) -> Column:
    """The value if it is positive and finite (NaN sorts above infinity), else null."""
    value = c.cast("double")
    return F.when((value > 0) & (value < float("inf")), value)


def canonical_price(c: Column) -> Column:
    """억 rounded to whole 만원 (0.0001), half up; null when it would not be positive."""
    units = c.cast("double") * 10000 + 0.5
    return F.when((units >= 1) & (units < float("inf")), F.floor(units) / 10000)


def score_between(neutral: Column, price: Column, scale: Column) -> Column:
    """Score of two canonical prices; exactly 50 at equality, null if anything is unknown."""
    score = 50 + 40 * F.tanh(F.ln(neutral / price) / scale)
    return F.when(neutral == price, F.when(scale > 0, 50.0)).otherwise(F.floor(score * 10 + 0.5) / 10)


def with_score(df: DataFrame, neutral: Column, price: Column, scale: Column) -> DataFrame:
    """Adds canonical ``neutral`` and ``price``, the score and the discount in percent."""
    canonical = df.withColumns(
        {"neutral": canonical_price(neutral), "price": canonical_price(price), "_scale": positive_finite(scale)}
    )
    return canonical.withColumns(
        {
            "score": score_between(F.col("neutral"), F.col("price"), F.col("_scale")),
            # Unrounded; two decimals are applied where results are exported.
            "discount_pct": (1 - F.col("price") / F.col("neutral")) * 100,
        }
    ).drop("_scale")


def grade(radius: Column) -> Column:
    """A to D by the size of the log error band: up to 10 %, 20 %, 35 %, beyond."""
    a, b, c = F.ln(F.lit(1.1)), F.ln(F.lit(1.2)), F.ln(F.lit(1.35))
    return F.when(radius <= a, "A").when(radius <= b, "B").when(radius <= c, "C").otherwise("D")


def band(price: Column, radius: Column) -> tuple[Column, Column]:
    return canonical_price(price * F.exp(-radius)), canonical_price(price * F.exp(radius))


def charge(amount: Column, rate: str) -> Column:
    """Ceiling of amount × rate in whole won, computed in decimals."""
    return F.ceil(amount.cast("decimal(20,0)") * F.lit(rate).cast("decimal(10,8)")).cast("long")


def cost_columns(df: DataFrame, price: str, rates: dict[str, str], buy_fixed: int = 0, sell_fixed: int = 0,
                 moving: int = 0, basis: str | None = None) -> DataFrame:
    """Acquisition total and, against an acquisition ``basis`` column, net sale proceeds and gain tax.

    ``rates`` holds acquisition_tax, buy_broker, sell_broker and gain_tax as
    decimal text.
    """
    p = F.col(price)
    buy_tax, buy_broker = charge(p, rates["acquisition_tax"]), charge(p, rates["buy_broker"])
    out = df.withColumns(
        {
            "buy_tax": buy_tax,
            "buy_broker": buy_broker,
            "buy_total": p + buy_tax + buy_broker + F.lit(buy_fixed + moving),
        }
    )
    if basis is None:
        return out
    sell_broker = charge(p, rates["sell_broker"])
    gain = F.greatest(F.lit(0), p - sell_broker - sell_fixed - F.col(basis))
    gain_tax = charge(gain, rates["gain_tax"])
    return out.withColumns(
        {
            "sell_broker": sell_broker,
            "gain_tax": gain_tax,
            "sell_net": p - sell_broker - gain_tax - F.lit(sell_fixed),
        }
    )


def walk_time(df: DataFrame, origin: str, network: str, destination: str) -> DataFrame:
    """Connector total in metres and minutes at 80, 90 and 60 metres a minute; null when unconnected."""
    total = F.col(origin) + F.col(network) + F.col(destination)
    return df.withColumns({"total_m": total, "base_min": total / 80, "fast_min": total / 90, "slow_min": total / 60})


def age_category(age: Column) -> Column:
    return (
        F.when(age.isNull(), "unknown")
        .when(age <= 5, "new")
        .when(age <= 15, "semi_new")
        .when(age <= 20, "middle")
        .when(age < 30, "old")
        .otherwise("very_old")
    )


def area_category(pyeong: Column) -> Column:
    return (
        F.when(pyeong <= 14, "lte14")
        .when(pyeong <= 26, "gt14_lte26")
        .when(pyeong <= 34, "gt26_lte34")
        .when(pyeong.isNotNull(), "gt34")
    )


def facet_bins(df: DataFrame, year: Column, built: str = "built", area_pyeong: str = "area_pyeong") -> DataFrame:
    """Age (never negative) with its category, and the area category."""
    age = F.when(F.col(built).isNotNull(), F.greatest(F.lit(0), year - F.col(built)))
    return df.withColumns(
        {"building_age": age, "age_category": age_category(age), "area_category": area_category(F.col(area_pyeong))}
    )


def route_by_region(df: DataFrame, regions: list[str], inside: str, outside: str, versions: tuple[str, str],
                    region: str = "region") -> DataFrame:
    """Prediction of the component responsible for the row's region, and that component's version."""
    use = F.col(region).isin(*regions)
    return df.withColumns(
        {
            "prediction": F.when(use, F.col(inside)).otherwise(F.col(outside)),
            "component_version": F.when(use, versions[0]).otherwise(versions[1]),
        }
    )
