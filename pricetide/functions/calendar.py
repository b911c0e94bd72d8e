"""Calendar columns: month grids, publication lags, Korean business days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OLD_LAG, NEW_LAG = 61, 31
BUSINESS_ZONE = "Asia/Seoul"


def month_index(date: Column) -> Column:
    """Months since year 0."""
    return F.year(date) * 12 + F.month(date) - 1


def month_start(index: Column) -> Column:
    return F.make_date(F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"), F.lit(1))


def grid_months(first: Column, last: Column, every: int = 1, phase: int = 0) -> Column:
    """Indexes of the grid month starts lying in [first, last]; an array, possibly empty.

    The grid holds the months whose index leaves ``phase`` modulo ``every``.
    """
    low = month_index(F.date_sub(first, 1)) + 1
    low = low + F.pmod(F.lit(phase) - low, F.lit(every))
    high = month_index(last)
    return F.when(low <= high, F.sequence(low, high, F.lit(every))).otherwise(F.array().cast("array<int>"))


def as_date(value: str) -> Column:
    return F.lit(value).cast("date")


def assumed_lag(date: Column, law_change: str | None) -> Column:
    """Days from contract to assumed publication: 61 under the old law, else 31.

    ``law_change=None`` is the uniform 61-day scenario.
    """
    if law_change is None:
        return F.lit(OLD_LAG)
    return F.when(date < as_date(law_change), OLD_LAG).otherwise(NEW_LAG)


def origin_lag(origin: Column, law_change: str | None) -> Column:
    """Lag applied at a prediction origin: decided by the day 31 days before it."""
    return assumed_lag(F.date_sub(origin, NEW_LAG), law_change)


def available_date(date: Column, law_change: str | None) -> Column:
    return F.date_add(date, assumed_lag(date, law_change))


def maturity_date(start: Column, end: Column, law_change: str | None) -> Column:
    """First day on which every contract of [start, end] has been published.

    A contract of the last old-law day can appear later than a newer one.
    """
    mature = F.date_add(end, assumed_lag(end, law_change))
    if law_change is None:
        return mature
    last_old = F.date_sub(as_date(law_change), 1)
    spans = (start <= last_old) & (last_old <= end)
    return F.when(spans, F.greatest(mature, F.date_add(last_old, OLD_LAG))).otherwise(mature)


def business_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, BUSINESS_ZONE))
