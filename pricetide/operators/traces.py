"""Histories and pools of many origins in Arrow batches.

A type's trades are copied to a dozen origins each and ordered at every one;
as rows of a shuffle and a window that is most of the work of the monthly
features.  Here a group's trades arrive once, ordered, and numpy takes the
copies of a few groups at a time.  Sums of weights are whole numbers as in
:mod:`stats`, so the statistics are the same.  Groups that one task may not
hold (``stats.crowded``) don't come this way.

What runs on the workers is closed over by value: they need numpy and pyarrow only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Pairs of an origin and a trade that a worker looks at together; a group of more trades is looked at origin by origin.
PAIRS = 500_000
# Stands for a day that isn't known: earlier than all others.
NO_DAY = -(2**31)


def _tools() -> tuple[Callable, Callable, Callable, Callable]:
    def whole_groups(batches, names: Sequence[str]) -> Iterator[pa.Table]:
        """Tables of whole groups; rows arrive ordered by ``names``."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            same = np.ones(batch.num_rows, bool)
            for n in names:
                same &= pc.equal(batch[n], batch[n][-1]).to_numpy(zero_copy_only=False)
            start = int(same.argmax())
            if start == 0 and held and all(held[-1][n][-1].as_py() == batch[n][-1].as_py() for n in names):
                held.append(batch)
                continue
            # The last group may go on in the next batch.
            done = [*held, batch.slice(0, start)]
            held = [batch.slice(start)]
            if sum(b.num_rows for b in done):
                yield pa.Table.from_batches(done).combine_chunks()
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def numbered(table: pa.Table, names: Sequence[str]) -> np.ndarray:
        """Number of each row's group."""
        fresh = np.zeros(table.num_rows, bool)
        for n in names:
            column = table[n].combine_chunks()
            fresh[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        return np.cumsum(fresh)

    def pairs(first: np.ndarray, count: np.ndarray, most: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Slices of the asks, and for each the pairs (ask in the slice, place of the trade)."""
        upto, at = np.cumsum(count), 0
        while at < len(count):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
            c = count[at:end]
            begin = np.cumsum(c) - c
            yield slice(at, end), np.repeat(np.arange(end - at), c), np.arange(c.sum()) + np.repeat(first[at:end] - begin, c)
            at = end

    def statistic(values: np.ndarray, low: np.ndarray, high: np.ndarray, weight: np.ndarray | None, q: float, linear: bool, least: int = 1):
        """(total weight, statistic or NaN) of the segments [low, high) of ordered values."""
        upto = np.concatenate([[0], np.cumsum(weight)]) if weight is not None else np.arange(len(values) + 1)
        base, total = upto[low], upto[high] - upto[low]
        if not len(values):
            return total, np.full(len(low), np.nan)

        def reached(target):
            return values[np.minimum(np.searchsorted(upto[1:], base + target, "left"), len(values) - 1)]

        if linear:
            place = (total - 1) * q
            below = np.floor(place)
            a, b = reached(below.astype(np.int64) + 1), reached(np.ceil(place).astype(np.int64) + 1)
            found = a + (b - a) * (place - below)
        else:
            found = reached(np.ceil(total * q).astype(np.int64))
        return total, np.where(total >= least, found, np.nan)

    return whole_groups, numbered, pairs, statistic


def histories(rows: DataFrame, windows: Sequence[int], weights: Mapping[int, Sequence[int]], horizon: int) -> DataFrame:
    """One row per asked (key, origin): windows, weighted medians, evidence, median floor, newest trade, previous year.

    ``rows`` are ordered by key, date and log price within partitions that hold
    whole keys: key, date, seen (day of its publication), log_price, floor, is_trade, and, where
    the row asks, origin, lag and stage (the day whose view of the previous
    year counts).  ``weights`` has the whole weight of every age by half-life.
    """
    whole_groups, numbered, pairs, statistic = _tools()
    most, unknown, windows = PAIRS, NO_DAY, list(windows)
    by_age = {h: np.array(w, np.int64) for h, w in weights.items()}
    floats = [*[f"median{n}" for n in windows], *[f"ew{h}" for h in by_age], "spread90", "eff90", "mass90", "hist_floor", "prior_annual"]
    longs = [f"n{n}" for n in windows] + ["active_days90"]

    def traced(batches):
        for table in whole_groups(batches, ["key"]):
            group = numbered(table, ["key"])
            day = lambda name: table[name].combine_chunks().cast(pa.int32()).fill_null(unknown).to_numpy(zero_copy_only=False).astype(np.int64)
            origin = day("origin")
            asks = np.flatnonzero(origin != unknown)
            if not len(asks):
                continue
            asks = asks[np.unique(group[asks] * 2**32 + origin[asks], return_index=True)[1]]
            trade = np.flatnonzero(table["is_trade"].combine_chunks().to_numpy(zero_copy_only=False))
            tg, date, seen = group[trade], day("date")[trade], day("seen")[trade]
            year = np.where(date == unknown, 0, date).astype("datetime64[D]").astype("datetime64[Y]").astype(np.int64)
            year = np.where(date == unknown, unknown, year)
            number = lambda name: table[name].combine_chunks().fill_null(float("nan")).to_numpy(zero_copy_only=False)[trade]
            value, floor = number("log_price"), number("floor")
            known = ~np.isnan(value)
            # The first known trade of each day stands for the day.
            dated = np.flatnonzero(known)
            opens = np.zeros(len(trade), bool)
            opens[dated] = np.concatenate([[True], (np.diff(tg[dated]) != 0) | (np.diff(date[dated]) != 0)])[: len(dated)]
            by_value = np.lexsort((value, tg))
            first = np.searchsorted(tg, group[asks], "left")
            count = np.searchsorted(tg, group[asks], "right") - first
            asks, first, count = asks[count > 0], first[count > 0], count[count > 0]
            lag, stage = day("lag")[asks], day("stage")[asks]
            target = origin[asks].astype("datetime64[D]").astype("datetime64[Y]").astype(np.int64)
            for part, a, place in pairs(first, count, most):
                t, o, wait = by_value[place], origin[asks[part]], lag[part]
                m = len(o)
                visible = seen[t] <= o[a]
                starts = np.cumsum(count[part]) - count[part]
                newest = np.maximum.reduceat(np.where(visible, t, -1), starts)
                age = o[a] - date[t] - wait[a]
                served = visible & (age >= 0) & (age <= horizon)
                out = {}
                edges = np.arange(m)
                own = np.flatnonzero(served & known[t])
                sa, st, late = a[own], t[own], age[own]
                low, high, v = np.searchsorted(sa, edges, "left"), np.searchsorted(sa, edges, "right"), value[st]
                for n in windows:
                    out[f"n{n}"], out[f"median{n}"] = statistic(v, low, high, (late <= n).astype(np.int64), 0.5, True)
                days = late + wait[sa]
                for h, table_of in by_age.items():
                    out[f"ew{h}"] = statistic(v, low, high, table_of[days], 0.5, False)[1]
                month3 = late <= 90
                tails = [statistic(v, low, high, month3.astype(np.int64), q, True, 2)[1] for q in (0.25, 0.75)]
                out["spread90"] = tails[1] - tails[0]
                w = np.power(2.0, -days / 90)
                mass, square = np.bincount(sa, w, m), np.bincount(sa, w * w, m)
                none = low == high
                with np.errstate(invalid="ignore", divide="ignore"):
                    out["eff90"] = np.where(none, np.nan, mass * mass / square)
                out["mass90"] = np.where(none, np.nan, mass)
                out["active_days90"] = np.bincount(sa[month3 & opens[st]], minlength=m)
                high_up = np.flatnonzero(served & (age <= 90) & ~np.isnan(floor[t]))
                fa, fv = a[high_up], floor[t[high_up]]
                fv = fv[np.lexsort((fv, fa))]
                out["hist_floor"] = statistic(fv, np.searchsorted(fa, edges, "left"), np.searchsorted(fa, edges, "right"), None, 0.5, True)[1]
                before = np.flatnonzero((year[t] == target[part][a] - 1) & (seen[t] <= stage[part][a]) & known[t])
                pa_, pv = a[before], value[t[before]]
                out["prior_annual"] = statistic(pv, np.searchsorted(pa_, edges, "left"), np.searchsorted(pa_, edges, "right"), None, 0.5, True)[1]
                seen_any = newest >= 0
                row = pa.array(np.where(seen_any, trade[newest], 0), mask=~seen_any)
                last_day = np.where(seen_any, date[newest], unknown)
                columns = [pa.array(o.astype(np.int32)).cast(pa.date32()), table["key"].combine_chunks().take(pa.array(asks[part]))]
                columns += [pa.array(out[c].astype(np.int64), mask=none) for c in longs] + [pa.array(out[c], mask=np.isnan(out[c])) for c in floats]
                columns += [table["log_price"].combine_chunks().take(row), pa.array(np.where(last_day == unknown, 0, o - last_day).astype(np.int32), mask=last_day == unknown)]
                yield pa.RecordBatch.from_arrays(columns, names=["origin", "key", *longs, *floats, "last", "last_age"])

    kinds = ", ".join(["origin date", "key string", *[f"{c} long" for c in longs], *[f"{c} double" for c in floats], "last double", "last_age int"])
    return rows.mapInArrow(traced, kinds)


def pools(rows: DataFrame, origins: Mapping[int, int], short: int, horizon: int) -> DataFrame:
    """Medians and counts of the last ``short`` and ``horizon`` days of each pool at each of the origins (day → lag).

    ``rows`` are ordered by scope, id and log price within partitions that hold
    whole pools: scope, id, date, seen, log_price, all of them known.
    """
    whole_groups, numbered, pairs, statistic = _tools()
    most = PAIRS
    grid = np.array(sorted(origins), np.int64)
    lags = np.array([origins[o] for o in sorted(origins)], np.int64)

    def traced(batches):
        for table in whole_groups(batches, ["scope", "id"]):
            group = numbered(table, ["scope", "id"])
            day = lambda name: table[name].combine_chunks().cast(pa.int32()).to_numpy(zero_copy_only=False).astype(np.int64)
            date, seen, value = day("date"), day("seen"), table["log_price"].combine_chunks().to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
            count = np.diff(np.concatenate([first, [len(group)]]))
            # Origins that a pool's trades can serve.
            begins, ends = np.minimum.reduceat(seen, first), np.maximum.reduceat(date, first)
            g, at = np.nonzero((begins[:, None] <= grid) & (grid - lags < ends[:, None] + horizon))
            for part, a, t in pairs(first[g], count[g], most):
                o, wait = grid[at[part]], lags[at[part]]
                age = o[a] - date[t] - wait[a]
                own = np.flatnonzero((seen[t] <= o[a]) & (age >= 0) & (age < horizon))
                sa, v, edges = a[own], value[t[own]], np.arange(len(o))
                low, high = np.searchsorted(sa, edges, "left"), np.searchsorted(sa, edges, "right")
                few, near = statistic(v, low, high, (age[own] < short).astype(np.int64), 0.5, True)
                n, far = statistic(v, low, high, None, 0.5, True)
                keep = np.flatnonzero(n > 0)
                head = pa.array(first[g[part]][keep])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(o[keep].astype(np.int32)).cast(pa.date32()), table["scope"].combine_chunks().take(head), table["id"].combine_chunks().take(head),
                     pa.array(near[keep], mask=np.isnan(near[keep])), pa.array(far[keep]), pa.array(few[keep]), pa.array(n[keep])],
                    names=["origin", "scope", "id", "pool90", "pool365", "pool_n90", "pool_n365"],
                )

    return rows.mapInArrow(traced, "origin date, scope string, id string, pool90 double, pool365 double, pool_n90 long, pool_n365 long")


def slices(rows: DataFrame, origins: Mapping[int, int], short: int, horizon: int) -> DataFrame:
    """Rows of the last ``short`` and ``horizon`` days of each slice (scope, id, bin) of a pool at each of the origins; see :func:`pools`."""
    whole_groups, numbered, pairs, _ = _tools()
    most = PAIRS
    grid = np.array(sorted(origins), np.int64)
    lags = np.array([origins[o] for o in sorted(origins)], np.int64)

    def traced(batches):
        for table in whole_groups(batches, ["scope", "id", "_bin"]):
            group = numbered(table, ["scope", "id", "_bin"])
            day = lambda name: table[name].combine_chunks().cast(pa.int32()).to_numpy(zero_copy_only=False).astype(np.int64)
            date, seen = day("date"), day("seen")
            first = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
            count = np.diff(np.concatenate([first, [len(group)]]))
            g, at = np.divmod(np.arange(len(first) * len(grid)), max(1, len(grid)))
            for part, a, t in pairs(first[g], count[g], most):
                o, wait = grid[at[part]], lags[at[part]]
                age = o[a] - date[t] - wait[a]
                served = (seen[t] <= o[a]) & (age >= 0) & (age < horizon)
                n, few = np.bincount(a[served], minlength=len(o)), np.bincount(a[served & (age < short)], minlength=len(o))
                keep = np.flatnonzero(n > 0)
                head = pa.array(first[g[part]][keep])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(o[keep].astype(np.int32)).cast(pa.date32()), *[table[c].combine_chunks().take(head) for c in ("scope", "id", "_bin")], pa.array(few[keep]), pa.array(n[keep])],
                    names=["origin", "scope", "id", "_bin", "_h90", "_h365"],
                )

    return rows.mapInArrow(traced, "origin date, scope string, id string, _bin long, _h90 long, _h365 long")
