"""Exact order statistics without sorting the table and without gathering it.

A rank is found by narrowing an interval that is known to contain it. Each step is one pass that counts rows per bucket of
the interval: a grouped count with a map-side partial, so what moves is at most ``BUCKETS`` rows per task and per open
interval, whatever the size or skew of the table. The bucket holding the rank, cut down to the smallest and largest value
seen in it, is the next interval; a rank is settled when its interval is one value. There is one path for all sizes. The
result is the exact value, not an estimate.

Where several series are searched, estimates first narrow all their intervals at once; what is estimated is then counted exactly, and an
estimate that misses is dropped.

The ends of an interval always fall in different buckets, so every pass narrows it (this is asserted). Buckets are equally
wide; after a pass that left most rows together, the next one is wide on a logarithmic scale, which keeps the number of
passes small for values of very different magnitude. Infinite values are counted apart and never bound an interval. What
comes to the driver in a pass is ``BUCKETS`` rows for each open rank at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanscope.functions.expressions import null_if_nan

BUCKETS = 4096
SKETCH = 2000  # an estimate is off by one part in so many of the rows
MARGIN = 0.002  # an interval around an estimate takes in so large a part of the rows on both sides
SMALLEST = 1e-300  # the logarithmic scale begins here; values below it share its first bucket


@dataclass
class RankedValue:
    """The value at a 0-based rank, the number of rows strictly below that value and the number equal to it."""

    value: float | int
    below: int
    rows: int


@dataclass
class _Open:
    """Rank still searched: the values in [low, high] occupy the ranks below .. below + rows - 1."""

    series: str
    rank: int
    low: float | int
    high: float | int
    below: int
    rows: int
    log_scale: bool = False


def _is_integral(df: DataFrame, c: Column) -> bool:
    return df.select(c.alias("v")).schema["v"].dataType.typeName() in ("byte", "short", "integer", "long")


class SeriesSet:
    """Several named value expressions over one table, searched together so that they share every pass.

    A row takes no part in a series where its expression is null (or NaN). None in place of an expression stands for
    the column of that name. ``extent`` gives (rows, low, high) per series where the caller knows them: the row count
    must be exact, low and high may be any bounds of the values.
    """

    def __init__(
        self, df: DataFrame, series: Mapping[str, Column | None], extent: Mapping[str, tuple] | None = None
    ):
        self.df = df
        self.plain = {name for name, c in series.items() if c is None}
        integral, floating = {}, {}
        for name, c in series.items():
            c = F.col(name) if c is None else c
            if _is_integral(df, c):
                integral[name] = c.cast("bigint")
            else:
                floating[name] = null_if_nan(c.cast("double"))
        self.floating = floating
        self.groups: list[dict[str, Column]] = [g for g in (integral, floating) if g]
        self.infinite: dict[str, tuple[int, int]] = {}
        self.extent: dict[str, tuple] = dict(extent or {})
        self.table_rows: int | None = None

    def measure(self) -> dict[str, tuple]:
        """(rows, least, largest finite value) of every series, one pass; ``table_rows`` is the number of rows of the table."""
        if not self.extent:
            aggs = [F.count(F.lit(1)).alias("rows")]
            names = [n for g in self.groups for n in g]
            for i, (_, c) in enumerate((n, c) for g in self.groups for n, c in g.items()):
                ends = [F.lit(0).alias(f"under{i}"), F.lit(0).alias(f"over{i}")]
                finite = c
                if i >= len(names) - len(self.floating):
                    ends = [F.count_if(c == float("-inf")).alias(f"under{i}"), F.count_if(c == float("inf")).alias(f"over{i}")]
                    finite = F.when(F.abs(c) < float("inf"), c)
                aggs += [F.count(c).alias(f"n{i}"), F.min(finite).alias(f"lo{i}"), F.max(finite).alias(f"hi{i}"), *ends]
            row = self.df.agg(*aggs).first()
            self.table_rows = row["rows"]
            self.extent = {n: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, n in enumerate(names)}
            self.infinite = {n: (row[f"under{i}"] or 0, row[f"over{i}"] or 0) for i, n in enumerate(names)}
        return self.extent

    def values_at(self, ranks: Mapping[str, Sequence[int]]) -> dict[tuple[str, int], RankedValue]:
        """Exact values at 0-based ranks (in ascending order) of the series."""
        extent = self.measure()
        found: dict[tuple[str, int], RankedValue] = {}
        for group in self.groups:
            open_ranks = []
            for name in group:
                rows, low, high = extent[name]
                for rank in sorted(set(ranks.get(name, ()))):
                    if not 0 <= rank < rows:
                        raise ValueError(f"rank {rank} outside the {rows} rows of {name}")
                    under, over = self.infinite.get(name, (0, 0))
                    if rank < under:
                        found[(name, rank)] = RankedValue(-math.inf, 0, under)
                    elif rank >= rows - over:
                        found[(name, rank)] = RankedValue(math.inf, rows - over, over)
                    else:
                        open_ranks.append(_Open(name, rank, low, high, under, rows - under - over))
            if len({o.series for o in open_ranks}) > 1:
                self._bracket(group, [o for o in open_ranks if o.low != o.high])
            while True:
                for o in [o for o in open_ranks if o.low == o.high]:
                    found[(o.series, o.rank)] = RankedValue(o.low, o.below, o.rows)
                open_ranks = [o for o in open_ranks if o.low != o.high]
                if not open_ranks:
                    break
                intervals = sorted({(o.series, o.low, o.high, o.log_scale) for o in open_ranks})
                counts = self._count(group, intervals)
                position = {i: k for k, i in enumerate(intervals)}
                for o in open_ranks:
                    self._narrow(o, counts[position[(o.series, o.low, o.high, o.log_scale)]])
        return found

    def _bracket(self, group, open_ranks: list[_Open]) -> None:
        """Narrow many intervals at once around estimated values, so that few rows take part in the passes that follow.

        One pass estimates the two ends, a second one counts what lies below and between them; an interval that does not hold its
        rank stays as it was. Both passes aggregate whole rows and move a sketch or four numbers per rank and task.
        """
        if not open_ranks:
            return

        def finite(o: _Open) -> Column:
            c = group[o.series]
            return F.when(F.abs(c) < float("inf"), c) if o.series in self.floating else c

        def around(o: _Open) -> Column:
            share = (o.rank - o.below) / max(o.rows - 1, 1)
            return F.array(F.lit(max(share - MARGIN, 0.0)), F.lit(min(share + MARGIN, 1.0)))

        ends = self.df.agg(*[F.percentile_approx(finite(o), around(o), SKETCH).alias(f"e{i}") for i, o in enumerate(open_ranks)]).first()
        aggs, tried = [], []
        for i, o in enumerate(open_ranks):
            if ends[i] is None:
                continue
            low, high = max(ends[i][0], o.low), min(ends[i][1], o.high)
            c = group[o.series]
            inside = F.when(c.between(F.lit(low), F.lit(high)), c)
            aggs += [F.count_if(c < F.lit(low)).alias(f"b{i}"), F.count(inside).alias(f"n{i}"), F.min(inside).alias(f"l{i}"), F.max(inside).alias(f"h{i}")]
            tried.append((i, o))
        if not tried:
            return
        row = self.df.agg(*aggs).first()
        for i, o in tried:
            below, rows = row[f"b{i}"], row[f"n{i}"]
            if below <= o.rank < below + rows:
                o.low, o.high, o.below, o.rows = row[f"l{i}"], row[f"h{i}"], below, rows

    @staticmethod
    def _narrow(o: _Open, buckets: list[tuple]) -> None:
        """Move to the bucket that holds the rank; buckets are (rows, min, max) in ascending order."""
        before = (o.low, o.high)
        total = o.rows
        for rows, low, high in buckets:
            if o.rank < o.below + rows:
                if (low, high) == before and len(buckets) == 1:
                    # bounds given by the caller may be loose, values seen never are
                    raise RuntimeError("a pass did not narrow its interval")
                o.low, o.high, o.rows = low, high, rows
                o.log_scale = isinstance(low, float) and not o.log_scale and 2 * rows > total
                return
            o.below += rows
        raise RuntimeError("the table changed between two passes")

    def _count(self, group, intervals) -> list[list[tuple]]:
        """Per interval the (rows, min, max) of its buckets."""
        names = list(dict.fromkeys(i[0] for i in intervals))
        source = self.df
        if len(intervals) == 1 and names[0] in self.plain:
            # a range test on a stored column, so it reaches the file scan
            source = source.filter(F.col(names[0]).between(F.lit(intervals[0][1]), F.lit(intervals[0][2])))
        # every expression is evaluated once per row, whatever the number of its intervals
        source = source.select(*[group[name].alias(f"s{i}") for i, name in enumerate(names)])
        if len(intervals) == 1:
            v = F.col("s0")
            inside = source.filter(v.between(F.lit(intervals[0][1]), F.lit(intervals[0][2])))
            rows = inside.select(F.lit(0).alias("k"), v.alias("v"), bucket(v, *intervals[0][1:]).alias("b"))
        else:
            # only the intervals that hold a row's values become rows
            each = []
            for k, (name, low, high, log_scale) in enumerate(intervals):
                v = F.col(f"s{names.index(name)}")
                entry = F.struct(F.lit(k).alias("k"), v.alias("v"), bucket(v, low, high, log_scale).alias("b"))
                each.append(F.when(v.between(F.lit(low), F.lit(high)), entry))
            rows = source.select(F.explode(F.array_compact(F.array(*each))).alias("e")).select("e.*")
        counted = rows.groupBy("k", "b").agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).select("k", "n", "lo", "hi")
        out: list[list[tuple]] = [[] for _ in intervals]
        for r in counted.collect():
            out[r["k"]].append((r["n"], r["lo"], r["hi"]))
        for buckets in out:
            buckets.sort(key=lambda b: b[1])
        return out


def bucket(v: Column, low: float | int, high: float | int, log_scale: bool = False) -> Column:
    """Bucket of a value inside [low, high]: monotone in v, and different for low and high."""
    if isinstance(low, int):
        if high - low < 1 << 63:
            width = (high - low) // BUCKETS + 1
            return F.call_function("div", v - F.lit(low), F.lit(width)).cast("int")
        # too wide for a difference of longs: steps of two
        low, high = low >> 1, high >> 1
        width = (high - low) // BUCKETS + 1
        return F.call_function("div", F.shiftright(v, 1) - F.lit(low), F.lit(width)).cast("int")
    if log_scale:
        a, b = signed_log(low), signed_log(high)
        if a < b:
            scaled = F.signum(v) * F.log1p(F.least(F.abs(v) / F.lit(SMALLEST), F.lit(1.7e308)))
            share = (scaled - F.lit(a)) / F.lit(b - a)
            # the ends are set apart, as the other engine's logarithm may differ in the last bit
            inner = F.greatest(F.lit(1), F.least(F.floor(share * (BUCKETS - 2)) + 1, F.lit(BUCKETS - 2)))
            return F.when(v == F.lit(low), 0).when(v == F.lit(high), BUCKETS - 1).otherwise(inner).cast("int")
    if math.isinf(high - low):
        share = (v / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2)
    else:
        share = (v - F.lit(low)) / F.lit(high - low)
    return F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def signed_log(x: float) -> float:
    return math.copysign(math.log1p(min(abs(x) / SMALLEST, 1.7e308)), x)


def quantiles(
    df: DataFrame, probabilities: Mapping[str, Sequence[float]], series: Mapping[str, Column] | None = None,
    extent: Mapping[str, tuple] | None = None,
) -> dict[tuple[str, float], float | None]:
    """Exact linearly interpolated quantiles of columns or named expressions; None for an empty series."""
    search = SeriesSet(df, {name: (series or {}).get(name) for name in probabilities}, extent)
    extent = search.measure()
    wanted: dict[str, set[int]] = {}
    plan = {}
    for name, ps in probabilities.items():
        n = extent[name][0]
        for p in ps:
            if n == 0:
                plan[(name, p)] = None
                continue
            position = p * (n - 1)
            low = math.floor(position)
            high = min(low + 1, n - 1) if position > low else low
            plan[(name, p)] = (low, high, position - low)
            wanted.setdefault(name, set()).update((low, high))
    values = search.values_at(wanted)
    out = {}
    for (name, p), place in plan.items():
        if place is None:
            out[(name, p)] = None
            continue
        low, high, weight = place
        a, b = float(values[(name, low)].value), float(values[(name, high)].value)
        out[(name, p)] = a if a == b else a + (b - a) * weight
    return out


def quantile(df: DataFrame, column: str | Column, p: float) -> float | None:
    name = column if isinstance(column, str) else "value"
    expr = {} if isinstance(column, str) else {name: column}
    return quantiles(df, {name: [p]}, expr)[(name, p)]


def pair_cuts(
    df: DataFrame, major: str, minor: str, ranks: Callable[[int], Sequence[int]], minor_range: tuple[int, int]
) -> list[tuple]:
    """(major, minor) values standing at some ranks of the table ordered by (major, minor).

    ``ranks`` gives the ranks wanted for a number of rows; ``minor_range`` bounds the minor values. Both columns must
    be without gaps.
    """
    search = SeriesSet(df, {major: None})
    ranks = ranks(search.measure()[major][0])
    if not ranks:
        return []
    first = search.values_at({major: ranks})
    inner: dict[str, list[int]] = {}
    series: dict[str, Column] = {}
    extent: dict[str, tuple] = {}
    for rank in ranks:
        hit = first[(major, rank)]
        name = str(hit.value)
        series[name] = F.when(F.col(major) == F.lit(hit.value), F.col(minor))
        extent[name] = (hit.rows, *minor_range)
        inner.setdefault(name, []).append(rank - hit.below)
    # only the rows at the major values found can stand at a cut
    at_cuts = df.filter(F.col(major).isin([first[(major, rank)].value for rank in ranks]))
    second = SeriesSet(at_cuts, series, extent).values_at(inner)
    cuts = []
    for rank in ranks:
        hit = first[(major, rank)]
        cuts.append((hit.value, second[(str(hit.value), rank - hit.below)].value))
    return cuts


def not_after(major: str, minor: str, cut: tuple) -> Column:
    """Rows that come no later than a cut in (major, minor) order."""
    return (F.col(major) < F.lit(cut[0])) | ((F.col(major) == F.lit(cut[0])) & (F.col(minor) <= F.lit(cut[1])))
