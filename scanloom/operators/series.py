"""Series in order without a task that holds one: rows are dealt into stretches whose number follows from the rows.

A series with more rows than a stretch should have is cut at its own quantiles, so neither one long session nor outlying
times or ids put many rows into one stretch. Stretches are sorted apart. What crosses their edges (the last row, the sum)
is one row a stretch, carried over by a window over these rows alone. Rows of equal times lie in one stretch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a stretch, in the mean; stretches that one is cut into at once (longer ones are cut again); rows of bounds that are broadcast.
STRETCH_ROWS, FAN, BROADCAST_ROWS = 200_000, 256, 20_000


def small(df: DataFrame) -> DataFrame:
    """Broadcast if it is, else left to Catalyst."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def ordered(keys: Sequence[str], *order: str | Column):
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return w.orderBy(*order)


def _place(bounds: str, time: str, parts: int) -> Column:
    """How many of the sorted bounds are at most the time, by halving."""
    half = "cast((a.lo + a.hi) div 2 as int)"
    step = f"if(a.lo < a.hi, if({bounds}[{half}] <= `{time}`, struct({half} + 1 as lo, a.hi as hi), struct(a.lo as lo, {half} as hi)), a)"
    return F.expr(f"aggregate(sequence(1, {parts.bit_length()}), struct(0 as lo, size({bounds}) as hi), (a, i) -> {step}, a -> a.lo)")


def stretched(rows: DataFrame, keys: Sequence[str], time: str, most: int | None = None) -> tuple[DataFrame, bool]:
    """The rows with _cut, the number of their stretch, ascending with time in each series; and whether any series was cut.

    The number of stretches is that of the longest series' rows over most: one count, and one sketch of quantiles where
    a series is longer. Null times lie in the first stretch.
    """
    most, by, was, cut = most or STRETCH_ROWS, [*keys, "_cut"], None, False
    rows = rows.withColumn("_cut", F.lit(0).cast("long"))
    while True:
        top = rows.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
        parts = min(FAN, -(-top // most))
        if parts <= 1 or (was is not None and top >= was):  # rows of one time can't be told apart
            return rows, cut
        shares = [k / parts for k in range(1, parts)]
        bounds = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx(time, shares, 8 * parts).alias("_bounds")).where(F.col("_n") > most).drop("_n")
        rows = rows.join(small(bounds), by, "left").withColumn("_cut", F.col("_cut") * FAN + F.when(F.col("_bounds").isNotNull(), _place("_bounds", time, parts)).otherwise(0)).drop("_bounds")
        cut = True
        if top <= most * FAN:
            return rows, cut
        was = top


class Series:
    """Rows of series in an order; its methods take these rows (with what was added to them) and add columns.

    The order's columns should tell rows apart; rows that are equal in all of them come in any order.
    """

    def __init__(self, rows: DataFrame, keys: Sequence[str], *order: str, most: int | None = None):
        self.keys, self.order = list(keys), list(order)
        self.rows, self.cut = stretched(rows, keys, order[0], most)
        self.by = [*keys, "_cut"]

    def _next(self, rows: DataFrame, columns: dict[str, Column], ahead: bool) -> DataFrame:
        shift, last = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
        held = rows.withColumn("_s", F.struct(*[c.alias(n) for n, c in columns.items()]))
        found = held.withColumn("_p", shift("_s").over(ordered(self.by, *self.order)))
        if self.cut:
            ends = held.groupBy(*self.by).agg(last("_s", F.struct(*self.order)).alias("_e"))
            ends = ends.withColumn("_e", shift("_e").over(ordered(self.keys, "_cut")))  # one row a stretch
            found = found.join(ends, self.by, "left").withColumn("_p", F.coalesce("_p", "_e")).drop("_e")
        return found.withColumns({n: F.col(f"_p.{n}") for n in columns}).drop("_s", "_p")

    def lag(self, rows: DataFrame, **columns: Column) -> DataFrame:
        """Values of the row before in the series; null at its first."""
        return self._next(rows, columns, False)

    def lead(self, rows: DataFrame, **columns: Column) -> DataFrame:
        """Values of the row after."""
        return self._next(rows, columns, True)

    def running(self, rows: DataFrame, **columns: Column) -> DataFrame:
        """Sums from the first row of the series to the row itself."""
        frame = ordered(self.by, *self.order).rowsBetween(Window.unboundedPreceding, 0)
        found = rows.withColumns({n: F.sum(c).over(frame) for n, c in columns.items()})
        if self.cut:
            sums = rows.groupBy(*self.by).agg(*[F.sum(c).alias(f"_b{k}") for k, c in enumerate(columns.values())])
            before = ordered(self.keys, "_cut").rowsBetween(Window.unboundedPreceding, -1)
            sums = sums.withColumns({f"_b{k}": F.sum(f"_b{k}").over(before) for k in range(len(columns))})
            found = found.join(sums, self.by, "left").withColumns({n: F.coalesce(F.col(n) + F.col(f"_b{k}"), n, f"_b{k}") for k, n in enumerate(columns)}).drop(*[f"_b{k}" for k in range(len(columns))])
        return found

    def ranked(self, rows: DataFrame, name: str) -> DataFrame:
        """Places 0, 1, ... in the series."""
        return self.running(rows, **{name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)
