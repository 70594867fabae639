"""Exact percentiles of whole tables and of groups without a reducer that holds all values."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.operators.lineage import checkpoint
from scanloom.operators.series import small

#: Buckets of a pass. A pass brings at most so many rows a percentile to the driver, whatever the size of the table.
BUCKETS = 2048


def _settle(found: list, at: int) -> tuple[float, float] | tuple[float, float, int]:
    """From (bucket's count, least, largest) in order: the values of ranks at and at + 1, or the bucket with both and the rank in it."""
    for k, (n, low, high) in enumerate(found):
        if at < n - 1 or (at == n - 1 and k + 1 == len(found)):
            return (low, high) if low == high else (high, high) if at == n - 1 else (low, high, at)
        if at == n - 1:
            return high, found[k + 1][1]
        at -= n
    raise ValueError("rank beyond the rows")


def exact_percentiles(rows: DataFrame, wanted: Mapping[str, tuple[Column, float]]) -> dict[str, float | None]:
    """By name, the percentile (share in 0..1, interpolated between ranks) of a column; null where it has no finite value.

    Values are counted in buckets between the bounds of the part that holds the rank, and that part is narrowed to one
    bucket, until the rank and its successor are known: about log(rows) / log(BUCKETS) passes of one small partial
    aggregation each. No sort, no shuffle of rows. Nulls, NaN and infinities don't count; ties and repeated rows do.
    """
    names = list(wanted)
    values = rows.select(*[wanted[n][0].cast("double").alias(f"v{k}") for k, n in enumerate(names)])
    finite = [F.when(F.abs(F.col(f"v{k}")) < float("inf"), F.col(f"v{k}")) for k in range(len(names))]
    values = values.select(*[v.alias(f"v{k}") for k, v in enumerate(finite)])
    ends = values.agg(*[f(f"v{k}").alias(f"{n}{k}") for k in range(len(names)) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    out: dict[str, float | None] = {}
    held: dict[int, tuple[float, float, int]] = {}
    pairs: dict[int, tuple[float, float]] = {}
    for k, name in enumerate(names):
        n, low, high = ends[f"n{k}"], ends[f"lo{k}"], ends[f"hi{k}"]
        if not n:
            out[name] = None
        elif low == high:
            pairs[k] = low, high
        else:
            held[k] = low, high, min(math.floor(wanted[name][1] * (n - 1)), n - 1)
    while held:
        marks = []
        for k, (low, high, _) in held.items():
            v = F.col(f"v{k}")
            place = F.least(F.floor((v - low) / (high - low) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
            marks.append(F.when(v.between(low, high), F.struct(F.lit(k).alias("k"), place.alias("b"), v.alias("v"))))
        counted = values.select(F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())).alias("m")).groupBy("m.k", "m.b")
        found: dict[int, list] = {k: [] for k in held}
        for r in counted.agg(F.count("*").alias("n"), F.min("m.v").alias("lo"), F.max("m.v").alias("hi")).collect():
            found[r["k"]].append((r["b"], r["n"], r["lo"], r["hi"]))
        for k, (_, _, at) in list(held.items()):
            got = _settle([b[1:] for b in sorted(found[k])], at)
            if len(got) == 3:
                held[k] = got
            else:
                pairs[k] = got
                del held[k]
    for k, (low, high) in pairs.items():
        place = wanted[names[k]][1] * (ends[f"n{k}"] - 1)
        under, over = math.floor(place), math.ceil(place)
        out[names[k]] = low if under == over or low == high else (over - place) * low + (place - under) * high
    return out


def percentile_row(rows: DataFrame, wanted: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """The percentiles as a table of one row."""
    found = exact_percentiles(rows, wanted)
    return rows.sparkSession.range(1).select(*[F.lit(found[n]).cast("double").alias(n) for n in wanted])


def grouped_percentiles(rows: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """keys and, by name, the percentile of a column in each group of rows (null keys are a group); null where it has no finite value.

    As exact_percentiles, but the bounds of all groups narrow in the same passes, as a table that is never collected: a pass
    is one partial aggregation to at most BUCKETS rows a group and name. So a group's values never meet in one task.
    """
    keys, names = list(keys), list(wanted)
    marks = F.array(*[F.struct(F.lit(k).alias("k"), F.when(F.abs(c.cast("double")) < float("inf"), c.cast("double")).alias("v")) for k, (c, _) in enumerate(wanted.values())])
    named = [F.col(c).alias(f"_g{i}") for i, c in enumerate(keys)]
    by = [*[f"_g{i}" for i in range(len(keys))], "_k"]
    values = rows.select(*named, F.explode(marks).alias("_m")).select(*by[:-1], F.col("_m.k").alias("_k"), F.col("_m.v").alias("_v")).where("_v is not null")
    share = F.element_at(F.array(*[F.lit(float(p)) for _, p in wanted.values()]), F.col("_k") + 1)
    ends = values.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")).withColumn("_place", share * (F.col("_n") - 1))
    same = F.when(F.col("_low") == F.col("_high"), F.col("_low"))
    state = checkpoint(ends.select(*by, "_place", "_low", "_high", F.floor("_place").alias("_at"), same.alias("_a"), same.alias("_b")))
    settled = []
    while True:
        settled.append(state.where("_a is not null"))
        left = state.where("_a is null")
        if left.isEmpty():
            break
        held = left.select(*[F.col(c).alias(f"s{c}") for c in by], "_place", "_low", "_high", "_at")
        met = None
        for c in by:
            met = values[c].eqNullSafe(held[f"s{c}"]) if met is None else met & values[c].eqNullSafe(held[f"s{c}"])
        part = values.join(small(held), met).where("_v between _low and _high")
        place = F.least(F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        found = part.groupBy(*by, "_place", "_at", place.alias("_bucket")).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        over = Window.partitionBy(*by).orderBy("_bucket")  # BUCKETS rows at most
        found = found.withColumns({"_before": F.sum("_n").over(over) - F.col("_n"), "_after": F.lead("_low").over(over)})
        hit = found.where((F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_n")))
        end = F.col("_at") == F.col("_before") + F.col("_n") - 1  # the successor lies in the next bucket
        same = F.col("_low") == F.col("_high")
        state = checkpoint(hit.select(*by, "_place", "_low", "_high", (F.col("_at") - F.col("_before")).alias("_at"), F.when(end | same, F.col("_high")).alias("_a"), F.when(end, F.coalesce("_after", "_high")).when(same, F.col("_high")).alias("_b")))
    done = settled[0]
    for more in settled[1:]:
        done = done.unionByName(more)
    part = F.col("_place") - F.floor("_place")
    done = done.withColumn("_v", F.when((part == 0) | (F.col("_a") == F.col("_b")), F.col("_a")).otherwise((1 - part) * F.col("_a") + part * F.col("_b")))
    found = done.groupBy(*by[:-1]).agg(*[F.max(F.when(F.col("_k") == k, F.col("_v"))).alias(n) for k, n in enumerate(names)])
    groups = rows.select(*keys).distinct()
    met = F.lit(True)
    for i, c in enumerate(keys):
        met = met & groups[c].eqNullSafe(found[f"_g{i}"])
    return groups.join(found, met, "left").select(*[groups[c] for c in keys], *names)
