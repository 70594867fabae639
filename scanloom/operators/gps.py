"""GNSS fixes: validity, reports, tracks, and the fit of a local trajectory to the map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import geometry as geo
from scanloom.functions.naming import iso_ms
from scanloom.operators.series import Series


def gps_valid() -> Column:
    """Active, with known hemispheres, milliseconds below 1000, and a finite place that is not next to zero."""
    lat, lon = F.col("lat"), F.col("lon")
    known = F.col("ns").isin("N", "S") & F.col("ew").isin("E", "W") & (F.col("status") == "A") & F.col("ms").between(0, 999)
    return F.coalesce(known & lat.between(0, 90) & lon.between(0, 180) & ~F.isnan("alt") & ((lat > 1e-6) | (lon > 1e-6)), F.lit(False))


def signed_fixes(gps: DataFrame) -> DataFrame:
    """Latitude and longitude with the hemisphere's sign, and t in seconds."""
    return gps.withColumns({
        "lat": F.when(F.col("ns") == "S", -F.col("lat")).otherwise(F.col("lat")),
        "lon": F.when(F.col("ew") == "W", -F.col("lon")).otherwise(F.col("lon")),
        "t": F.col("epoch") + F.col("ms") / 1000,
    })


def dedupe_fixes(gps: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """The first record of each time and place."""
    first = F.row_number().over(Window.partitionBy(*keys, "epoch", "ms", "lat", "lon").orderBy("event_id", "copy"))
    return gps.withColumn("_k", first).where("_k = 1").drop("_k")


def gps_report(gps: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Records, valid, invalid, unique, duplicates, times, places, span and a class of what the fixes can serve for."""
    valid = gps.withColumn("_ok", gps_valid())
    place = F.when(F.col("_ok"), F.struct("lat", "ns", "lon", "ew"))
    time = F.when(F.col("_ok"), F.struct("epoch", "ms"))
    t = F.when(F.col("_ok"), F.col("epoch") + F.col("ms") / 1000)
    out = valid.groupBy(*keys).agg(
        F.count("*").alias("records"), F.count_if("_ok").alias("valid"), F.count_if(~F.col("_ok")).alias("invalid"),
        F.count_distinct(F.when(F.col("_ok"), F.struct("epoch", "ms", "lat", "lon"))).alias("unique"),
        F.count_distinct(time).alias("times"), F.count_distinct(place).alias("places"), F.coalesce(F.max(t) - F.min(t), F.lit(0.0)).alias("span"),
    )
    kind = F.when(F.col("unique") == 0, "no_valid_fix").when(F.col("places") < 2, "location_anchor_only").when(F.col("places") < 3, "insufficient_track").otherwise("track")
    return out.withColumns({"duplicates": F.col("valid") - F.col("unique"), "status": kind})


def track_stats(gps: DataFrame, zone: int, south: bool, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Mean place, bounds, length in metres and seconds of each series of unique valid fixes."""
    fixes = dedupe_fixes(signed_fixes(gps.where(gps_valid())), keys)
    e, n = geo.to_utm("lat", "lon", zone, south)
    series = Series(fixes.withColumns({"e": e, "n": n}), keys, "t", "event_id", "copy")
    steps = series.lag(series.rows, _e=F.col("e"), _n=F.col("n")).withColumn("step", F.sqrt(F.pow(F.col("e") - F.col("_e"), 2) + F.pow(F.col("n") - F.col("_n"), 2)))
    return steps.groupBy(*keys).agg(
        F.count("*").alias("n_fixes"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.min("e").alias("e0"), F.max("e").alias("e1"),
        F.min("n").alias("n0"), F.max("n").alias("n1"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"), (F.max("t") - F.min("t")).alias("seconds"),
    )


def gap_segments(gps: DataFrame, gap: float = 10.0, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Fixes with the number of their segment: a new one begins after a gap, or across the antimeridian. Segments of one fix go."""
    series = Series(gps, keys, "t", "event_id")
    rows = series.lag(series.rows, _t=F.col("t"), _lon=F.col("lon"))
    new = (F.col("t") - F.col("_t") > gap) | (F.abs(F.col("lon") - F.col("_lon")) > 180)
    out = series.running(rows, segment=F.coalesce(new, F.lit(False)).cast("int")).drop("_t", "_lon", "_cut")
    long = out.groupBy(*keys, "segment").agg(F.count("*").alias("_n")).where("_n >= 2").drop("_n")
    return out.join(long, [*keys, "segment"], "left_semi").select(*gps.columns, "segment")


def timestamps(gps: DataFrame) -> DataFrame:
    return gps.withColumn("utc", iso_ms("epoch", "ms"))


def fit_yaw_shift(gps: DataFrame, trajectory: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Yaw and shift that carry a local trajectory onto map fixes: main directions of both, the sign by start-to-end motion.

    gps: t, e, n. Sums of shifted coordinates only, so that map magnitudes cost no precision. One row a group.
    """

    def summary(rows: DataFrame, x: str, y: str, p: str) -> DataFrame:
        mean = rows.groupBy(*keys).agg(F.avg(x).alias(f"{p}mx"), F.avg(y).alias(f"{p}my"), F.count("*").alias(f"{p}count"))
        near = rows.join(mean, list(keys)).withColumns({"_x": F.col(x) - F.col(f"{p}mx"), "_y": F.col(y) - F.col(f"{p}my")})
        turn = F.atan2(2 * F.sum(F.col("_x") * F.col("_y")), F.sum(F.col("_x") * F.col("_x")) - F.sum(F.col("_y") * F.col("_y"))) / 2
        motion = [(F.max_by(c, "t") - F.min_by(c, "t")).alias(f"{p}{n}") for c, n in (("_x", "dx"), ("_y", "dy"))]
        return near.groupBy(*keys).agg(F.first(f"{p}mx").alias(f"{p}mx"), F.first(f"{p}my").alias(f"{p}my"), F.first(f"{p}count").alias(f"{p}count"), turn.alias(f"{p}turn"), *motion)

    both = summary(gps, "e", "n", "g_").join(summary(trajectory, "px", "py", "l_"), list(keys))
    yaw = F.col("g_turn") - F.col("l_turn")
    dot = (F.cos(yaw) * F.col("l_dx") - F.sin(yaw) * F.col("l_dy")) * F.col("g_dx") + (F.sin(yaw) * F.col("l_dx") + F.cos(yaw) * F.col("l_dy")) * F.col("g_dy")
    both = both.withColumn("yaw", yaw + F.when(dot < 0, F.pi()).otherwise(0.0))
    return both.select(
        *keys, F.atan2(F.sin("yaw"), F.cos("yaw")).alias("yaw"),
        (F.col("g_mx") - (F.cos("yaw") * F.col("l_mx") - F.sin("yaw") * F.col("l_my"))).alias("tx"),
        (F.col("g_my") - (F.sin("yaw") * F.col("l_mx") + F.cos("yaw") * F.col("l_my"))).alias("ty"), "g_count", "l_count",
    )
