"""Time series of poses, frames, messages and scans: windows, as-of and interval joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.functions import geometry as geo
from scanloom.operators.series import Series, ordered as _by, small as _small, stretched


# Summaries and slices of logs


def summarize_log(messages: DataFrame) -> DataFrame:
    """Messages and seconds of each topic."""
    out = messages.groupBy("topic", "msgtype").agg(F.count("*").alias("n"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))
    return out.withColumn("seconds", (F.col("last_ns") - F.col("first_ns")) / 1e9)


def slice_messages(messages: DataFrame, start: float, end: float, origin_ns: Column | int = 0) -> DataFrame:
    """Closed bounds in seconds after the origin, cut to whole nanoseconds."""
    origin = origin_ns if isinstance(origin_ns, Column) else F.lit(origin_ns)
    return messages.where(F.col("ts_ns").between(origin + int(start * 1e9), origin + int(end * 1e9)))


def trim_synchronized(lidar: DataFrame, video: DataFrame, start: float, end: float, offset: float, length: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The same span of two logs whose clocks differ: video time = lidar time + offset. Starts are clamped to 0, the video's end to its length."""
    a, b = max(0.0, start), end
    va, vb = max(0.0, a + offset), b + offset if length is None else min(length, b + offset)
    if a >= b or va >= vb:
        raise ValueError("the span is empty")
    return lidar.where(F.col("t").between(a, b)), video.where(F.col("t").between(va, vb))


#: What a topic must look like to play a role, best first: (message type, topic) patterns.
ROLES = {
    "lidar": ((r"(?i)livox.*custom", r".*"), (r"(?i)pointcloud2", r"(?i)lidar|points|cloud"), (r"(?i)pointcloud2", r".*")),
    "imu": ((r"(?i)imu", r"(?i)lidar|livox"), (r"(?i)imu", r".*")),
    "image": ((r"(?i)compressedimage", r".*"), (r"(?i)image", r".*")),
}


def detect_topics(topics: DataFrame, roles: dict[str, Sequence[tuple[str, str]]] = ROLES) -> DataFrame:
    """The topic of each role: the best pattern, then the most messages, then the name."""
    parts = []
    for role, patterns in roles.items():
        rank = F.lit(None).cast("int")
        for k, (kind, name) in reversed(list(enumerate(patterns))):
            rank = F.when(F.col("msgtype").rlike(kind) & F.col("topic").rlike(name), k).otherwise(rank)
        parts.append(topics.select(F.lit(role).alias("role"), "topic", "msgtype", "n", rank.alias("rank")).where("rank is not null"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    first = F.row_number().over(Window.partitionBy("role").orderBy("rank", F.desc("n"), "topic"))
    return out.withColumn("_k", first).where("_k = 1").drop("_k", "rank")


def merge_logs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both logs in one, by time and then source."""
    return a.withColumn("source", F.lit(0)).unionByName(b.withColumn("source", F.lit(1))).orderBy("ts_ns", "source")


def time_order(rows: DataFrame, *ties: str, time: str = "t") -> DataFrame:
    """Global order by time; a range-partitioned sort."""
    return rows.orderBy(time, *ties)


# Windows over one series


def step_stats(rows: DataFrame, keys: Sequence[str] = ("session",), time: str = "t", names: Sequence[str] = ("px", "py", "pz")) -> DataFrame:
    """Seconds, distance and speed since the row before."""
    series = Series(rows, keys, time)
    out = series.lag(series.rows, _before=F.struct(time, *names))
    d = F.sqrt(sum((F.pow(F.col(c) - F.col(f"_before.{c}"), 2) for c in names), F.lit(0.0)))
    out = out.withColumns({"dt": F.col(time) - F.col(f"_before.{time}"), "step": d}).drop("_before", "_cut")
    return out.withColumn("speed", F.when(F.col("dt") > 0, F.col("step") / F.col("dt")))


def assert_increasing(rows: DataFrame, keys: Sequence[str], time: str = "t") -> DataFrame:
    """Rows that don't come after the row before them in the given order (column ord, else by time); empty if all is well."""
    series = Series(rows, keys, "ord" if "ord" in rows.columns else time)
    return series.lag(series.rows, before=F.col(time)).where(F.col(time) <= F.col("before")).drop("_cut")


def assert_contiguous(ranges: DataFrame, n: int | None = None, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Ranges that don't start where those before end, or that end beyond n; empty if all is well."""
    series = Series(ranges, keys, "t")
    out = series.running(series.rows, expected=F.col("point_count")).withColumn("expected", F.col("expected") - F.coalesce("point_count", F.lit(0))).drop("_cut")
    bad = (F.col("point_start") != F.col("expected")) | (F.col("point_count") < 0)
    return out.where(bad if n is None else bad | (F.col("point_start") + F.col("point_count") > n))


def sharpest_per_bucket(frames: DataFrame, fps: float, first: int, keys: Sequence[str] = ("session",)) -> DataFrame:
    """The sharpest of the first so many frames of each bucket of 1 / fps seconds; ties go to the earliest."""
    bucket = F.floor(F.greatest(F.lit(0.0), F.col("t")) * fps + 1e-7).cast("long")
    w = Window.partitionBy(*keys, "bucket")
    early = frames.withColumn("bucket", bucket).withColumn("_k", F.row_number().over(w.orderBy("t", "name"))).where(F.col("_k") <= first)
    return early.withColumn("_k", F.row_number().over(w.orderBy(F.desc("sharpness"), "t", "name"))).where("_k = 1").drop("_k")


def motion_onset(trajectory: DataFrame, distance: float = 1.5, hold: float = 15.0, keys: Sequence[str] = ("session",)) -> DataFrame:
    """The first time at which the distance from the start is reached and, for the hold, not lost by more than a quarter.

    A series that never qualifies starts at its first time (moving is false). The next time that the distance is lost is
    carried back over the rows, so that no frame spans the hold.
    """
    start = trajectory.groupBy(*keys).agg(F.min_by(F.struct("px", "py", "pz"), "t").alias("_start"))
    rows = trajectory.join(_small(start), list(keys)) if keys else trajectory.crossJoin(F.broadcast(start))
    rows = rows.withColumn("_far", F.sqrt(sum((F.pow(F.col(c) - F.col(f"_start.{c}"), 2) for c in ("px", "py", "pz")), F.lit(0.0))))
    lost = F.col("_far") < 0.75 * distance
    rows = rows.select(*keys, "t", "_far", F.col("t").alias("_t"), lost.cast("int").alias("_kind"), F.when(lost, F.col("t")).alias("_lost"))
    rows = _beside(rows, keys, "_lost")
    hit = F.when((F.col("_far") >= distance) & (F.col("_b").isNull() | (F.col("_b") > F.col("t") + hold)), F.col("t"))
    return rows.withColumn("_hit", hit).groupBy(*keys).agg(F.coalesce(F.min("_hit"), F.min("t")).alias("onset"), F.max("_hit").isNotNull().alias("moving"))


def max_overlap(rows: DataFrame, span: float, keys: Sequence[str] = ("session",)) -> DataFrame:
    """The most rows that any span of so many seconds holds: each row comes, and goes a span later; the most that are there at once.

    Each stretch of time has its sum and the highest point of its running sum; both combine over the stretches.
    """
    come = rows.select(*keys, F.col("t").alias("_t"), F.lit(0).alias("_kind"), F.lit(1).alias("_w"))
    both, _ = stretched(come.unionByName(rows.select(*keys, (F.col("t") + span).alias("_t"), F.lit(1).alias("_kind"), F.lit(-1).alias("_w"))), keys, "_t")
    run = F.sum("_w").over(_by([*keys, "_cut"], "_t", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    parts = both.withColumn("_run", run).groupBy(*keys, "_cut").agg(F.sum("_w").alias("_sum"), F.max("_run").alias("_high"))
    base = F.coalesce(F.sum("_sum").over(_by(keys, "_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a stretch
    return parts.withColumn("_high", F.col("_high") + base).groupBy(*keys).agg(F.max("_high").alias("most"))


def cyclic_pairs(obs: DataFrame, group: str = "point_id", order: Sequence[str] = ("frame_id", "obs")) -> DataFrame:
    """Each observation with its successor in the group, the last with the first; groups of one have no pairs."""
    w = Window.partitionBy(group).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = F.struct(*[c for c in obs.columns if c != group])
    out = obs.select(group, row.alias("a"), F.coalesce(F.lead(row).over(w), F.first(row).over(whole)).alias("b"), F.count("*").over(whole).alias("_n"))
    return out.where("_n > 1").drop("_n")


def overlap_chunks(rows: DataFrame, length: float, overlap: float, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Rows in each chunk they belong to. Chunks start length - overlap apart from each series' first time; both ends belong to them.

    A chunk's number follows from a row's time by arithmetic, so that no list of chunks is joined.
    """
    if length <= 0 or not 0 <= overlap < length:
        raise ValueError("a chunk must be longer than its overlap")
    step = length - overlap
    ends = rows.groupBy(*keys).agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    last = F.greatest(F.lit(0), F.ceil((F.col("_t1") - F.col("_t0") - length) / step)).cast("long")
    joined = rows.join(ends.withColumn("_last", last), list(keys))
    at = F.col("t") - F.col("_t0")
    low = F.greatest(F.lit(0), F.ceil((at - length) / step)).cast("long")
    high = F.least(F.col("_last"), F.floor(at / step)).cast("long")
    return joined.withColumn("chunk", F.explode(F.sequence(low, high))).withColumn("name", F.format_string("chunk_%02d", "chunk")).drop("_t0", "_t1", "_last")


def chunk_list(total: float, length: float, overlap: float) -> list[tuple[float, float]]:
    """Start and end of each chunk of a span; the last is cut at the end."""
    if length <= 0 or not 0 <= overlap < length or total <= 0:
        raise ValueError("a chunk must be longer than its overlap, and the span positive")
    out, k, step = [], 0, length - overlap
    while True:
        out.append((k * step, min(total, k * step + length)))
        if k * step + length >= total:
            return out
        k += 1


def bounded_clip(frames: DataFrame, n: int, center: float, keys: Sequence[str] = ("session",)) -> DataFrame:
    """At most n frames in a row, around the one nearest to the given time (kept inside the series)."""
    series = Series(frames, keys, "t", "name")
    ranked = series.ranked(series.rows, "_k").drop("_cut")
    mid = ranked.groupBy(*keys).agg(F.min(F.struct(F.abs(F.col("t") - center), "_k"))["_k"].alias("_m"), F.count("*").alias("_n"))
    start = F.greatest(F.lit(0), F.least(F.col("_m") - n // 2, F.col("_n") - n))
    held = ranked.join(_small(mid), list(keys)) if keys else ranked.crossJoin(F.broadcast(mid))
    return held.where((F.col("_k") >= start) & (F.col("_k") < start + n)).drop("_k", "_n", "_m")


def line_diffs(scan: DataFrame, keys: Sequence[str] = ("scan_id", "ring")) -> DataFrame:
    """Range of each return and squared distance to the next on its line."""
    w = _by(keys, "idx")
    d2 = sum((F.pow(F.lead(c).over(w) - F.col(c), 2) for c in ("x", "y", "z")), F.lit(0.0))
    return scan.withColumns({"range": F.sqrt(F.col("x") ** 2 + F.col("y") ** 2), "d2_next": d2})


def ring_times(scan: DataFrame, omega: float = 3.61, keys: Sequence[str] = ("scan_id", "ring")) -> DataFrame:
    """Milliseconds of each return from its yaw (rel_ms), for sensors that turn at omega degrees a millisecond and send no times.

    Yaw falls as the sensor turns; each time it rises again, a turn is over: turn counts them, turn_ms is the time since.
    """
    w = _by(keys, "idx")
    rows = scan.withColumn("_yaw", F.degrees(F.atan2("y", "x")))
    delta = F.first("_yaw").over(w) - F.col("_yaw")
    rows = rows.withColumn("turn_ms", F.when(delta >= 0, delta / omega).otherwise((delta + 360) / omega))
    rows = rows.withColumn("_w", F.when(F.col("turn_ms") < F.lag("turn_ms").over(w), 1).otherwise(0)).withColumn("turn", F.sum("_w").over(w))
    return rows.withColumn("rel_ms", F.col("turn_ms") + F.col("turn") * 360 / omega).drop("_yaw", "_w")


def running_valid(scan: DataFrame, k: int, keys: Sequence[str] = ("scan_id",)) -> DataFrame:
    """Every k-th of the valid returns of a scan, counted from the first."""
    count = F.sum(F.col("valid").cast("int")).over(_by(keys, "idx"))
    return scan.withColumn("_n", count).where(F.col("valid") & (F.pmod(F.col("_n"), F.lit(k)) == 0)).drop("_n")


def submaps(points: DataFrame, ranges: DataFrame, seconds: float = 10.0, least: int = 200, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Windows of so many seconds from the first scan: points, scans, and the time half-way between the first and last scan."""
    first = ranges.groupBy(*keys).agg(F.min("t").alias("_t0"))
    placed = points_with_scan(points, ranges, keys).join(first, list(keys))
    node = F.floor((F.col("t") - F.col("_t0")) / seconds).cast("long")
    out = placed.groupBy(*keys, node.alias("node")).agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"))
    return out.where(F.col("n") >= least).withColumn("t", (F.col("t0") + F.col("t1")) / 2)


# As-of and interval joins

def _beside(rows: DataFrame, keys: Sequence[str], value: str, after_equal: bool = False) -> DataFrame:
    """The rows with _a, the last value at or before, and _b, the first value after each row, by _t and then _kind.

    Rows without a value have null there. With after_equal, _b may lie at the same time as the row. Series are cut into
    stretches of time, which are sorted apart; what reaches over their edges is one row each. So neither a frame nor a
    task grows with the length of a series.
    """
    cut, any_cut = stretched(rows, keys, "_t")
    by = [*keys, "_cut"]
    ahead = _by(by, "_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    back = _by(by, F.desc("_t"), F.asc("_kind") if after_equal else F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    found = cut.withColumns({"_a": F.last(value, True).over(ahead), "_b": F.last(value, True).over(back)})
    if not any_cut:
        return found.drop("_cut")
    time = F.when(F.col(value).isNotNull(), F.col("_t"))
    edges = cut.groupBy(*by).agg(F.max_by(value, time).alias("_last"), F.min_by(value, time).alias("_first"))
    over = _by(keys, "_cut")  # one row a stretch
    before, after = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(1, Window.unboundedFollowing)
    edges = edges.select(*by, F.last("_last", True).over(before).alias("_before"), F.first("_first", True).over(after).alias("_after"))
    out = found.join(edges, by, "left")
    return out.withColumns({"_a": F.coalesce("_a", "_before"), "_b": F.coalesce("_b", "_after")}).drop("_before", "_after", "_cut")


def _merged(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, value: Column, kinds: tuple[int, int] = (1, 0)) -> DataFrame:
    """Rows of left (in _row) and values of right (in _value) in one table, by _t and _kind."""
    row = F.struct(*left.columns)
    both = left.select(*keys, F.col(left_time).alias("_t"), F.lit(kinds[0]).alias("_kind"), row.alias("_row"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_value"))
    return both.unionByName(right.select(*keys, F.col(right_time).alias("_t"), F.lit(kinds[1]).alias("_kind"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), value.alias("_value")))


def asof_interpolate(left: DataFrame, poses: DataFrame, policy: str = "drop", keys: Sequence[str] = ("session",), time: str = "t") -> DataFrame:
    """Rows of left with px..qw interpolated between the poses before and after: linear, and on the shorter arc.

    Of several poses at one time the one with the least px, py, pz, qx, qy, qz, qw (in that order) counts.
    One union, sorted by stretches of time: no range join. Policy: drop rows outside the poses' times, clip
    them to the ends (valid is false), or error on them.
    """
    names = ("px", "py", "pz", "qx", "qy", "qz", "qw")
    poses = poses.groupBy(*keys, "t").agg(F.min(F.struct(*names)).alias("_p")).select(*keys, "t", "_p.*")
    found = _beside(_merged(left, poses, keys, time, "t", F.struct(F.col("t"), *names)), keys, "_value").where("_kind = 1")
    inside = F.col("_a").isNotNull() & (F.col("_b").isNotNull() | (F.col("_a.t") == F.col("_t")))
    if policy == "error":
        found = found.withColumn("_a", F.when(inside, F.col("_a")).otherwise(F.raise_error(F.lit("a time lies outside the trajectory"))))
    elif policy == "drop":
        found = found.where(inside)
    a = F.coalesce(F.col("_a"), F.col("_b"))
    b = F.when(F.col("_a.t") == F.col("_t"), F.col("_a")).otherwise(F.coalesce(F.col("_b"), F.col("_a")))
    found = found.select("_row.*", a.alias("_a"), b.alias("_b"), F.col("_t"), inside.alias("valid"))
    span = F.col("_b.t") - F.col("_a.t")
    u = F.when(span > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_t") - F.col("_a.t")) / span))).otherwise(0.0)
    turn = lambda p: F.struct(*[F.col(f"{p}.q{k}").cast("double").alias(k) for k in "xyzw"])
    out = geo.with_slerp(found.withColumn("_u", u), turn("_a"), turn("_b"), F.col("_u"), "_q")
    own = {c: F.col(f"_a.{c}") + (F.col(f"_b.{c}") - F.col(f"_a.{c}")) * F.col("_u") for c in names[:3]}
    own |= {f"q{c}": F.col(f"_q.{c}") for c in "xyzw"}
    return out.withColumns(own).withColumn("alpha", F.col("_u")).drop("_a", "_b", "_t", "_u", "_q")


def knot_weights(left: DataFrame, poses: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """The times of the knots around each row, and how far between them it lies."""
    found = _beside(_merged(left, poses, keys, "t", "t", F.col("t")), keys, "_value", after_equal=True).where("_kind = 1 and _a is not null and _b is not null")
    return found.select("_row.*", F.col("_a").alias("knot0"), F.col("_b").alias("knot1"), ((F.col("_t") - F.col("_a")) / (F.col("_b") - F.col("_a"))).alias("alpha"))


def nearest_frame(left: DataFrame, frames: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """The frame closest in time to each row; ties go to the earlier."""
    found = _beside(_merged(left, frames, keys, "t", "t", F.struct("t", "name")), keys, "_value").where("_kind = 1")
    left_near = F.col("_a").isNotNull() & (F.col("_b").isNull() | (F.col("_t") - F.col("_a.t") <= F.col("_b.t") - F.col("_t")))
    return found.withColumn("_f", F.when(left_near, F.col("_a")).otherwise(F.col("_b"))).select("_row.*", F.col("_f.name").alias("frame"), F.col("_f.t").alias("frame_t"))


def points_with_scan(points: DataFrame, ranges: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """The scan time of each point whose id lies in a half-open range of ids: ids are sorted by stretches, no range join."""
    scan = F.struct(F.col("t").cast("double").alias("t"), (F.col("point_start") + F.col("point_count")).cast("long").alias("end"))
    found = _beside(_merged(points, ranges.where("point_count > 0"), keys, "point_id", "point_start", scan), keys, "_value")
    return found.where("_kind = 1 and _t < _a.end").select("_row.*", "_a.t")


def sync_scan_imu(scans: DataFrame, imu: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Samples with the scan in whose interval (end of the one before, own end] they lie, for scans that later samples complete.

    Scans have t (start) and end; an interval join by stretches of time.
    """
    last = imu.groupBy(*keys).agg(F.max("t").alias("_last"))
    both = _merged(imu, scans, keys, "t", "end", F.struct("scan_id", "end"), kinds=(0, 1))
    found = _beside(both, keys, "_value").where("_kind = 0 and _b is not null")
    found = (found.join(_small(last), list(keys)) if keys else found.crossJoin(F.broadcast(last))).where("_last >= _b.end")
    return found.select("_row.*", F.col("_b.scan_id").alias("scan_id"), F.col("_b.end").alias("scan_end"))


def resample(rows: DataFrame, rate: float, value: str = "w", keys: Sequence[str] = ("session",)) -> DataFrame:
    """Values on a grid of rate a second from the first time, linear between the samples around: k, t and value.

    Each sample yields the grid places up to its successor, so the grid is never built apart and joined.
    """
    mean = rows.groupBy(*keys, "t").agg(F.avg(value).alias("_v"))
    first = _small(rows.groupBy(*keys).agg(F.min("t").alias("_t0")))
    series = Series(mean, keys, "t")
    pairs = series.lead(series.rows, _t1=F.col("t"), _v1=F.col("_v"))
    pairs = pairs.join(first, list(keys)) if keys else pairs.crossJoin(F.broadcast(first))
    low = F.ceil(F.round((F.col("t") - F.col("_t0")) * rate, 6)).cast("long")
    high = F.ceil(F.round((F.col("_t1") - F.col("_t0")) * rate, 6)).cast("long") - 1
    grid = pairs.where(F.col("_t1").isNotNull() & (low <= high)).withColumn("k", F.explode(F.sequence(low, high)))
    at = F.col("_t0") + F.col("k") / rate
    return grid.select(*keys, "k", at.alias("t"), (F.col("_v") + (F.col("_v1") - F.col("_v")) * (at - F.col("t")) / (F.col("_t1") - F.col("t"))).alias("value"))


def deskew(scan: DataFrame, imu_poses: DataFrame, keys: Sequence[str] = ("scan_id",), clamp: float = 0.5) -> DataFrame:
    """Points in the frame of their scan's end, by the last pose at or before each point; shifts are clamped to half a metre.

    Poses are relative to the scan's end: t, px, py, pz, qx, qy, qz, qw.
    """
    pose = F.struct("px", "py", "pz", "qx", "qy", "qz", "qw")
    row = F.struct(*scan.columns)
    both = scan.select(*keys, F.col("rel_ms").alias("_t"), F.lit(1).alias("_kind"), row.alias("_row"), F.lit(None).cast(imu_poses.select(pose.alias("p")).schema["p"].dataType).alias("_p"))
    both = both.unionByName(imu_poses.select(*keys, F.col("t").alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), pose.alias("_p")))
    found = both.withColumn("_q", F.last("_p", True).over(_by(keys, "_t", "_kind").rowsBetween(Window.unboundedPreceding, 0))).where("_kind = 1").select("_row.*", "_q")
    q = geo.quaternion(*[F.coalesce(F.col(f"_q.q{c}"), F.lit(1.0 if c == "w" else 0.0)) for c in "xyzw"])
    shift = [F.greatest(F.lit(-clamp), F.least(F.lit(clamp), F.coalesce(F.col(f"_q.p{c}"), F.lit(0.0)))) for c in "xyz"]
    turned = found.withColumn("_r", q)
    x, y, z = geo.quat_rotate(F.col("_r"), "x", "y", "z")
    return turned.withColumns({"x": x + shift[0], "y": y + shift[1], "z": z + shift[2]}).drop("_q", "_r")


def imu_init(imu: DataFrame, n: int = 20, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Mean gyro and accelerometer values of the first n samples, and the gravity they show.

    Of each task's rows only the first n of a series are shuffled.
    """
    first = imu.withColumn("_k", F.row_number().over(_by(keys, "t"))).where(F.col("_k") <= n)
    out = first.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("wx", "wy", "wz", "ax", "ay", "az")], F.count("*").alias("n"))
    return out.withColumn("gravity", F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2 + F.col("az") ** 2))


def apply_correction(points: DataFrame, ranges: DataFrame, nodes: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Points moved by the world correction interpolated between nodes at their scan's time; before the first node xyz are null.

    Nodes carry t and the correction's px..qw.
    """
    scans = ranges.select(*keys, "t", "point_start", "point_count")
    moved = asof_interpolate(scans, nodes, "clip", keys)
    first = nodes.groupBy(*keys).agg(F.min("t").alias("_first"))
    held = moved.join(first, list(keys), "left")
    placed = points_with_scan(points, ranges, keys).join(held.drop("point_start", "point_count", "alpha", "valid"), [*keys, "t"])
    q = geo.quaternion("qx", "qy", "qz", "qw")
    x, y, z = geo.quat_rotate(F.col("_q"), "x", "y", "z")
    late = F.col("t") >= F.col("_first")
    new = {"x": F.when(late, x + F.col("px")), "y": F.when(late, y + F.col("py")), "z": F.when(late, z + F.col("pz"))}
    return placed.withColumn("_q", q).withColumns(new).select(*points.columns, "t")


def pair_frames(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both cameras' frames by name: status both, left or right. Sets are equal where all are both."""
    both = a.select("name", F.lit(1).alias("_a")).join(b.select("name", F.lit(1).alias("_b")), "name", "full_outer")
    return both.select("name", F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise("both").alias("status"))


def separated_peaks(scores: DataFrame, separation: float, n: int, keys: Sequence[str] = (), at: str = "lag", score: str = "score") -> DataFrame:
    """The n best scores of each group no two of which are closer than the separation; candidates come after aggregation and are few."""
    import pandas as pd

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score, at], ascending=[False, True])
        kept: list[int] = []
        for k, place in zip(rows.index, rows[at], strict=True):
            if all(abs(place - rows.at[j, at]) >= separation for j in kept):
                kept.append(k)
            if len(kept) == n:
                break
        return rows.loc[kept].assign(rank=range(1, len(kept) + 1))

    by = list(keys) or [F.lit(0).alias("_all")]
    return scores.groupBy(*by).applyInPandas(choose, T.StructType([*scores.schema.fields, T.StructField("rank", T.LongType())]))
