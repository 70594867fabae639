"""Images and models: tracks, masks, projection, visibility, consensus colours and photometric fits."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import color
from scanloom.operators.lineage import checkpoint, stored
from scanloom.operators.quantiles import grouped_percentiles
from scanloom.operators.series import small
from scanloom.operators.solve import conjugate_gradient

# Tracks and features


def track_observations(tracks: DataFrame, features: DataFrame) -> DataFrame:
    """Track elements whose image feature points back to the same point."""
    f = features.select("image_id", "idx", "u", "v", F.col("point_id").alias("_back"))
    return tracks.join(f, ["image_id", "idx"]).where(F.col("_back") == F.col("point_id")).drop("_back")


def reliable_tracks(tracks: DataFrame, least: int = 3, error: float = 1.5) -> DataFrame:
    """Points seen at least so often with a finite error within the bound."""
    ok = F.col("error").isNotNull() & ~F.isnan("error") & (F.col("error") <= error)
    return tracks.where(ok).groupBy("point_id").agg(F.count("*").alias("n"), F.max("error").alias("error")).where(F.col("n") >= least)


def prune_model(tracks: DataFrame, features: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tracks kept to the given images and reciprocal features; features whose point has gone lose their link."""
    kept = track_observations(tracks.join(images.select("image_id"), "image_id", "left_semi"), features).select(*tracks.columns)
    alive = kept.select("image_id", "idx", F.lit(1).alias("_alive")).distinct()
    own = features.join(images.select("image_id"), "image_id", "left_semi").join(alive, ["image_id", "idx"], "left")
    return kept, own.withColumn("point_id", F.when(F.col("_alive").isNotNull(), F.col("point_id"))).drop("_alive")


def clear_observations(features: DataFrame) -> DataFrame:
    return features.withColumn("point_id", F.lit(None).cast("long"))


def nest_tracks(tracks: DataFrame) -> DataFrame:
    """One row a point with its sorted track array."""
    return tracks.groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct("image_id", "idx"))).alias("track"))


def filter_nested(nested: DataFrame, images: Sequence[int]) -> DataFrame:
    """Track arrays kept to some images; points without any go. The list of images is small (a model's)."""
    kept = F.filter("track", lambda s: s["image_id"].isin(*images))
    return nested.withColumn("track", kept).where(F.size("track") > 0)


def merge_bundles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Images of both models; ids of the second follow the largest of the first."""
    top = a.agg(F.coalesce(F.max("image_id"), F.lit(-1)).alias("_top"))
    return a.unionByName(b.crossJoin(F.broadcast(top)).withColumn("image_id", F.col("_top") + 1 + F.col("image_id")).drop("_top"))


def dedupe_poses(views: DataFrame) -> DataFrame:
    """The first view (least id) of each normalised name."""
    name = F.lower(F.replace("name", F.lit("\\"), F.lit("/")))
    first = F.row_number().over(Window.partitionBy(name).orderBy("image_id"))
    return views.withColumn("_k", first).where("_k = 1").drop("_k")


def dominant_camera(views: DataFrame, least: int = 3, share: float = 0.8) -> DataFrame:
    """The most frequent camera id of each folder, and whether enough of its views have it."""
    folder = F.element_at(F.split("name", "/"), 1)
    counts = views.groupBy(folder.alias("folder"), "camera_id").agg(F.count("*").alias("n"))
    out = counts.groupBy("folder").agg(F.max_by("camera_id", F.struct("n", -F.col("camera_id"))).alias("camera_id"), F.max("n").alias("n"), F.sum("n").alias("views"))
    return out.withColumn("accepted", (F.col("views") >= least) & (F.col("n") >= share * F.col("views")))


def coverage_gate(selected: DataFrame, registered: DataFrame, good: float = 0.6, fair: float = 0.35, least: int = 20) -> DataFrame:
    """Share of each camera's selected frames that were registered, and its class."""
    a = selected.groupBy("camera").agg(F.count("*").alias("selected"))
    b = registered.groupBy("camera").agg(F.count("*").alias("registered"))
    out = a.join(b, "camera", "left").withColumn("registered", F.coalesce("registered", F.lit(0))).withColumn("coverage", F.col("registered") / F.col("selected"))
    return out.withColumn("status", F.when(F.col("registered") < least, "too_few").when(F.col("coverage") >= good, "good").when(F.col("coverage") >= fair, "fair").otherwise("poor"))


def stage_medians(history: DataFrame, last: int = 5) -> DataFrame:
    """Median seconds of the last runs of each stage; history: run, stage, seconds."""
    k = F.row_number().over(Window.partitionBy("stage").orderBy(F.desc("run")))
    return history.withColumn("_k", k).where(F.col("_k") <= last).groupBy("stage").agg(F.median("seconds").alias("seconds"), F.count("*").alias("n"))


# Masks


def keep_samples(samples: DataFrame, mask: DataFrame) -> DataFrame:
    """Samples all four of whose taps are kept; mask: image, x, y, keep (1 or 0). Taps without a pixel are not kept."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    taps = samples.withColumn("_s", F.explode(steps)).withColumns({"x": F.floor("u").cast("long") + F.col("_s.i"), "y": F.floor("v").cast("long") + F.col("_s.j")})
    held = taps.join(mask.select("image", "x", "y", "keep"), ["image", "x", "y"], "left")
    return held.groupBy("sample").agg(F.bool_and(F.coalesce(F.col("keep") == 1, F.lit(False))).alias("keep"))


def mask_iou(a: DataFrame, b: DataFrame) -> DataFrame:
    """Agreement of removed pixels by image and overall (pixel-weighted); two empty masks agree fully. A pixel without a row is kept."""
    both = a.select("image", "x", "y", (1 - F.col("keep")).alias("_a")).join(b.select("image", "x", "y", (1 - F.col("keep")).alias("_b")), ["image", "x", "y"], "full_outer")
    x, y = F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0))
    out = both.rollup("image").agg(F.sum(x * y).alias("both"), F.sum(F.greatest(x, y)).alias("either"), F.avg((x == y).cast("double")).alias("agreement"))
    return out.withColumn("iou", F.when(F.col("either") > 0, F.col("both") / F.col("either")).otherwise(1.0))


def compare_masks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Images that one side lacks; callers reject a result that isn't empty before comparing."""
    left, right = a.select("image").distinct().withColumn("_a", F.lit(1)), b.select("image").distinct().withColumn("_b", F.lit(1))
    return left.join(right, "image", "full_outer").where("_a is null or _b is null").select("image", F.when(F.col("_b").isNull(), "right").otherwise("left").alias("missing"))


def excluded_percent(masks: DataFrame) -> DataFrame:
    return masks.groupBy("image").agg((100 * F.avg(1 - F.col("keep"))).alias("excluded"))


def fixed_keep(u: Column, v: Column, width: float, height: float, radius: float, rectangles: Sequence[tuple] = (), ellipses: Sequence[tuple] = (), polygons: Sequence[Sequence[tuple]] = ()) -> Column:
    """Whether a pixel lies inside the border circle and outside all shapes (in shares of the image: x0 y0 x1 y1; cx cy rx ry; corners)."""
    x, y = u / width, v / height
    keep = F.pow(u - width / 2, 2) + F.pow(v - height / 2, 2) <= radius * radius
    for x0, y0, x1, y1 in rectangles:
        keep = keep & ~(x.between(x0, x1) & y.between(y0, y1))
    for cx, cy, rx, ry in ellipses:
        keep = keep & (F.pow((x - cx) / rx, 2) + F.pow((y - cy) / ry, 2) > 1)
    for corners in polygons:
        crossings = F.lit(0)
        for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]], strict=True):
            if ay != by:
                hit = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
                crossings = crossings + hit.cast("int")
        keep = keep & (crossings % 2 == 0)
    return keep


def border_radius(cameras: DataFrame, percent: float = 2.0) -> DataFrame:
    """The radius whose circle leaves so many hundredths of each camera's pixels outside, from its pixel grid."""
    grid = cameras.withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    far = F.sqrt(F.pow(F.col("_x") + 0.5 - F.col("width") / 2, 2) + F.pow(F.col("_y") + 0.5 - F.col("height") / 2, 2))
    return grouped_percentiles(grid, ["camera"], {"radius": (far, 1 - percent / 100)})


def sample_gate(taps: Column) -> Column:
    """Taps neither dark, bright nor uneven."""
    return (F.array_min(taps) > 12) & (F.array_max(taps) < 243) & (F.array_max(taps) - F.array_min(taps) < 45)


# Projection, visibility, consensus


def project_views(points: DataFrame, views: DataFrame, project: Callable, reach: float, width: float, height: float) -> DataFrame:
    """Points in front of and inside each view within reach: view, point, u, v, depth. Views (a model's, small) come by grid cells.

    Both sides are dealt to cells of the reach's size, so that a view meets only points near it.
    """
    from scanloom.operators.spatial import radius_join

    v = views.select("image_id", "yaw", "camera_id", "name", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    near = radius_join(v, points, reach)
    dx, dy, dz = (F.col(f"{c}_b") - F.col(c) for c in "xyz")
    right, forward = F.cos("yaw") * dx + F.sin("yaw") * dy, -F.sin("yaw") * dx + F.cos("yaw") * dy
    cam = near.withColumns({"_r": right, "_d": -dz, "_f": forward}).where(F.col("_f") > 0.05)
    pu, pv, depth = project(F.col("_r"), F.col("_d"), F.col("_f"))
    out = cam.withColumns({"u": pu, "v": pv, "depth": depth}).where(F.col("u").between(0, width - 1) & F.col("v").between(0, height - 1))
    return out.select("image_id", "name", F.col("point_id_b").alias("point_id"), "u", "v", "depth", *[F.col(f"{c}_b").alias(c) for c in "rgb" if f"{c}_b" in near.columns])


def visible(projected: DataFrame, width: float, height: float, zw: int, zh: int) -> DataFrame:
    """Rows that the z-buffer doesn't hide: depth floors to millimetres, and the least of the nine cells about a point counts."""
    cells = projected.withColumns({"_c": F.floor(F.col("u") * zw / width).cast("long"), "_r": F.floor(F.col("v") * zh / height).cast("long")})
    least = cells.groupBy("image_id", "_c", "_r").agg(F.min(F.floor(F.col("depth") * 1000).cast("long")).alias("_mm"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = least.withColumn("_s", F.explode(steps)).groupBy("image_id", (F.col("_c") + F.col("_s.i")).alias("_c"), (F.col("_r") + F.col("_s.j")).alias("_r")).agg(F.min("_mm").alias("_near"))
    near = F.col("_near") / 1000
    held = cells.join(spread, ["image_id", "_c", "_r"])
    return held.where(F.col("depth") <= near + F.greatest(F.lit(0.03), 0.01 * near)).drop("_c", "_r", "_near")


def top3(scored: DataFrame) -> DataFrame:
    """The three best views of each point by score; ties go to the earlier name."""
    k = F.row_number().over(Window.partitionBy("point_id").orderBy(F.desc("score"), "name"))
    return scored.withColumn("k", k).where("k <= 3")


def consensus(best: DataFrame, threshold: float = 45.0) -> DataFrame:
    """One colour a point from its best views: one as it is; two averaged by score unless they differ; three by those near the median."""
    one = F.struct("k", "score", "r", "g", "b")
    rows = best.groupBy("point_id").agg(F.array_sort(F.collect_list(one)).alias("v"), F.count("*").alias("n"))
    v = lambda k: F.get("v", F.lit(k))
    gap = lambda a, b: F.sqrt(sum((F.pow(a[c] - b[c], 2) for c in "rgb"), F.lit(0.0)))
    mid = {c: F.element_at(F.array_sort(F.transform("v", _channel(c))), 2) for c in "rgb"}
    rows = rows.withColumn("m", F.when(F.col("n") == 3, F.struct(*[m.alias(c) for c, m in mid.items()])))
    near = F.filter("v", lambda x: gap(x, F.col("m")) < threshold)
    used = F.when(F.col("n") == 1, F.col("v")).when((F.col("n") == 2) & (gap(v(0), v(1)) < threshold), F.col("v")).when(F.col("n") == 2, F.slice("v", 1, 1))
    rows = rows.withColumn("w", used.otherwise(F.when(F.size(near) > 0, near).otherwise(F.slice("v", 1, 1))))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x["score"])
    mean = lambda c: F.aggregate("w", F.lit(0.0), lambda a, x: a + x["score"] * x[c]) / total
    return rows.select("point_id", "n", *[mean(c).alias(c) for c in "rgb"])


def _channel(c: str) -> Callable[[Column], Column]:
    return lambda x: x[c]


def coverage(points: DataFrame, best: DataFrame) -> DataFrame:
    """Percentage of points that some view sees; the others stay grey."""
    seen = best.select("point_id").distinct().withColumn("_s", F.lit(1))
    return points.select("point_id").join(seen, "point_id", "left").agg(F.count("*").alias("n"), (100 * F.avg(F.coalesce("_s", F.lit(0)))).alias("coverage"))


def vote_remove(projected: DataFrame, mask: DataFrame, planar: DataFrame | None = None) -> DataFrame:
    """Points that at least two views put on a masked object, and most of those that see them; planar points are kept.

    mask: image_id, x, y, keep. Where every point would go, none does.
    """
    at = projected.withColumns({"x": F.floor("u").cast("long"), "y": F.floor("v").cast("long")}).select("point_id", "image_id", "x", "y")
    votes = at.join(mask.select("image_id", "x", "y", "keep"), ["image_id", "x", "y"]).groupBy("point_id").agg(F.count("*").alias("seen"), F.count_if(F.col("keep") == 0).alias("on"))
    out = votes.withColumn("remove", (F.col("on") >= 2) & (2 * F.col("on") > F.col("seen")))
    if planar is not None:
        out = out.join(planar.select("point_id", F.lit(1).alias("_p")), "point_id", "left").withColumn("remove", F.col("remove") & F.col("_p").isNull()).drop("_p")
    every = out.agg(F.bool_and("remove").alias("_all"))
    return out.crossJoin(F.broadcast(every)).withColumn("remove", F.col("remove") & ~F.col("_all")).drop("_all")


# Photometric fits


def loo_targets(obs: DataFrame) -> DataFrame:
    """Weighted mean of the point's other observations, channel by channel; null where there is none."""
    w = Window.partitionBy("point_id")
    rest = F.sum("weight").over(w) - F.col("weight")
    mean = lambda c: F.when(rest > 1e-12, (F.sum(F.col("weight") * F.col(c)).over(w) - F.col("weight") * F.col(c)) / rest)
    return obs.withColumns({f"target_{c}": mean(c) for c in "rgb"})


def split_points(obs: DataFrame, key: str = "point_id") -> DataFrame:
    """train, validation or test (60, 20, 20) by point, so that no point is in two."""
    bucket = F.pmod(F.pmod(F.col(key) * 48271 + 17, F.lit(2147483647)) * 69621, F.lit(2147483647)) % 5
    return obs.withColumn("split", F.when(bucket < 3, "train").when(bucket == 3, "validation").otherwise("test"))


def sample_tracks(tracks: DataFrame, points: DataFrame, n: int, per_point: int) -> DataFrame:
    """Up to n points, one a cell first, each with evenly spaced elements of its track, ends included."""
    from scanloom.operators.clouds import first_per_cell, mixed

    spread = first_per_cell(points, 2.0).select("point_id")
    chosen = tracks.select("point_id").distinct().join(spread, "point_id", "left_semi").orderBy(mixed("point_id", 3), "point_id").limit(n)
    w = Window.partitionBy("point_id")
    ranked = tracks.join(chosen, "point_id", "left_semi").withColumns({"_k": F.row_number().over(w.orderBy("image_id", "idx")) - 1, "_n": F.count("*").over(w)})
    take = F.least(F.lit(per_point), F.col("_n"))
    k = F.ceil(F.col("_k") * (take - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    hit = F.when(take == 1, F.col("_k") == 0).otherwise((k < take) & (F.floor(k * (F.col("_n") - 1) / (take - 1)) == F.col("_k")))
    return ranked.where(hit).drop("_k", "_n")


def _powers(radius: str) -> list[Column]:
    square = F.col(radius) * F.col(radius)
    return [square, square * square, square * square * square]


def _falloff(lens: str, radius: str) -> Column:
    """Log falloff at a radius, of the numbers in columns lens1, lens2 and lens3."""
    return sum((F.coalesce(F.col(f"{lens}{p}"), F.lit(0.0)) * v for p, v in enumerate(_powers(radius), 1)), F.lit(0.0))


def _fit_falloff(pairs: DataFrame, rounds: int, cut: float, ridge: float, stiff: float) -> DataFrame:
    """k1, k2, k3 of each lens: log falloff by even powers of the radius, fitted with one gain a frame to the mean of the channels.

    A round sums the products of the pairs' six powers by frames and lenses, in one pass, so that the rows which unknowns are
    told apart in are as few as pairs of frames.
    """
    powers = [*_powers("ri"), *[-v for v in _powers("rj")]]
    product = [(m, n) for m in range(6) for n in range(m, 6)]
    frames = lenses = None
    for _ in range(rounds):
        now = pairs.withColumn("_h", F.col("w"))
        if frames is not None:
            for end in "ij":
                now = now.join(small(frames.select(F.col("frame_id").alias(end), F.col("x").alias(f"x{end}"))), end, "left")
                now = now.join(small(lenses.select(F.col("lens_id").alias(f"l{end}"), *[F.col(f"k{p}").alias(f"{end}k{p}") for p in (1, 2, 3)])), f"l{end}", "left")
            miss = F.coalesce("xi", F.lit(0.0)) - F.coalesce("xj", F.lit(0.0)) + _falloff("ik", "ri") - _falloff("jk", "rj") - F.col("y")
            now = now.withColumn("_h", F.col("w") * F.least(F.lit(1.0), cut / F.greatest(F.abs(miss), F.lit(1e-8))))
        h = F.col("_h")
        groups = now.groupBy("i", "j", "li", "lj")
        sums = checkpoint(groups.agg(F.sum(h).alias("s"), F.sum(h * F.col("y")).alias("sy"), *[F.sum(h * v).alias(f"s{m}") for m, v in enumerate(powers)], *[F.sum(h * v * F.col("y")).alias(f"y{m}") for m, v in enumerate(powers)], *[F.sum(h * powers[m] * powers[n]).alias(f"p{m}{n}") for m, n in product]))
        frame, lens = (lambda c: F.concat(F.lit("f"), F.col(c))), (lambda m: F.concat(F.lit(f"k{m % 3 + 1}_"), F.col("li" if m < 3 else "lj")))
        terms = [(frame("i"), None, 1.0), (frame("j"), None, -1.0), *[(lens(m), m, 1.0) for m in range(6)]]

        def cell(one: tuple, other: tuple) -> Column:
            (_, m, a), (_, n, b) = one, other
            value = "s" if m is None and n is None else f"s{n if m is None else m}" if m is None or n is None else f"p{min(m, n)}{max(m, n)}"
            return F.struct(one[0].alias("i"), other[0].alias("j"), (F.col(value) * (a * b)).alias("a"))

        entries = sums.select(F.explode(F.array(*[cell(one, other) for one in terms for other in terms])).alias("c")).select("c.*")
        right = sums.select(F.explode(F.array(*[F.struct(name.alias("i"), (F.col("sy" if m is None else f"y{m}") * sign).alias("b")) for name, m, sign in terms])).alias("c")).select("c.*")
        stay = F.when(F.col("i").startswith("f"), ridge**2).otherwise(stiff**2)
        entries = entries.unionByName(entries.select("i").distinct().select("i", F.col("i").alias("j"), stay.alias("a")))
        x = conjugate_gradient(entries, right)
        kind = dict(pairs.dtypes)
        frames = checkpoint(x.where(F.col("i").startswith("f")).select(F.substring("i", 2, 99).cast(kind["i"]).alias("frame_id"), "x"))
        named = x.where(F.col("i").startswith("k")).select(F.substring_index(F.substring("i", 2, 99), "_", 1).alias("p"), F.expr("substring(i, instr(i, '_') + 1)").cast(kind["li"]).alias("lens_id"), "x")
        lenses = checkpoint(named.groupBy("lens_id").agg(*[F.max(F.when(F.col("p") == str(p), F.col("x"))).alias(f"k{p}") for p in (1, 2, 3)]))
    return lenses.select("lens_id", *[F.greatest(F.lit(-0.5), F.least(F.lit(0.5), f"k{p}")).alias(f"k{p}") for p in (1, 2, 3)])


def fit_gains(obs: DataFrame, ridge: float = 0.03, rounds: int = 4, support: int = 12, limit: float = color.LIMIT, vignette: bool = True, cut: float = 0.08, stiff: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(frame_id, gain_r, gain_g, gain_b, support, component) and (lens_id, k1, k2, k3), in logs of linear light.

    From cyclic pairs of each point's observations: the lenses' falloff first, from the mean of the channels, then the gains
    of each frame and channel; ridge and Huber weights. Frames that pairs connect are one component, whose median gain is 0
    in each channel; frames with less support than the bound have no gain. All systems are sparse: sums by pairs of frames.
    """
    from scanloom.operators.registration import components
    from scanloom.operators.tracks import cyclic_pairs

    rows = obs.select("point_id", "frame_id", "obs", "lens_id", "radius", "weight", *[F.log(F.greatest(color.to_linear(c), F.lit(1e-5))).alias(f"l{c}") for c in "rgb"])
    both = cyclic_pairs(rows)
    ends = [F.col(f"{at}.{c}").alias(f"{n}{end}") for at, end in (("a", "i"), ("b", "j")) for c, n in (("frame_id", ""), ("lens_id", "l"), ("radius", "r"))]
    pairs = both.select(*ends, F.least("a.weight", "b.weight").alias("w"), *[(F.col(f"a.l{c}") - F.col(f"b.l{c}")).alias(f"y{c}") for c in "rgb"])
    pairs = stored(pairs.withColumn("y", (F.col("yr") + F.col("yg") + F.col("yb")) / 3))
    spark = obs.sparkSession
    if vignette:
        lenses = checkpoint(_fit_falloff(pairs.select("i", "j", "li", "lj", "ri", "rj", "w", "y"), rounds, cut, ridge, stiff))
    else:
        lenses = spark.createDataFrame([], f"lens_id {dict(obs.dtypes)['lens_id']}, k1 double, k2 double, k3 double")
    for end in "ij":
        pairs = pairs.join(small(lenses.select(F.col("lens_id").alias(f"l{end}"), *[F.col(f"k{p}").alias(f"{end}k{p}") for p in (1, 2, 3)])), f"l{end}", "left")
    off = _falloff("ik", "ri") - _falloff("jk", "rj")
    pairs = stored(pairs.where("i <> j").select("i", "j", "w", *[(F.col(f"y{c}") - off).alias(f"y{c}") for c in "rgb"]))
    gains = None
    for _ in range(rounds):
        now = pairs.withColumns({f"h{c}": F.col("w") for c in "rgb"})
        if gains is not None:
            for end in "ij":
                now = now.join(small(gains.select(F.col("frame_id").alias(end), *[F.col(c).alias(f"{end}{c}") for c in "rgb"])), end, "left")
            now = now.withColumns({f"h{c}": F.col("w") * F.least(F.lit(1.0), cut / F.greatest(F.abs(F.col(f"i{c}") - F.col(f"j{c}") - F.col(f"y{c}")), F.lit(1e-8))) for c in "rgb"})
        sums = checkpoint(now.groupBy("i", "j").agg(*[F.sum(f"h{c}").alias(f"h{c}") for c in "rgb"], *[F.sum(F.col(f"h{c}") * F.col(f"y{c}")).alias(f"y{c}") for c in "rgb"]))
        name = lambda c, end: F.struct(F.lit(c).alias("c"), F.col(end).alias("f"))
        cells = [F.struct(name(c, a).alias("i"), name(c, b).alias("j"), (F.col(f"h{c}") * (1.0 if a == b else -1.0)).alias("a")) for c in "rgb" for a in "ij" for b in "ij"]
        entries = sums.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
        right = sums.select(F.explode(F.array(*[F.struct(name(c, a).alias("i"), (F.col(f"y{c}") * sign).alias("b")) for c in "rgb" for a, sign in (("i", 1.0), ("j", -1.0))])).alias("c")).select("c.*")
        entries = entries.unionByName(entries.select("i").distinct().select("i", F.col("i").alias("j"), F.lit(ridge**2).alias("a")))
        x = conjugate_gradient(entries, right)
        gains = checkpoint(x.groupBy(F.col("i.f").alias("frame_id")).agg(*[F.max(F.when(F.col("i.c") == c, F.col("x"))).alias(c) for c in "rgb"]))
    held = obs.groupBy("frame_id").agg(F.count("*").alias("support")).join(gains, "frame_id", "left")
    joined = components(sums.select("i", "j")).select(F.col("id").alias("frame_id"), "component")
    held = checkpoint(held.join(joined, "frame_id", "left").withColumn("component", F.coalesce("component", "frame_id")))
    mid = held.where(F.col("support") >= support).groupBy("component").agg(*[F.median(c).alias(f"_{c}") for c in "rgb"])  # a row a frame
    out = held.join(mid, "component", "left")
    fixed = lambda c: F.when(F.col("support") >= support, F.greatest(F.lit(-limit), F.least(F.lit(limit), F.coalesce(F.col(c) - F.col(f"_{c}"), F.lit(0.0))))).otherwise(0.0)
    return out.select("frame_id", *[fixed(c).alias(f"gain_{c}") for c in "rgb"], "support", "component"), lenses


def fit_chroma(obs: DataFrame, ridge: float = 0.1, passes: int = 3) -> DataFrame:
    """Eight numbers of a chroma homography for each frame, towards the leave-one-out targets.

    Each pass sums the weighted normal equations in Spark, one row a frame, about the numbers that the last one found.
    """
    rows = loo_targets(obs).where("target_r is not null")
    chroma = lambda at, c: F.col(f"{at}{c}") / F.greatest(sum((F.col(f"{at}{k}") for k in "rgb"), F.lit(0.0)), F.lit(1e-6))
    rows = rows.select("frame_id", "weight", chroma("", "r").alias("u"), chroma("", "g").alias("v"), chroma("target_", "r").alias("p"), chroma("target_", "g").alias("q"))
    start = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0]
    # Numbers with a value of both equations of an observation: columns 0 to 2 or 3 to 5, and 6 and 7.
    sides = [(F.col(y), {low: F.col("u"), low + 1: F.col("v"), low + 2: F.lit(1.0), 6: -F.col("u") * F.col(y), 7: -F.col("v") * F.col(y)}) for y, low in (("p", 0), ("q", 3))]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for sums in batches:
            a, y = np.zeros((len(sums), 8, 8)), np.zeros((len(sums), 8))
            for i in range(8):
                y[:, i] = sums[f"y{i}"]
                for j in range(i, 8):
                    if f"a{i}{j}" in sums:
                        a[:, i, j] = a[:, j, i] = sums[f"a{i}{j}"]
            h = np.linalg.solve(a + ridge * np.eye(8), (y + ridge * np.array(start))[:, :, None])[:, :, 0]
            yield sums[["frame_id", "n"]].assign(h=list(h))

    h = None
    for _ in range(passes):
        now = rows.withColumn("h", F.array(*map(F.lit, start)))
        if h is not None:
            now = rows.join(F.broadcast(h.select(F.col("frame_id").alias("_f"), "h")), F.col("frame_id").eqNullSafe(F.col("_f")))
        terms: dict[str, Column] = {f"y{i}": F.lit(0.0) for i in range(8)}
        for k, (y, a) in enumerate(sides):
            miss = F.abs(sum((v * F.col("h")[i] for i, v in a.items()), F.lit(0.0)) - y)
            now = now.withColumn(f"w{k}", F.col("weight") * F.least(F.lit(1.0), 0.02 / F.greatest(miss, F.lit(1e-9))))
            for i, v in a.items():
                terms[f"y{i}"] = terms[f"y{i}"] + F.col(f"w{k}") * v * y
                for j, z in a.items():
                    if i <= j:
                        terms[f"a{i}{j}"] = terms.get(f"a{i}{j}", F.lit(0.0)) + F.col(f"w{k}") * v * z
        sums = now.groupBy("frame_id").agg(F.count("*").alias("n"), *[F.sum(v).alias(c) for c, v in terms.items()])
        h = sums.mapInPandas(solve, "frame_id long, n long, h array<double>")
    return h


def fit_grids(obs: DataFrame, smooth: float = 2.0, least: float = 0.15, anchor: float = 16.0) -> DataFrame:
    """For each lens a grid over the image (u and v from 0 to 1: 3 x 3) and luma (4) of log gains of the three channels: 108 numbers,
    by luma, then v, u and channel.

    Trilinear towards the leave-one-out targets in linear light, smooth, small, and of mean zero, first over the cells and then
    over the observations: exposure is the gains' matter. One aggregation by lens and inner cell (12 of them) of the products
    of its eight corners; a lens is solved from those rows. Obs: point_id, lens_id, weight, u, v, r, g, b.
    """
    shape = (3, 3, 4)  # u, v, luma
    rows = loo_targets(obs.withColumns({c: color.to_linear(c) for c in "rgb"})).where("target_r is not null and target_g is not null and target_b is not null")
    luma = sum((F.col(c) * k for c, k in (("r", 0.2126), ("g", 0.7152), ("b", 0.0722))), F.lit(0.0))
    base, parts = [], []
    for value, n in zip((F.col("u"), F.col("v"), luma), shape, strict=True):
        at = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * (n - 1)
        low = F.least(F.floor(at), F.lit(n - 2)).cast("int")
        base.append(low)
        parts.append(at - low)
    corner = []
    for k in range(8):
        weight = F.lit(1.0)
        for axis, part in enumerate(parts):
            weight = weight * (part if k >> axis & 1 else 1 - part)
        corner.append(weight)
    log = lambda c: F.log(F.greatest(c, F.lit(1e-5)))
    rows = rows.select("lens_id", F.greatest("weight", F.lit(0.02)).alias("w"), *[b.alias(f"b{k}") for k, b in enumerate(base)], *[c.alias(f"c{k}") for k, c in enumerate(corner)], *[(log(F.col(f"target_{c}")) - log(F.col(c))).alias(f"y{c}") for c in "rgb"])
    both = [(i, j) for i in range(8) for j in range(i, 8)]
    sums = rows.groupBy("lens_id", "b0", "b1", "b2").agg(
        F.count("*").alias("n"), *[F.sum(f"c{i}").alias(f"m{i}") for i in range(8)], *[F.sum(F.col("w") * F.col(f"c{i}") * F.col(f"c{j}")).alias(f"a{i}{j}") for i, j in both],
        *[F.sum(F.col("w") * F.col(f"c{i}") * F.col(f"y{c}")).alias(f"y{i}{c}") for i in range(8) for c in "rgb"],
    )
    size = shape[0] * shape[1] * shape[2]

    def solve(cells: pd.DataFrame) -> pd.DataFrame:
        a, y, mean = np.zeros((size, size)), np.zeros((size, 3)), np.zeros(size)
        for cell in cells.to_dict("records"):  # 12 at most
            place = [((cell["b2"] + (k >> 2)) * shape[1] + cell["b1"] + (k >> 1 & 1)) * shape[0] + cell["b0"] + (k & 1) for k in range(8)]
            for i, j in both:
                a[place[i], place[j]] += cell[f"a{i}{j}"]
                if i != j:
                    a[place[j], place[i]] += cell[f"a{i}{j}"]
            for i in range(8):
                y[place[i]] += [cell[f"y{i}{c}"] for c in "rgb"]
                mean[place[i]] += cell[f"m{i}"]
        grid = np.arange(size).reshape(shape[::-1])
        for axis in range(3):
            p, q = (np.take(grid, range(lo, lo + grid.shape[axis] - 1), axis).ravel() for lo in (0, 1))
            for x, z, s in ((p, p, 1), (q, q, 1), (p, q, -1), (q, p, -1)):
                np.add.at(a, (x, z), s * smooth**2)
        g = np.linalg.solve(a + least**2 * np.eye(size) + (anchor / size) ** 2, y)
        g -= mean @ g / cells["n"].sum()
        return pd.DataFrame({"lens_id": [cells["lens_id"].iloc[0]], "grid": [g.ravel().tolist()]})

    return sums.groupBy("lens_id").applyInPandas(solve, f"lens_id {dict(obs.dtypes)['lens_id']}, grid array<double>")


def pair_metrics(obs: DataFrame, models: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Error of linear channels and mean and 90th percentile colour difference to the targets, by split and model and their totals."""
    out = None
    for name, model in models.items():
        rows = loo_targets(split_points(model(obs))).where("target_r is not null").withColumn("model", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    lin = {c: color.to_linear(c) for c in (*"rgb", *[f"target_{c}" for c in "rgb"])}
    rows = out.withColumns({f"l_{k}": v for k, v in lin.items()})
    err = sum((F.pow(F.col(f"l_{c}") - F.col(f"l_target_{c}"), 2) for c in "rgb"), F.lit(0.0)) / 3
    de = color.delta_e76([F.col(f"l_{c}") for c in "rgb"], [F.col(f"l_target_{c}") for c in "rgb"])
    none = F.lit(None).cast("string")
    each = F.array(*[F.struct(s.alias("split"), m.alias("model")) for s in (F.col("split"), none) for m in (F.col("model"), none)])
    rows = checkpoint(rows.select("split", "model", err.alias("_e"), de.alias("_d")))
    base = rows.groupBy("split", "model").agg(F.count("*").alias("n"), F.sum("_e").alias("_e"), F.sum("_d").alias("_d"))  # totals come from a few rows
    sums = base.select(F.explode(each).alias("_g"), "n", "_e", "_d").groupBy("_g.split", "_g.model").agg(F.sum("n").alias("n"), F.sqrt(F.sum("_e") / F.sum("n")).alias("rmse"), (F.sum("_d") / F.sum("n")).alias("delta_e"))
    high = grouped_percentiles(rows.select(F.explode(each).alias("_g"), "_d").select("_g.*", "_d"), ["split", "model"], {"p90": (F.col("_d"), 0.9)})
    return sums.join(small(high), sums["split"].eqNullSafe(high["split"]) & sums["model"].eqNullSafe(high["model"])).select(sums["split"], sums["model"], "n", "rmse", "delta_e", "p90")
