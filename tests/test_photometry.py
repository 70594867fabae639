"""Photometric fits with planted gains, falloff and grids."""

import numpy as np

from scanloom.operators import vision

NAMES = "point_id long, frame_id long, obs long, lens_id long, radius double, u double, v double, weight double, r double, g double, b double"


def _encode(linear):
    linear = np.clip(linear, 0, 1)
    return np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * linear ** (1 / 2.4) - 0.055)


def test_gains_and_falloff_are_recovered(spark):
    r = np.random.default_rng(0)
    gain = r.uniform(-0.25, 0.25, (9, 3))
    k = np.array([[-0.25, 0.08, -0.05], [-0.1, -0.12, 0.03]])
    rows, groups = [], [range(0, 5), range(5, 8)]  # two components; frame 8 has too few observations
    for point in range(500):
        frames = list(groups[point % 2])
        base = r.uniform(0.1, 0.4, 3)
        chosen = r.choice(frames, 3, False).tolist() + ([8] if point in (0, 2, 4) else [])
        for f in chosen:
            lens, radius = f % 2, r.uniform(0, 1)
            light = base * np.exp(gain[f] + sum(k[lens, p] * radius ** (2 * p + 2) for p in range(3)) + r.normal(0, 0.002, 3))
            if r.random() < 0.02:
                light = light * 1.8  # what the Huber weights are for
            rows.append((point, f, len(rows), lens, radius, radius, 0.5, 1.0, *map(float, _encode(light))))
    gains, lenses = vision.fit_gains(spark.createDataFrame(rows, NAMES).repartition(3), stiff=0.05)
    found = {g["frame_id"]: g for g in gains.collect()}
    have = np.array([[found[f][f"gain_{c}"] for c in "rgb"] for f in range(9)])
    for own in groups:
        want = gain[list(own)] - np.median(gain[list(own)], axis=0)
        assert np.abs(have[list(own)] - want).max() < 0.02
    assert (have[8] == 0).all() and found[8]["support"] == 3
    assert len({found[f]["component"] for f in (0, 1, 2, 3, 4, 8)}) == 1 and found[5]["component"] != found[0]["component"]
    at = np.linspace(0, 1, 21)
    for lens in lenses.collect():
        curve = sum(lens[f"k{p}"] * at ** (2 * p) for p in (1, 2, 3))
        want = sum(k[lens["lens_id"], p] * at ** (2 * p + 2) for p in range(3))
        assert np.abs(curve - want).max() < 0.03
    plain, none = vision.fit_gains(spark.createDataFrame(rows, NAMES), vignette=False)
    assert none.count() == 0 and plain.count() == 9


def test_grids_equal_a_dense_fit(spark):
    """Against rows of a dense least-squares system, and the shape of a planted grid by lens."""
    r = np.random.default_rng(1)
    rows = []
    for point in range(900):
        base = r.uniform(0.05, 0.6, 3)
        for f in range(2):
            u, v = r.uniform(0, 1, 2)
            light = base * np.exp((0.2 if f else -0.2) * (u - 0.5))
            rows.append((point, f, len(rows), f, float(u), float(u), float(v), float(r.uniform(0.01, 1)), *map(float, _encode(light))))
    got = {g["lens_id"]: np.array(g["grid"]).reshape(4, 3, 3, 3) for g in vision.fit_grids(spark.createDataFrame(rows, NAMES).repartition(3)).collect()}
    for lens in (0, 1):
        slope = got[lens][:, :, 2].mean() - got[lens][:, :, 0].mean()
        assert np.sign(slope) == (-1 if lens else 1) and 0.05 < abs(slope) < 0.45
    light = np.array([x[8:11] for x in rows])
    light = np.where(light <= 0.04045, light / 12.92, ((light + 0.055) / 1.055) ** 2.4)
    for lens in (0, 1):
        own = [k for k, x in enumerate(rows) if x[3] == lens]
        target = light[[k + 1 if lens == 0 else k - 1 for k in own]]
        design, y, w = np.zeros((len(own), 36)), np.log(target) - np.log(light[own]), np.array([max(rows[k][7], 0.02) for k in own])
        for n, k in enumerate(own):
            place = np.array([rows[k][5] * 2, rows[k][6] * 2, light[k] @ [0.2126, 0.7152, 0.0722] * 3])
            low = np.minimum(np.floor(place), [1, 1, 2]).astype(int)
            for c in range(8):
                up = np.array([c & 1, c >> 1 & 1, c >> 2])
                part = np.where(up, place - low, 1 - (place - low)).prod()
                x, z, l = low + up
                design[n, (l * 3 + z) * 3 + x] += part
        smooth = []
        for l in range(4):
            for z in range(3):
                for x in range(3):
                    for step in ((1, 0, 0), (0, 1, 0), (0, 0, 1)):
                        to = (l + step[0], z + step[1], x + step[2])
                        if to[0] < 4 and to[1] < 3 and to[2] < 3:
                            line = np.zeros(36)
                            line[(l * 3 + z) * 3 + x], line[(to[0] * 3 + to[1]) * 3 + to[2]] = 2.0, -2.0
                            smooth.append(line)
        full = np.vstack([design * np.sqrt(w)[:, None], smooth, 0.15 * np.eye(36), np.full((1, 36), 16 / 36)])
        want = np.linalg.lstsq(full, np.vstack([y * np.sqrt(w)[:, None], np.zeros((len(full) - len(own), 3))]), rcond=None)[0]
        want -= (design @ want).mean(0)
        assert np.allclose(got[lens].reshape(36, 3), want, atol=1e-6)


def test_a_round_of_gains_reads_the_pairs_once(spark, monkeypatch):
    """The sums of a round are made once for both sides of its system, not once for each side that asks for them."""
    r = np.random.default_rng(2)
    rows = [(p, f, 4 * p + f, f % 2, float(x), float(x), 0.5, 1.0, *map(float, r.uniform(0.2, 0.8, 3))) for p in range(40) for f, x in enumerate(r.uniform(0, 1, 4))]
    own, plans = vision.conjugate_gradient, []
    monkeypatch.setattr(vision, "conjugate_gradient", lambda entries, right: plans.append(right._jdf.queryExecution().analyzed().toString()) or own(entries, right))
    gains, _ = vision.fit_gains(spark.createDataFrame(rows, NAMES), rounds=2, support=1)
    assert gains.count() == 4 and len(plans) == 4 and not any("Aggregate" in p for p in plans)
