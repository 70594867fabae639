"""Colour and photometry as column expressions; channels are in 0 to 1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanloom.functions.geometry import col


def to_linear(c) -> Column:
    c = col(c)
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def to_srgb(c) -> Column:
    c = col(c)
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)


LIMIT = 0.6931471805599453


def apply_gain(c, radius, coefficients: Sequence, limit: float = LIMIT) -> Column:
    """A linear channel times exp of gain and vignette (constant, r2, r4, r6), the log clipped at the limit."""
    r2 = col(radius) * col(radius)
    g0, g2, g4, g6 = (col(k) for k in coefficients)
    log = g0 + g2 * r2 + g4 * r2 * r2 + g6 * r2 * r2 * r2
    return col(c) * F.exp(F.greatest(F.lit(-limit), F.least(F.lit(limit), log)))


def chroma_h(r, g, b, h: Sequence) -> tuple[Column, Column, Column]:
    """A homography (eight numbers) of the chroma (r, g over the sum); the sum of the channels stays."""
    r, g, b = (col(c) for c in (r, g, b))
    total = F.greatest(r + g + b, F.lit(1e-6))
    u, v = r / total, g / total
    w = col(h[6]) * u + col(h[7]) * v + 1
    nu = (col(h[0]) * u + col(h[1]) * v + col(h[2])) / w
    nv = (col(h[3]) * u + col(h[4]) * v + col(h[5])) / w
    nu, nv = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) for c in (nu, nv))
    return nu * total, nv * total, F.greatest(F.lit(0.0), 1 - nu - nv) * total


def grid_gain(grid: Column, u, v, luma, shape: tuple[int, int, int] = (3, 3, 4), channels: int = 3) -> list[Column]:
    """Trilinear samples of a bilateral grid (array in luma, v, u, channel order) at u, v and luma in 0 to 1."""
    places = []
    for value, n in zip((u, v, luma), shape, strict=True):
        at = F.least(F.greatest(col(value), F.lit(0.0)), F.lit(1.0)) * (n - 1)
        low = F.least(F.floor(at), F.lit(n - 2)).cast("int")
        places.append((low, at - low))
    out = []
    for c in range(channels):
        total = F.lit(0.0)
        for corner in range(8):
            weight, index = F.lit(1.0), []
            for k, (low, part) in enumerate(places):
                up = corner >> k & 1
                weight = weight * (part if up else 1 - part)
                index.append(low + up)
            place = ((index[2] * shape[1] + index[1]) * shape[0] + index[0]) * channels + c
            total = total + weight * F.element_at(grid, place + 1)
        out.append(total)
    return out


def lab(r, g, b) -> tuple[Column, Column, Column]:
    """CIE Lab of linear channels under D65."""
    r, g, b = (col(c) for c in (r, g, b))
    x = (0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047
    y = 0.2126729 * r + 0.7151522 * g + 0.0721750 * b
    z = (0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883
    f = lambda t: F.when(t > 216 / 24389, F.pow(t, F.lit(1 / 3))).otherwise((24389 / 27 * t + 16) / 116)
    return 116 * f(y) - 16, 500 * (f(x) - f(y)), 200 * (f(y) - f(z))


def delta_e76(a: Sequence, b: Sequence) -> Column:
    p, q = lab(*a), lab(*b)
    return F.sqrt(sum(((i - j) * (i - j) for i, j in zip(p, q, strict=True)), F.lit(0.0)))


def bilinear(c00, c10, c01, c11, u, v) -> Column:
    """The value at the fractional place u, v between four taps."""
    du, dv = col(u) - F.floor(col(u)), col(v) - F.floor(col(v))
    return (col(c00) * (1 - du) + col(c10) * du) * (1 - dv) + (col(c01) * (1 - du) + col(c11) * du) * dv


def view_score(radius, widest: float, depth) -> Column:
    """Higher for views that see a point near their middle and close by."""
    share = col(radius) / widest
    return (1 - 0.5 * share * share) / F.pow(F.greatest(col(depth), F.lit(0.5)), F.lit(1.5))

#: Coefficients of the turbo map's channels, from the constant term up.
TURBO = (
    (0.13572138, 4.61539260, -42.66032258, 132.13108234, -152.94239396, 59.28637943),
    (0.09140261, 2.19418839, 4.84296658, -14.18503327, 4.27729857, 2.82956604),
    (0.10667330, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973),
)


def colormap(value, name: str = "turbo") -> tuple[Column, Column, Column]:
    """Channels 0 to 255 of a value in 0 to 1, at its 256 steps (the value times 255, cut to a whole number): turbo, heat, rainbow or grey."""
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    x = F.floor(clip(col(value)) * 255) / 255
    if name == "turbo":
        channels = []
        for k in TURBO:
            sum_ = F.lit(k[-1])
            for c in k[-2::-1]:
                sum_ = sum_ * x + c
            channels.append(sum_)
    else:
        channels = {"grey": [x] * 3, "heat": [x * 3 - k for k in range(3)], "rainbow": [1.5 - F.abs(x * 4 - k) for k in (3, 2, 1)]}[name]
    return tuple(clip(c) * 255 for c in channels)


def unpack_rgb(packed) -> tuple[Column, Column, Column]:
    """Channels 0 to 255 of an integer 0x00RRGGBB."""
    p = col(packed).cast("long")
    return F.shiftright(p, 16).bitwiseAND(255), F.shiftright(p, 8).bitwiseAND(255), p.bitwiseAND(255)


def pack_rgb(r, g, b) -> Column:
    return F.shiftleft(col(r).cast("int"), 16).bitwiseOR(F.shiftleft(col(g).cast("int"), 8)).bitwiseOR(col(b).cast("int"))
