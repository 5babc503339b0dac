"""Crop boxes, frame indices and sample times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-3
# Fractions of a clip that are sampled, and those tried when one fails.
SAMPLE_FRACTIONS = (0.0, 0.5, 1.0)
FALLBACK_FRACTIONS = (0.9, 0.1, 0.75, 0.25, 0.66, 0.33)


def crop_boxes(w: Column, h: Column, views: int = 5) -> Column:
    """Boxes (x0, y0, x1, y1) of 1 to 12 views: whole, four corners, centre, two bands, two closer corners; below 32 pixels the whole alone."""
    views = max(1, min(12, views))

    def part(size: Column, share: float) -> Column:
        return F.greatest(F.lit(24), F.floor(size * F.lit(share)).cast("int")).cast("int")

    def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        return F.struct(*(c.cast("int").alias(n) for c, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"))))

    zero = F.lit(0)
    cw, ch, cz = part(w, 0.88), part(h, 0.88), part(F.least(w, h), 0.72)
    cx, cy = F.floor((w - cz) / 2), F.floor((h - cz) / 2)
    bh, bw = part(h, 0.55), part(w, 0.55)
    ym, xm = F.greatest(zero, F.floor((h - bh) / 2)), F.greatest(zero, F.floor((w - bw) / 2))
    cw2, ch2 = part(w, 0.76), part(h, 0.76)
    boxes = [
        box(zero, zero, w, h), box(zero, zero, cw, ch), box(w - cw, zero, w, ch), box(zero, h - ch, cw, h), box(w - cw, h - ch, w, h),
        box(cx, cy, cx + cz, cy + cz), box(zero, ym, w, ym + bh), box(xm, zero, xm + bw, h), box(zero, zero, cw2, ch2), box(w - cw2, h - ch2, w, h),
    ]
    some = F.filter(F.array(*boxes), lambda b: (b["x1"] > b["x0"]) & (b["y1"] > b["y0"]))
    return F.when((w < 32) | (h < 32) | F.lit(views == 1), F.array(boxes[0])).otherwise(F.slice(some, 1, views))


def spread_indices(total: Column, k: Column) -> Column:
    """k indices spread over 0 .. total - 1, halves rounded to even; all if there are no more than k."""
    even = F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(1))), lambda i: F.bround(i * (total - 1) / (k - 1).cast("double")).cast("int"))
    none = F.array().cast("array<int>")
    return F.when((total <= 0) | (k <= 0), none).when(k == 1, F.array(F.lit(0))).when(k >= total, F.sequence(F.lit(0), F.greatest(total, F.lit(1)) - 1)).otherwise(even)


def _within(t: Column, duration: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(t, F.greatest(F.lit(0.0), duration - EPS)))


def sample_times(duration: Column, k: Column) -> Column:
    """Times of k frames: the usual fractions if they suffice, else evenly spread; zeros where the duration is unknown."""
    usual = F.slice(F.array(*map(F.lit, SAMPLE_FRACTIONS)), F.lit(1), F.greatest(k, F.lit(1)))
    even = F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(1))), lambda i: i / (k - 1).cast("double"))
    fractions = F.when(k <= len(SAMPLE_FRACTIONS), usual).otherwise(even)
    times = F.transform(fractions, lambda f: F.when(duration <= 0.001, F.lit(0.0)).otherwise(_within(f * duration, duration)))
    return F.when(k <= 0, F.array().cast("array<double>")).otherwise(times)


def fallback_times(duration: Column, taken: Column) -> Column:
    """Other times to try, without those already sampled (to the millisecond)."""
    times = F.transform(F.array(*map(F.lit, FALLBACK_FRACTIONS)), lambda f: _within(f * duration, duration))
    rounded = F.transform(taken, lambda t: F.round(t, 3))
    return F.when(duration <= 0.001, F.array().cast("array<double>")).otherwise(F.filter(times, lambda t: ~F.array_contains(rounded, F.round(t, 3))))
