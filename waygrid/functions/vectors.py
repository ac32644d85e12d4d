"""Array maths on embeddings, descriptors and histograms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .geometry import bind, col

ZERO_NORM = 1e-8


def as_doubles(c) -> Column:
    return col(c).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda u, w: u * w),
                       F.lit(0.0), lambda s, v: s + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def _guarded(n: Column) -> Column:
    return F.when(n == 0, F.lit(ZERO_NORM)).otherwise(n)


def l2_normalize(a) -> Column:
    return bind(_guarded(norm(a)), lambda n: F.transform(as_doubles(a), lambda v: v / n))


def cosine(a, b) -> Column:
    return dot(a, b) / (_guarded(norm(a)) * _guarded(norm(b)))


def _usable(a) -> Column:
    bad = F.exists(as_doubles(a), lambda v: F.isnan(v) | (F.abs(v) == float("inf")) | v.isNull())
    return ~bad & (norm(a) > 0)


def fuse_descriptors(a, b) -> Column:
    """Two unit vectors side by side, scaled to unit length; NULL for zero or non-finite input."""
    # two unit vectors side by side have length sqrt(2)
    half = lambda v: bind(norm(v) * F.sqrt(F.lit(2.0)), lambda n: F.transform(as_doubles(v), lambda e: e / n))
    return F.when(_usable(a) & _usable(b), F.concat(half(a), half(b)))


def hamming(a, b) -> Column:
    """Differing bits of two descriptors held as arrays of integer words."""
    bits = F.zip_with(col(a), col(b), lambda u, w: F.bit_count(u.bitwiseXOR(w)))
    return F.aggregate(bits, F.lit(0), lambda s, v: s + v)


def bhattacharyya(a, b) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda u, w: F.sqrt(u * w)),
                       F.lit(0.0), lambda s, v: s + v)


def colour_similarity(hist_a, hist_b, sat_a, sat_b) -> Column:
    """Hue overlap, times saturation overlap when both sides have one."""
    hue = bhattacharyya(hist_a, hist_b)
    has_sat = (F.coalesce(F.size(col(sat_a)), F.lit(0)) > 0) & (F.coalesce(F.size(col(sat_b)), F.lit(0)) > 0)
    return F.when(has_sat, hue * bhattacharyya(sat_a, sat_b)).otherwise(hue)
