"""Colour histograms, image quality, lobby colours, and descriptor vocabularies, from pixel tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.vectors import bind, colour_similarity, l2_normalize, norm
from ..session import large
from .ordered import numbered

# Colour mask, bins and decision limits.
HUE_BINS, SAT_MIN, VAL_MIN, MIN_COLOUR_FRAC = 36, 70, 40, 0.06
SAT_BANDS = (70, 100, 140, 190, 256)
MATCH_MIN, MATCH_MARGIN, COVER_RATIO = 0.6, 0.12, 0.5
STRONG_SCORE, STRONG_MARGIN, STRONG_COVER = 0.85, 0.25, 0.75
CABIN_KEY = "_cabin"


def dense(bins: DataFrame, keys: Sequence[str], size: int, value: str = "v") -> DataFrame:
    """(keys, bin, value) rows as one array of fixed size per key."""
    m = bins.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", value))).alias("m"))
    arr = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return m.select(*keys, arr.alias("hist"))


def hsv_histogram(pixels: DataFrame, shape: tuple[int, int, int] = (8, 4, 2), key: str = "image_id") -> DataFrame:
    """Normalised colour histogram of each image (h 0..179, s and v 0..255)."""
    hb, sb, vb = shape
    b = lambda c, n, top: F.least(F.floor(F.col(c) * n / top), F.lit(n - 1))
    index = ((b("h", hb, 180) * sb + b("s", sb, 256)) * vb + b("v", vb, 256)).cast("int")
    counts = pixels.groupBy(key, index.alias("bin")).agg(F.count("*").cast("double").alias("v"))
    return dense(counts, [key], hb * sb * vb).select(key, l2_normalize("hist").alias("embedding"))


def image_quality(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """Size, brightness spread and sharpness of dense grey images (px, py, gray).

    The Laplacian at a pixel adds its four neighbours; every pixel sends its value to
    them (mirrored at the border), so one grouped sum replaces any image-wide window.
    """
    size = pixels.groupBy(key).agg((F.max("px") + 1).alias("width"), (F.max("py") + 1).alias("height"))
    p = pixels.join(large(size), key)
    g = F.col("gray").cast("double")
    # a border pixel's missing neighbour is its mirror image: the opposite neighbour counts twice
    side = lambda c, n, d: F.when((F.col(c) + d >= 0) & (F.col(c) + d < F.col(n)), F.when(
        (F.col(c) + 2 * d < 0) | (F.col(c) + 2 * d >= F.col(n)), g * 2).otherwise(g))
    give = F.array(
        F.struct(F.col("px").alias("x"), F.col("py").alias("y"), (-4 * g).alias("w")),
        *[F.struct((F.col("px") + d).alias("x"), F.col("py").alias("y"), side("px", "width", d).alias("w")) for d in (-1, 1)],
        *[F.struct(F.col("px").alias("x"), (F.col("py") + d).alias("y"), side("py", "height", d).alias("w")) for d in (-1, 1)])
    lap = p.select(key, F.inline(give)).where("w is not null").groupBy(key, "x", "y").agg(F.sum("w").alias("lap"))
    sharp = lap.groupBy(key).agg((F.stddev_pop("lap") * F.stddev_pop("lap")).alias("laplacian_variance"))
    b = pixels.groupBy(key).agg(F.avg("gray").alias("brightness_mean"), F.stddev_pop("gray").alias("brightness_std"),
                                F.percentile("gray", 0.05).alias("brightness_p05"), F.percentile("gray", 0.95).alias("brightness_p95"))
    return size.join(large(b), key).join(large(sharp), key)


def colour_signature(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """Smoothed hue histogram, saturation bands and coloured share; NULL arrays for a grey image."""
    on = (F.col("s") >= SAT_MIN) & (F.col("v") >= VAL_MIN)
    hue = F.least(F.floor(F.col("h") * HUE_BINS / 180), F.lit(HUE_BINS - 1)).cast("int")
    band = sum(F.when(F.col("s") >= b, 1).otherwise(0) for b in SAT_BANDS[1:-1])
    frac = pixels.groupBy(key).agg(F.avg(F.when(on, 1.0).otherwise(0.0)).alias("colour_frac"))
    hist = dense(pixels.where(on).groupBy(key, hue.alias("bin")).agg(F.sum(F.col("s").cast("double")).alias("v")), [key], HUE_BINS)
    sat = dense(pixels.where(on).groupBy(key, band.cast("int").alias("bin")).agg(F.count("*").cast("double").alias("v")), [key], len(SAT_BANDS) - 1)
    both = frac.join(hist, key, "left").join(sat.withColumnRenamed("hist", "sat"), key, "left")
    smooth = F.transform("hist", lambda v, i: 0.5 * v + 0.25 * F.element_at("hist", (i + HUE_BINS - 1) % HUE_BINS + 1) + 0.25 * F.element_at("hist", (i + 1) % HUE_BINS + 1))
    share = lambda a: bind(F.aggregate(a, F.lit(0.0), lambda s, v: s + v), lambda n: F.when(n > 0, F.transform(a, lambda v: v / n)))
    ok = F.col("colour_frac") >= MIN_COLOUR_FRAC
    return both.select(key, "colour_frac", F.when(ok, share(smooth)).alias("hist"), F.when(ok, share(F.col("sat"))).alias("sat_hist"))


def colour_reference(signatures: DataFrame, key: str = "floor") -> DataFrame:
    """Mean colour of each floor over its signatures; grey ones are left out."""
    ok = signatures.where("hist is not null and colour_frac >= 0.06")
    def mean(col_name, size):
        bins = ok.where(F.col(col_name).isNotNull()).select(key, F.posexplode(col_name).alias("bin", "v")).groupBy(key, "bin").agg(F.avg("v").alias("v"))
        d = dense(bins, [key], size)
        total = lambda n: F.transform("hist", lambda v: F.round(v / F.greatest(n, F.lit(1e-9)), 5))
        return d.select(key, bind(F.aggregate("hist", F.lit(0.0), lambda s, v: s + v), total).alias(col_name), F.col("hist").alias(f"raw_{col_name}"))
    base = ok.groupBy(key).agg(F.count("*").alias("samples"), F.count("sat_hist").alias("sat_samples"), F.round(F.avg("colour_frac"), 4).alias("colour_frac"))
    out = base.join(mean("hist", HUE_BINS), key).join(mean("sat_hist", len(SAT_BANDS) - 1), key, "left")
    step = 360 // HUE_BINS
    peak = F.array_position("raw_hist", F.array_max("raw_hist")) - 1
    return out.withColumn("dominant_hue_deg", (peak * step + step // 2).cast("int")).drop("raw_hist", "raw_sat_hist")


def classify_colour(signatures: DataFrame, refs: DataFrame, key: str = "image_id", site: str = "site_id") -> DataFrame:
    """Best floor of each signature among its site's references, with the reason when there is none:
    ``no_refs`` at a site without references."""
    r = refs.select(site, "floor", F.col("hist").alias("r_hist"), F.col("sat_hist").alias("r_sat"), F.col("colour_frac").alias("r_frac"))
    pairs = signatures.join(r, site, "left").withColumn("score", F.coalesce(colour_similarity("hist", "r_hist", "sat_hist", "r_sat"), F.lit(0.0)))
    entry = F.struct(F.round("score", 9).alias("score"), "floor", "r_frac", (F.coalesce(F.size("r_sat"), F.lit(0)) > 0).alias("has_sat"))
    g = pairs.groupBy(key, site, "colour_frac").agg(F.max(entry).alias("best"), F.max_by(entry, F.struct("score", "floor")).alias("same"),
                                                    F.max(F.when(F.col("floor") == CABIN_KEY, True)).alias("cabin_known"))
    # the runner-up is the best of the other references
    top = pairs.join(g.select(key, F.col("best.floor").alias("floor")), [key, "floor"], "left_anti")
    second = top.groupBy(key).agg(F.max(F.round("score", 9)).alias("second"))
    g = g.join(second, key, "left")
    b, frac = F.col("best"), F.col("colour_frac")
    margin = b["score"] - F.coalesce("second", F.lit(0.0))
    grey = frac < MIN_COLOUR_FRAC
    reason = (F.when(b["floor"].isNull(), "no_refs").when(grey, "grey").when((b["floor"] == CABIN_KEY) & (b["score"] >= MATCH_MIN), "lift_interior").when(b["floor"] == CABIN_KEY, "no_match")
              .when((b["score"] < MATCH_MIN) | (margin < MATCH_MARGIN), "ambiguous")
              .when((b["r_frac"] > 0) & (frac < COVER_RATIO * b["r_frac"]), "too_little_colour"))
    strong = (b["score"] >= STRONG_SCORE) & (margin >= STRONG_MARGIN) & ((b["r_frac"] == 0) | (frac >= STRONG_COVER * b["r_frac"])) & b["has_sat"] & F.coalesce("cabin_known", F.lit(False))
    found = reason.isNull()
    return g.select(key, F.when(found, b["floor"]).alias("floor"), F.when(grey, 0.0).otherwise(b["score"]).alias("score"), F.when(grey, 0.0).otherwise(margin).alias("margin"),
                    (found & strong).alias("strong"), F.coalesce(reason, F.lit("")).alias("reason"))


def reference_similarity_report(refs: DataFrame, site: str = "site_id") -> DataFrame:
    """For each floor the other floor it looks most like, and whether that is too close."""
    side = lambda p: refs.select(site, *[F.col(c).alias(f"{p}_{c}") for c in ("floor", "hist", "sat_hist")])
    pairs = side("a").join(side("b").where(F.col("b_floor") != CABIN_KEY), site).where("a_floor <> b_floor")
    sim = colour_similarity("a_hist", "b_hist", "a_sat_hist", "b_sat_hist")
    best = pairs.where(F.col("a_floor") != CABIN_KEY).withColumn("sim", F.round(sim, 9)).groupBy(site, F.col("a_floor").alias("floor")).agg(F.max(F.struct("sim", "b_floor")).alias("m"))
    out = refs.select(site, "floor", F.col("sat_hist").isNull().alias("needs_rescan")).join(best, [site, "floor"], "left")
    return out.select(site, "floor", "needs_rescan", F.col("m.b_floor").alias("closest_floor"), F.bround("m.sim", 3).alias("closest_sim"), (F.col("m.sim") >= 1.0 - MATCH_MARGIN).alias("too_similar"))


# ------------------------------------------------------------------ vocabularies
def kmeans_vocabulary(descriptors: DataFrame, k: int = 64, seed: int = 0, vec: str = "vec", max_iter: int = 20):
    """Cluster centres (a fitted model); needs at least ``k`` descriptors."""
    if descriptors.limit(k).count() < k:
        raise ValueError(f"a vocabulary of {k} needs at least {k} descriptors")
    data = descriptors.select(array_to_vector(F.col(vec)).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="cluster").fit(data)


def vlad_aggregate(descriptors: DataFrame, centres: Sequence[Sequence[float]], image: str = "image_id", vec: str = "vec") -> DataFrame:
    """Sum of residuals to the nearest centre, per image and cluster, then unit length twice.

    ``centres`` is the fitted vocabulary (k x d numbers, set by the model, not the data).
    """
    c = np.asarray(centres, dtype=np.float64)
    k, d = c.shape

    def residuals(batches):
        for b in batches:
            if not len(b):
                continue
            v = np.stack(b["vec"].to_numpy()).astype(np.float64)
            v = v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
            near = ((c ** 2).sum(1)[None, :] - 2 * v @ c.T).argmin(1)
            out = pd.DataFrame({"image": b["image"].to_numpy(), "cluster": near})
            out = pd.concat([out, pd.DataFrame(v - c[near])], axis=1).groupby(["image", "cluster"], as_index=False).sum()
            long = out.melt(["image", "cluster"], var_name="dim", value_name="r")
            yield long.astype({"dim": "int32", "cluster": "int32"})

    image_type = descriptors.schema[image].dataType.simpleString()
    parts = descriptors.select(F.col(image).alias("image"), F.col(vec).alias("vec")).mapInPandas(residuals, f"image {image_type}, cluster int, dim int, r double")
    sums = parts.groupBy("image", "cluster", "dim").agg(F.sum("r").alias("r"))
    length = sums.groupBy("image", "cluster").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("len"))
    unit = sums.join(length, ["image", "cluster"]).withColumn("v", F.when(F.col("len") > 0, F.col("r") / F.col("len")).otherwise(0.0))
    bins = unit.select("image", (F.col("cluster") * d + F.col("dim")).alias("bin"), "v")
    return dense(bins, ["image"], k * d).select(F.col("image").alias(image), l2_normalize("hist").alias("vlad"))
