"""Queries: pixel tables, colour references and vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import colour as C
from .catalog import query, rounded


@query("hsv_histogram", """WITH b AS (SELECT image_id, CAST((least(floor(h * 8 / 180), 7) * 4 + least(floor(s * 4 / 256), 3)) * 2 + least(floor(v * 2 / 256), 1) AS INT) AS bin, count(*) AS n FROM v_pixels GROUP BY 1, 2),
t AS (SELECT image_id, sqrt(sum(CAST(n AS DOUBLE) * n)) AS len FROM b GROUP BY 1) SELECT image_id, bin, round(n / len, 6) AS v FROM b JOIN t USING (image_id)""")
def _(t):
    e = C.hsv_histogram(t.v_pixels).select("image_id", F.posexplode("embedding").alias("bin", "v")).where("v > 0")
    return rounded(e)


# one 12 x 9 grey image per part
def gray(t):
    p = t.part.select(F.col("p_partkey").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("px"))
    p = p.withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(8))))
    return p.withColumn("gray", ((F.col("px") * 37 + F.col("py") * 91 + F.col("image_id") * 17) % 256).cast("int"))


@query("image_quality", """WITH g AS (SELECT p_partkey AS image_id, x AS px, y AS py, CAST((x * 37 + y * 91 + p_partkey * 17) % 256 AS INT) AS gray FROM part, (SELECT range AS x FROM range(12)) a, (SELECT range AS y FROM range(9)) b),
n AS (SELECT g.*, CASE WHEN px = 0 THEN 1 ELSE px - 1 END AS l, CASE WHEN px = 11 THEN 10 ELSE px + 1 END AS r, CASE WHEN py = 0 THEN 1 ELSE py - 1 END AS u, CASE WHEN py = 8 THEN 7 ELSE py + 1 END AS d FROM g),
p AS (SELECT n.image_id, (l * 37 + py * 91 + image_id * 17) % 256 + (r * 37 + py * 91 + image_id * 17) % 256 + (px * 37 + u * 91 + image_id * 17) % 256 + (px * 37 + d * 91 + image_id * 17) % 256 - 4 * gray AS lap FROM n),
q AS (SELECT image_id, var_pop(lap) AS lv FROM p GROUP BY 1)
SELECT image_id, 12 AS width, 9 AS height, round(avg(gray), 6) AS brightness_mean, round(stddev_pop(gray), 6) AS brightness_std, round(quantile_cont(gray, 0.05), 6) AS brightness_p05, round(quantile_cont(gray, 0.95), 6) AS brightness_p95,
  round(any_value(lv), 4) AS laplacian_variance FROM g JOIN q USING (image_id) GROUP BY image_id""")
def _(t):
    q = C.image_quality(gray(t))
    return rounded(q).withColumn("laplacian_variance", F.round("laplacian_variance", 4))


SIG = """px AS (SELECT image_id, h, CASE WHEN image_id % 10 = 0 THEN s // 4 ELSE s END AS s, v FROM v_pixels), mk AS (SELECT * FROM px WHERE s >= 70 AND v >= 40), fr AS (SELECT image_id, avg(CASE WHEN s >= 70 AND v >= 40 THEN 1e0 ELSE 0e0 END) AS colour_frac FROM px GROUP BY 1),
hb AS (SELECT image_id, CAST(least(floor(h * 36 / 180), 35) AS INT) AS bin, sum(CAST(s AS DOUBLE)) AS w FROM mk GROUP BY 1, 2), al AS (SELECT image_id, CAST(range AS INT) AS bin FROM fr, range(36) WHERE colour_frac >= 6e-2),
hz AS (SELECT al.image_id, al.bin, coalesce(w, 0e0) AS w FROM al LEFT JOIN hb USING (image_id, bin)),
sm AS (SELECT a.image_id, a.bin, 5e-1 * a.w + 25e-2 * b.w + 25e-2 * c.w AS w FROM hz a JOIN hz b ON b.image_id = a.image_id AND b.bin = (a.bin + 35) % 36 JOIN hz c ON c.image_id = a.image_id AND c.bin = (a.bin + 1) % 36),
hist AS (SELECT image_id, bin, w / sum(w) OVER (PARTITION BY image_id) AS p FROM sm),
sb AS (SELECT image_id, CASE WHEN s < 100 THEN 0 WHEN s < 140 THEN 1 WHEN s < 190 THEN 2 ELSE 3 END AS bin, count(*) AS n FROM mk GROUP BY 1, 2),
sz AS (SELECT fr.image_id, CAST(range AS INT) AS bin, coalesce(n, 0) AS n FROM (SELECT * FROM fr WHERE colour_frac >= 6e-2) fr CROSS JOIN range(4) LEFT JOIN sb ON sb.image_id = fr.image_id AND sb.bin = range),
sat AS (SELECT image_id, bin, n / CAST(sum(n) OVER (PARTITION BY image_id) AS DOUBLE) AS p FROM sz)"""


def signatures(t):
    s = F.when(F.col("image_id") % 10 == 0, F.floor(F.col("s") / 4).cast("int")).otherwise(F.col("s"))
    return C.colour_signature(t.v_pixels.withColumn("s", s))


@query("colour_signature", f"""WITH {SIG} SELECT image_id, 'hue' AS part, bin, round(p, 6) AS v FROM hist UNION ALL SELECT image_id, 'sat', bin, round(p, 6) FROM sat UNION ALL SELECT image_id, 'frac', 0, round(colour_frac, 6) FROM fr""")
def _(t):
    s = signatures(t)
    rows = lambda part, c: s.where(F.col(c).isNotNull()).select("image_id", F.lit(part).alias("part"), F.posexplode(c).alias("bin", "v"))
    return rounded(rows("hue", "hist").unionByName(rows("sat", "sat_hist")).unionByName(s.select("image_id", F.lit("frac").alias("part"), F.lit(0).alias("bin"), F.col("colour_frac").alias("v"))))


def floor_of():
    return F.when(F.col("image_id") % 4 == 0, "G").when(F.col("image_id") % 4 == 1, "B1").when(F.col("image_id") % 4 == 2, "B2").otherwise(C.CABIN_KEY)


REF = SIG + """, fl AS (SELECT *, CASE image_id % 4 WHEN 0 THEN 'G' WHEN 1 THEN 'B1' WHEN 2 THEN 'B2' ELSE '_cabin' END AS floor FROM hist),
mh AS (SELECT floor, bin, avg(p) AS p FROM fl GROUP BY 1, 2), ms AS (SELECT CASE image_id % 4 WHEN 0 THEN 'G' WHEN 1 THEN 'B1' WHEN 2 THEN 'B2' ELSE '_cabin' END AS floor, bin, avg(p) AS p FROM sat GROUP BY 1, 2)"""


@query("colour_reference", f"""WITH {REF}, n AS (SELECT floor, count(DISTINCT image_id) AS samples FROM fl GROUP BY 1), pk AS (SELECT floor, arg_max(bin, round(p, 12) * 1000 - bin / 1e9) AS b FROM mh GROUP BY 1)
SELECT floor, samples, CAST(b * 10 + 5 AS INT) AS dominant_hue_deg, round(sum(p * (bin + 1)) / sum(p), 3) AS centroid FROM (SELECT floor, bin, round(p / sum(p) OVER (PARTITION BY floor), 5) AS p FROM mh) mh JOIN n USING (floor) JOIN pk USING (floor) GROUP BY floor, samples, b""")
def _(t):
    r = C.colour_reference(signatures(t).withColumn("floor", floor_of()))
    centroid = F.aggregate(F.transform("hist", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v) / F.aggregate("hist", F.lit(0.0), lambda s, v: s + v)
    return rounded(r.select("floor", "samples", "dominant_hue_deg", centroid.alias("centroid")), 3)


def references(t):
    return C.colour_reference(signatures(t).withColumn("floor", floor_of())).withColumn("site_id", F.lit(1))


@query("classify_colour")
def _(t):
    return rounded(C.classify_colour(signatures(t).withColumn("site_id", F.lit(1)), references(t)), 5)


@query("reference_similarity_report", f"""WITH {REF}, rh AS (SELECT floor, bin, round(p / sum(p) OVER (PARTITION BY floor), 5) AS p FROM mh), rs AS (SELECT floor, bin, round(p / sum(p) OVER (PARTITION BY floor), 5) AS p FROM ms),
h AS (SELECT a.floor AS fa, b.floor AS fb, sum(sqrt(a.p * b.p)) AS s FROM rh a JOIN rh b ON a.bin = b.bin AND a.floor <> b.floor GROUP BY 1, 2), s AS (SELECT a.floor AS fa, b.floor AS fb, sum(sqrt(a.p * b.p)) AS s FROM rs a JOIN rs b ON a.bin = b.bin AND a.floor <> b.floor GROUP BY 1, 2),
j AS (SELECT fa, fb, round(h.s * s.s, 9) AS sim, row_number() OVER (PARTITION BY fa ORDER BY round(h.s * s.s, 9) DESC, fb DESC) AS k FROM h JOIN s USING (fa, fb) WHERE fb <> '_cabin')
SELECT 1 AS site_id, f.floor, false AS needs_rescan, CASE WHEN f.floor <> '_cabin' THEN fb END AS closest_floor, CASE WHEN f.floor <> '_cabin' THEN round_even(sim, 3) END AS closest_sim, CASE WHEN f.floor <> '_cabin' THEN sim >= 88e-2 END AS too_similar
FROM (SELECT DISTINCT floor FROM mh) f JOIN j ON j.fa = f.floor AND k = 1""")
def _(t):
    return C.reference_similarity_report(references(t))


def descriptors(t):
    """Four 16-d local descriptors per image."""
    e = F.col("embedding").cast("array<double>")
    return t.v_images.select("image_id", "location_id", F.explode(F.array(*[F.slice(e, 1 + 16 * i, 16) for i in range(4)])).alias("vec"))


@query("kmeans_vocabulary")
def _(t):
    model = C.kmeans_vocabulary(descriptors(t), 8, 0)
    rows = [(i, float(v)) for i, c in enumerate(model.clusterCenters()) for v in [sum(x * x for x in c) ** 0.5]]
    return rounded(t.spark.createDataFrame(rows, "cluster int, length double"))


@query("vlad_aggregate", """WITH d AS (SELECT image_id, p, list_slice(CAST(embedding AS DOUBLE[]), 1 + 16 * p, 16 + 16 * p) AS v FROM v_images, (SELECT range AS p FROM range(4)) r), u AS (SELECT image_id, p, v, sqrt(list_inner_product(v, v)) AS n FROM d),
e AS (SELECT image_id, p, CAST(i AS INT) AS dim, v[i + 1] / n AS x FROM u, (SELECT range AS i FROM range(16)) r), a AS (SELECT *, max(CASE WHEN dim = 0 THEN x END) OVER (PARTITION BY image_id, p) >= 0 AS pos FROM e),
s AS (SELECT image_id, CASE WHEN pos THEN 0 ELSE 1 END AS cluster, dim, sum(x - CASE WHEN dim = 0 THEN CASE WHEN pos THEN 1e0 ELSE -1e0 END ELSE 0e0 END) AS r FROM a GROUP BY 1, 2, 3),
l AS (SELECT image_id, cluster, dim, r / sqrt(sum(r * r) OVER (PARTITION BY image_id, cluster)) AS r FROM s), g AS (SELECT image_id, cluster * 16 + dim AS bin, r / sqrt(sum(r * r) OVER (PARTITION BY image_id)) AS v FROM l)
SELECT image_id, bin, round(v, 5) + 0e0 AS v FROM g""")
def _(t):
    # two centres on the first axis: the sign of the first coordinate picks the cluster
    centres = [[1.0] + [0.0] * 15, [-1.0] + [0.0] * 15]
    v = C.vlad_aggregate(descriptors(t), centres).select("image_id", F.posexplode("vlad").alias("bin", "v")).where("v <> 0")
    return rounded(v, 5)
