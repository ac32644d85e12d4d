"""Queries: similarity search, rankings, votes, descriptors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import retrieval as R
from .catalog import query, rounded
from .views import Tables

K = 8

# all ordered pairs with their rank, as SQL (the Spark plans never form these)
SIMS = """n AS (SELECT image_id, location_id, orientation, floor, x, y, CAST(embedding AS DOUBLE[]) AS v,
    sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS nv FROM v_images),
  p AS (SELECT q.image_id AS query_id, c.image_id AS candidate_id, q.location_id AS q_loc, c.location_id AS c_loc,
    q.orientation AS q_deg, c.orientation AS c_deg, c.floor AS c_floor, c.x AS cx, c.y AS cy, q.x AS qx, q.y AS qy,
    round(list_inner_product(q.v, c.v) / (q.nv * c.nv), 9) AS similarity
    FROM n q JOIN n c ON q.image_id <> c.image_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, candidate_id) AS rank FROM p)"""


def loo(t: Tables, k: int = K):
    return R.leave_one_out_topk(t.v_images, k)


def probe(t: Tables):
    """Queries for the two-sided search: images turned by swapping vector halves."""
    swap = F.concat(F.slice("embedding", 33, 32), F.slice("embedding", 1, 32))
    return t.v_images.withColumn("embedding", swap)


@query("topk_similar", f"""
WITH n AS (SELECT image_id, CAST(embedding AS DOUBLE[]) AS v, list_concat(list_slice(CAST(embedding AS DOUBLE[]), 33, 64),
    list_slice(CAST(embedding AS DOUBLE[]), 1, 32)) AS w, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS nv FROM v_images),
p AS (SELECT q.image_id AS query_id, c.image_id AS candidate_id, round(list_inner_product(q.w, c.v) / (q.nv * c.nv), 9) AS similarity FROM n q, n c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, candidate_id) AS rank FROM p)
SELECT query_id, candidate_id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 10""")
def _(t):
    return rounded(R.topk_similar(probe(t), t.v_images, 10))


@query("leave_one_out_topk", f"""WITH {SIMS}
SELECT query_id, candidate_id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= {K}""")
def _(t):
    return rounded(loo(t))


@query("topk_similar_blocked")
def _(t):
    return rounded(R.topk_similar_blocked(t.v_images, t.v_images, K, exclude_self=True))


@query("attach_record", f"""WITH {SIMS}
SELECT query_id, candidate_id, rank, i.location_id, i.floor, i.zone, i.x, i.y FROM r JOIN v_images i ON i.image_id = candidate_id
WHERE rank <= {K} AND candidate_id % 7 <> 0""")
def _(t):
    # records are missing for some ids: their candidates drop out
    rec = t.v_images.where("image_id % 7 <> 0").drop("embedding", "orientation")
    return R.attach_record(loo(t).drop("similarity"), rec)


@query("label_pairs", f"""WITH {SIMS}
SELECT query_id, candidate_id, rank, round(similarity, 6) AS similarity, round(sqrt((cx-qx)*(cx-qx)+(cy-qy)*(cy-qy)), 6) AS error_m,
  q_loc = c_loc AS is_true_match FROM r WHERE rank <= {K}""")
def _(t):
    return rounded(R.label_pairs(loo(t), t.v_images))


@query("retrieval_metrics", f"""WITH {SIMS},
h AS (SELECT *, sum(CASE WHEN q_loc = c_loc THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM r),
q AS (SELECT query_id, min(rank) AS first_rank, avg(hits / CAST(rank AS DOUBLE)) AS ap FROM h WHERE q_loc = c_loc GROUP BY query_id)
SELECT count(*) AS num_queries, round(avg(CASE WHEN first_rank <= 1 THEN 1e0 ELSE 0e0 END), 6) AS recall_at_1,
  round(avg(CASE WHEN first_rank <= 5 THEN 1e0 ELSE 0e0 END), 6) AS recall_at_5, round(avg(ap), 6) AS mean_ap FROM q""")
def _(t):
    return rounded(R.retrieval_metrics(R.ranking_scan(t.v_images)))


@query("score_separation", f"""WITH {SIMS}
SELECT CAST(count(*) FILTER (q_loc = c_loc) AS BIGINT) AS genuine_count, CAST(count(*) FILTER (q_loc <> c_loc) AS BIGINT) AS impostor_count,
  round(avg(s) FILTER (q_loc = c_loc), 6) AS genuine_mean, round(stddev_pop(s) FILTER (q_loc = c_loc), 6) AS genuine_std,
  round(avg(s) FILTER (q_loc <> c_loc), 6) AS impostor_mean, round(stddev_pop(s) FILTER (q_loc <> c_loc), 6) AS impostor_std,
  round(avg(s) FILTER (q_loc = c_loc) - avg(s) FILTER (q_loc <> c_loc), 6) AS gap
FROM (SELECT *, similarity AS s FROM r) WHERE query_id IN (SELECT query_id FROM r WHERE q_loc = c_loc)""")
def _(t):
    return rounded(R.score_separation(t.v_images))


@query("heading_bucket_recall", f"""WITH {SIMS},
b AS (SELECT *, abs(q_deg - c_deg) % 360 AS d FROM r WHERE rank = 1),
d AS (SELECT *, CASE WHEN least(d, 360 - d) <= 45 THEN '0-45' WHEN least(d, 360 - d) <= 90 THEN '45-90' ELSE '90-180' END AS bucket FROM b)
SELECT bucket, count(*) AS n, round(avg(CASE WHEN q_loc = c_loc THEN 1e0 ELSE 0e0 END), 6) AS recall_at_1 FROM d GROUP BY bucket""")
def _(t):
    return rounded(R.heading_bucket_recall(loo(t, 1), t.v_images))


@query("zscore_rows", f"""WITH {SIMS},
s AS (SELECT query_id, avg(similarity) AS mean, stddev_pop(similarity) AS std FROM p GROUP BY query_id)
SELECT query_id, candidate_id, rank, round((similarity - mean) / std, 5) AS zscore FROM r JOIN s USING (query_id) WHERE rank <= {K}""")
def _(t):
    z = R.zscore_rows(loo(t), R.row_statistics(t.v_images, "embedding"))
    return rounded(z.select("query_id", "candidate_id", "rank", "zscore"), 5)


@query("late_fusion", """
WITH n AS (SELECT image_id, list_slice(CAST(embedding AS DOUBLE[]), 1, 32) AS a, list_slice(CAST(embedding AS DOUBLE[]), 33, 64) AS b FROM v_images),
m AS (SELECT *, sqrt(list_inner_product(a, a)) AS na, sqrt(list_inner_product(b, b)) AS nb FROM n),
p AS (SELECT q.image_id AS query_id, c.image_id AS candidate_id, list_inner_product(q.a, c.a) / (q.na * c.na) AS sa,
  list_inner_product(q.b, c.b) / (q.nb * c.nb) AS sb FROM m q JOIN m c ON q.image_id <> c.image_id),
z AS (SELECT query_id, candidate_id, (sa - avg(sa) OVER w) / stddev_pop(sa) OVER w AS za, (sb - avg(sb) OVER w) / stddev_pop(sb) OVER w AS zb
  FROM p WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, candidate_id, round((za + zb) / 2, 6) AS similarity FROM z),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, candidate_id) AS rank FROM f)
SELECT query_id, candidate_id, rank FROM r WHERE rank <= 8""")
def _(t):
    halves = t.v_images.withColumns({"a": F.slice("embedding", 1, 32), "b": F.slice("embedding", 33, 32)})
    return R.late_fusion(halves, "a", "b", 8).select("query_id", "candidate_id", "rank")


@query("floor_vote", f"""WITH {SIMS},
v AS (SELECT query_id, c_floor AS floor, count(*) AS votes, min(rank) AS fr FROM r WHERE rank <= 5 GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, fr) AS k FROM v)
SELECT query_id, floor, votes FROM w WHERE k = 1""")
def _(t):
    hits = R.attach_record(loo(t, 5), t.v_images.select("image_id", "floor"))
    return R.floor_vote(hits)


@query("candidate_floor_order", f"""WITH {SIMS},
fl AS (SELECT * FROM (VALUES ('B2', 0, true), ('B1', 1, false), ('G', 2, true), ('1', 3, true)) f(floor, pos, mapped)),
v AS (SELECT query_id, c_floor AS floor, count(*) AS votes, min(rank) AS fr FROM r WHERE rank <= 5 GROUP BY ALL),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, fr) AS k FROM v),
q AS (SELECT image_id AS query_id, CASE WHEN image_id % 3 = 0 THEN NULL WHEN image_id % 3 = 1 THEN 'G' ELSE 'B2' END AS prior FROM v_images),
a AS (SELECT query_id, prior AS floor, 0 AS s, 0 AS o FROM q WHERE prior IS NOT NULL
  UNION ALL SELECT q.query_id, f.floor, 1, f.pos FROM q JOIN fl p ON p.floor = q.prior JOIN fl f ON abs(f.pos - p.pos) = 1 WHERE f.mapped),
e AS (SELECT query_id FROM a GROUP BY query_id HAVING count(*) >= 2),
b AS (SELECT * FROM a UNION ALL SELECT query_id, floor, 2, k FROM vr WHERE query_id NOT IN (SELECT query_id FROM e)
  UNION ALL SELECT query_id, floor, 3, pos FROM q, fl WHERE mapped),
c AS (SELECT query_id, floor, min(s * 1000 + o) AS k FROM b GROUP BY ALL)
SELECT query_id, floor, CAST(row_number() OVER (PARTITION BY query_id ORDER BY k, floor) - 1 AS INT) AS pos FROM c""")
def _(t):
    prior = F.when(F.col("image_id") % 3 == 0, F.lit(None)).when(F.col("image_id") % 3 == 1, "G").otherwise("B2")
    q = t.v_images.select(F.lit(1).alias("site_id"), F.col("image_id").alias("query_id"), prior.alias("prior_floor"))
    floors = t.spark.createDataFrame([(1, "B2", 0, True), (1, "B1", 1, False), (1, "G", 2, True), (1, "1", 3, True)],
                                     "site_id int, floor string, pos int, mapped boolean")
    hits = R.attach_record(loo(t, 5), t.v_images.select("image_id", "floor"))
    return R.candidate_floor_order(q, R.floor_votes(hits), floors)


BITS = """d AS (SELECT image_id, floor, list_sum(list_transform(range(0, 30), lambda i: CASE WHEN embedding[i + 1] >= 0 THEN CAST(1 AS BIGINT) << i ELSE 0 END)) AS w0,
  list_sum(list_transform(range(0, 30), lambda i: CASE WHEN embedding[i + 31] >= 0 THEN CAST(1 AS BIGINT) << i ELSE 0 END)) AS w1 FROM v_images)"""


def sign_words(t: Tables):
    """Two 30-bit words from the signs of the embedding, as a descriptor."""
    word = lambda start: F.aggregate(F.sequence(F.lit(0), F.lit(29)), F.lit(0).cast("long"), lambda s, i: s + F.when(
        F.element_at("embedding", i + start) >= 0, F.expr("1L") * F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long")))
    return t.v_images.select("image_id", "floor", F.array(word(1), word(31)).alias("desc"))


@query("hamming", f"""WITH {BITS}
SELECT image_id, bit_count(xor(CAST(w0 AS BIGINT), CAST(w1 AS BIGINT))) + bit_count(xor(CAST(w1 AS BIGINT), CAST(w0 AS BIGINT))) AS d FROM d""")
def _(t):
    d = sign_words(t)
    return d.select("image_id", V.hamming("desc", F.reverse("desc")).alias("d"))


@query("descriptor_match", f"""WITH {BITS},
p AS (SELECT q.floor, q.image_id AS query_id, c.image_id AS candidate_id,
  bit_count(xor(CAST(q.w0 AS BIGINT), CAST(c.w0 AS BIGINT))) + bit_count(xor(CAST(q.w1 AS BIGINT), CAST(c.w1 AS BIGINT))) AS d
  FROM d q JOIN d c ON q.floor = c.floor AND q.image_id <> c.image_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, candidate_id) AS k FROM p)
SELECT a.floor, a.query_id, a.candidate_id, CAST(a.d AS INT) AS d1, CAST(b.d AS INT) AS d2, a.d < 0.75 * b.d AS good
FROM r a JOIN r b ON a.query_id = b.query_id AND b.k = 2 WHERE a.k = 1""")
def _(t):
    d = sign_words(t)
    q, c = d.withColumnRenamed("image_id", "query_id"), d.withColumnRenamed("image_id", "candidate_id")
    return R.descriptor_match(q, c, R.VERIFY_RATIO, ["floor"], "desc", 30, True)


@query("cosine", """
WITH n AS (SELECT image_id, list_slice(CAST(embedding AS DOUBLE[]), 1, 32) AS a, list_slice(CAST(embedding AS DOUBLE[]), 33, 64) AS b FROM v_images)
SELECT image_id, round(list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b))), 6) AS sim FROM n""")
def _(t):
    return rounded(t.v_images.select("image_id", V.cosine(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)).alias("sim")))


@query("l2_normalize", """
WITH n AS (SELECT image_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS nv FROM v_images)
SELECT image_id, dim, round(v[dim] / nv, 6) AS value FROM n, (SELECT CAST(range + 1 AS INT) AS dim FROM range(64)) d""")
def _(t):
    u = t.v_images.select("image_id", F.posexplode(V.l2_normalize("embedding")).alias("p", "value"))
    return rounded(u.select("image_id", (F.col("p") + 1).alias("dim"), "value"))


@query("fuse_descriptors", """
WITH n AS (SELECT image_id, list_slice(CAST(embedding AS DOUBLE[]), 1, 32) AS a, list_slice(CAST(embedding AS DOUBLE[]), 33, 64) AS b FROM v_images),
m AS (SELECT *, sqrt(list_inner_product(a, a)) AS na, sqrt(list_inner_product(b, b)) AS nb FROM n)
SELECT image_id, dim, round(CASE WHEN dim <= 32 THEN a[dim] / na ELSE b[dim - 32] / nb END / sqrt(2), 6) AS value
FROM m, (SELECT CAST(range + 1 AS INT) AS dim FROM range(64)) d""")
def _(t):
    f = V.fuse_descriptors(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    u = t.v_images.select("image_id", F.posexplode(f).alias("p", "value"))
    return rounded(u.select("image_id", (F.col("p") + 1).alias("dim"), "value"))
