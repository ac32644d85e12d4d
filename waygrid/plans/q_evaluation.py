"""Queries: threshold evaluation over verification evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import LOCATION_TOLERANCE_M
from ..operators import evaluation as E
from ..operators import retrieval as R
from .catalog import query, rounded
from .q_retrieval import SIMS, loo
from .views import Tables

K = 8


def evidence(t: Tables, k: int = K):
    """Verification rows of each query's top candidates (matches and ratios are derived)."""
    pairs = R.label_pairs(loo(t, k), t.v_images)
    q, c = F.col("query_id"), F.col("candidate_id")
    return pairs.withColumns({
        "num_matches": ((q * 31 + c * 17) % 60).cast("int"),
        "inlier_ratio": F.when(F.col("is_true_match"), 0.3).otherwise(0.0) + ((q * 7 + c * 13) % 71) / 100.0,
        "inlier_spread": ((q * 3 + c * 5) % 41) / 100.0,
        "keypoints": ((q * 17) % 400).cast("int"),
    })


EVIDENCE = SIMS + f""",
  e AS (SELECT query_id, candidate_id, rank, q_loc, c_loc, sqrt((cx-qx)*(cx-qx)+(cy-qy)*(cy-qy)) AS error_m, q_loc = c_loc AS is_true_match,
    CAST((query_id * 31 + candidate_id * 17) % 60 AS INT) AS num_matches,
    CASE WHEN q_loc = c_loc THEN 3e-1 ELSE 0e0 END + ((query_id * 7 + candidate_id * 13) % 71) / 1e2 AS inlier_ratio,
    ((query_id * 3 + candidate_id * 5) % 41) / 1e2 AS inlier_spread, (query_id * 17) % 400 AS keypoints
    FROM r WHERE rank <= {K}),
  ok AS (SELECT * FROM e WHERE num_matches >= 15 AND inlier_ratio >= 5e-1),
  f AS (SELECT i.image_id AS query_id, o.candidate_id AS matched_id, o.error_m, o.inlier_ratio,
    CASE WHEN o.error_m IS NULL THEN 'no_match' WHEN o.error_m <= 5e-1 THEN 'correct' ELSE 'wrong_location' END AS status
    FROM v_images i LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM ok) o ON o.query_id = i.image_id AND o.k = 1)"""


def ids(t: Tables):
    return t.v_images.select(F.col("image_id").alias("query_id"))


def resolved(t: Tables):
    return E.resolve_at_threshold(evidence(t), ids(t))


@query("resolve_at_threshold", f"WITH {EVIDENCE} SELECT query_id, status, matched_id, round(error_m, 6) AS error_m, round(inlier_ratio, 6) AS inlier_ratio FROM f")
def _(t):
    return rounded(resolved(t))


@query("eval_summary", f"""WITH {EVIDENCE} SELECT count(*) AS total, count(*) FILTER (status = 'correct') AS correct,
 count(*) FILTER (status = 'wrong_location') AS wrong_location, count(*) FILTER (status = 'no_match') AS no_match,
 round(avg(CASE WHEN status = 'correct' THEN 1e0 ELSE 0e0 END), 6) AS correct_rate, round(avg(inlier_ratio) FILTER (status = 'correct'), 6) AS inlier_mean,
 round(min(inlier_ratio) FILTER (status = 'correct'), 6) AS inlier_min, round(max(inlier_ratio) FILTER (status = 'correct'), 6) AS inlier_max FROM f""")
def _(t):
    return rounded(E.eval_summary(resolved(t)))


@query("threshold_sweep", f"""WITH {EVIDENCE},
ts AS (SELECT CAST(10 + 5 * range AS DOUBLE) / 100 AS threshold FROM range(13)),
w AS (SELECT threshold, query_id, error_m, row_number() OVER (PARTITION BY threshold, query_id ORDER BY rank) AS k
  FROM e JOIN ts ON inlier_ratio >= threshold WHERE num_matches >= 15),
g AS (SELECT threshold, count(*) FILTER (error_m <= 5e-1) AS correct, count(*) FILTER (error_m > 5e-1) AS wrong_location FROM w WHERE k = 1 GROUP BY threshold),
nn AS (SELECT count(*) AS total FROM v_images)
SELECT threshold, coalesce(correct, 0) AS correct, coalesce(wrong_location, 0) AS wrong_location,
  total - coalesce(correct, 0) - coalesce(wrong_location, 0) AS no_match, round(coalesce(correct, 0) / CAST(total AS DOUBLE), 6) AS correct_rate
FROM ts CROSS JOIN nn LEFT JOIN g USING (threshold)""")
def _(t):
    return rounded(E.threshold_sweep(evidence(t), ids(t)))


@query("evidence_separation", "WITH " + EVIDENCE + " SELECT " + ", ".join(
    f"count(*) FILTER ({c}) AS {n}_count, " + ", ".join(
        f"round({fn}({v}) FILTER ({c}), 6) AS {n}_{s}{fs}" for v, s in (("inlier_ratio", ""), ("inlier_spread", "spread_"))
        for fn, fs in (("avg", "mean"), ("stddev_pop", "std")))
    for n, c in (("genuine", "error_m <= 5e-1"), ("impostor", "error_m > 5e-1")))
    + ", round(avg(inlier_ratio) FILTER (error_m <= 5e-1) - avg(inlier_ratio) FILTER (error_m > 5e-1), 6) AS mean_gap FROM e")
def _(t):
    return rounded(E.evidence_separation(evidence(t)))


@query("confusion_pairs", f"""WITH {EVIDENCE} SELECT a.location_id AS true_location, b.location_id AS matched_location, count(*) AS n,
  round(avg(error_m), 6) AS mean_error_m FROM f JOIN v_images a ON a.image_id = query_id JOIN v_images b ON b.image_id = matched_id
  WHERE status = 'wrong_location' GROUP BY ALL""")
def _(t):
    return rounded(E.confusion_pairs(resolved(t), t.v_images))


@query("per_location_breakdown", f"""WITH {EVIDENCE} SELECT floor, zone, round_even(x, 2) AS x, round_even(y, 2) AS y,
  count(*) FILTER (status = 'correct') AS correct, count(*) AS n FROM f JOIN v_images i ON i.image_id = query_id GROUP BY ALL""")
def _(t):
    return E.per_location_breakdown(resolved(t), t.v_images)


@query("latency_stats", """SELECT source, round(avg(latency_ms), 6) AS mean_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms,
  max(latency_ms) AS max_ms FROM v_points GROUP BY source""")
def _(t):
    return rounded(E.latency_stats(t.v_points, "latency_ms", ["source"]))


CONF = """count(*) FILTER (is_true_match AND inlier_ratio >= 5e-1) AS tp, count(*) FILTER (is_true_match AND inlier_ratio < 5e-1) AS fn,
  count(*) FILTER (NOT is_true_match AND inlier_ratio >= 5e-1) AS fp, count(*) FILTER (NOT is_true_match AND inlier_ratio < 5e-1) AS tn"""


@query("verifier_confusion", f"""WITH {EVIDENCE}, c AS (SELECT {CONF} FROM e)
SELECT tp, fn, fp, tn, round(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 6) AS true_positive_rate,
  round(fp / CAST(nullif(fp + tn, 0) AS DOUBLE), 6) AS false_positive_rate, round(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 6) AS precision FROM c""")
def _(t):
    return rounded(E.verifier_confusion(evidence(t)))


SWEEP = EVIDENCE + """, ts AS (SELECT CAST(range AS BIGINT) AS i FROM range(21)),
s AS (SELECT i / 2e1 AS threshold, count(*) FILTER (is_true_match AND round(inlier_ratio * 20, 9) >= i) AS tp,
  count(*) FILTER (NOT is_true_match AND round(inlier_ratio * 20, 9) >= i) AS fp, count(*) FILTER (is_true_match) AS pos FROM e CROSS JOIN ts GROUP BY i),
pr AS (SELECT threshold, tp / CAST(nullif(tp + fp, 0) AS DOUBLE) AS precision, tp / CAST(nullif(pos, 0) AS DOUBLE) AS recall FROM s)"""


@query("pr_sweep", f"WITH {SWEEP} SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pr")
def _(t):
    return rounded(E.pr_sweep(evidence(t)))


@query("best_f1", f"""WITH {SWEEP}, x AS (SELECT *, CASE WHEN precision > 0 AND recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE -1e0 END AS f1
  FROM pr WHERE precision IS NOT NULL AND recall IS NOT NULL)
SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM x
ORDER BY round(f1, 12) DESC, threshold LIMIT 1""")
def _(t):
    return rounded(E.best_f1(E.pr_sweep(evidence(t))))


@query("by_texture", f"""WITH {EVIDENCE}, c AS (SELECT CASE WHEN keypoints < 50 THEN 'low_texture' WHEN keypoints < 200 THEN 'medium_texture' ELSE 'high_texture' END AS bucket,
  count(*) AS n, {CONF} FROM e GROUP BY 1)
SELECT bucket, n, round(tp / CAST(greatest(tp + fn, 1) AS DOUBLE), 6) AS true_positive_rate, round(fp / CAST(greatest(fp + tn, 1) AS DOUBLE), 6) AS false_positive_rate FROM c""")
def _(t):
    return rounded(E.by_texture(evidence(t)))


@query("inlier_evidence", """
WITH m AS (SELECT l_suppkey % 7 AS query_id, l_orderkey % 500 AS candidate_id, (l_partkey * 3 + l_linenumber) % 5 < 3 AS inlier,
  CAST((l_partkey * 37) % 640 AS DOUBLE) AS qx, CAST((l_partkey * 11) % 480 AS DOUBLE) AS qy, CAST((l_orderkey * 3 + l_linenumber * 97) % 1280 AS DOUBLE) AS cx,
  CAST((l_orderkey * 7 + l_linenumber * 53) % 720 AS DOUBLE) AS cy FROM lineitem),
g AS (SELECT query_id, candidate_id, count(*) AS n, count(*) FILTER (inlier) AS k,
  least((max(qx) FILTER (inlier) - min(qx) FILTER (inlier)) / 639, (max(qy) FILTER (inlier) - min(qy) FILTER (inlier)) / 479,
        (max(cx) FILTER (inlier) - min(cx) FILTER (inlier)) / 1279, (max(cy) FILTER (inlier) - min(cy) FILTER (inlier)) / 719) AS span FROM m GROUP BY ALL)
SELECT query_id, candidate_id, n AS num_matches, CASE WHEN n >= 15 THEN k ELSE 0 END AS num_inliers,
  round(CASE WHEN n >= 15 THEN k / CAST(n AS DOUBLE) ELSE 0e0 END, 6) AS inlier_ratio, round(CASE WHEN n >= 15 THEN coalesce(span, 0e0) ELSE 0e0 END, 6) AS inlier_spread FROM g""")
def _(t):
    m = t.lineitem.selectExpr(
        "l_suppkey % 7 AS query_id", "l_orderkey % 500 AS candidate_id", "(l_partkey * 3 + l_linenumber) % 5 < 3 AS inlier",
        "CAST((l_partkey * 37) % 640 AS DOUBLE) AS qx", "CAST((l_partkey * 11) % 480 AS DOUBLE) AS qy",
        "CAST((l_orderkey * 3 + l_linenumber * 97) % 1280 AS DOUBLE) AS cx", "CAST((l_orderkey * 7 + l_linenumber * 53) % 720 AS DOUBLE) AS cy",
        "640 AS q_width", "480 AS q_height", "1280 AS c_width", "720 AS c_height")
    return rounded(E.inlier_evidence(m))


@query("leaderboard", f"""WITH {SIMS}, w AS (SELECT 'cosine' AS method, avg(CASE WHEN q_loc = c_loc THEN 1e0 ELSE 0e0 END) AS recall_at_1 FROM r WHERE rank = 1)
SELECT method, round(recall_at_1, 6) AS recall_at_1, CAST(1 AS INT) AS place FROM w""")
def _(t):
    metrics = R.retrieval_metrics(R.ranking_scan(t.v_images))
    rep = metrics.select(F.lit("cosine").alias("method"), "recall_at_1")
    return rounded(E.leaderboard(rep).withColumn("place", F.lit(1)))
