"""Points of a session meet its spans in a task, block by block; no row carries the list of them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from waygrid.operators import landmarks as L


def tables(spark):
    rng = random.Random(7)
    spans = [(s, k, *[round(rng.uniform(0, 40), 1) for _ in range(4)], 1.0, 0.0, 0.0, 0.0) for s in (1, 2) for k in range(60)]
    spans += [(2, 60, *spans[70][2:]), (3, 0, 5.0, 5.0, 5.0, 5.0, 1.0, 0.0, 0.0, 0.0)]
    points = [(i, s, rng.uniform(-5, 45), 1.0, rng.uniform(-5, 45)) for i, s in enumerate([1, 2, 2, 3, 4, None] * 30)] + [(900, 1, None, 1.0, 2.0)]
    return (spark.createDataFrame(points, "landmark_id long, session_id long, x double, y double, z double"),
            spark.createDataFrame(spans, "session_id long, piece int, a0x double, a0y double, a1x double, a1y double, scale double, angle double, tx double, ty double"), points, spans)


def nearest(x, z, spans):
    def far(s):
        dx, dy = s[4] - s[2], s[5] - s[3]
        n = dx * dx + dy * dy
        u = min(max(((x - s[2]) * dx + (z - s[3]) * dy) / n, 0), 1) if n else 0
        return round(math.hypot(x - s[2] - u * dx, z - s[3] - u * dy), 9)
    return min((far(s), s[1]) for s in spans)


@pytest.mark.parametrize("pairs, work", [(L.SPAN_PAIRS, L.SPAN_WORK) if hasattr(L, "SPAN_PAIRS") else (0, 0), (100, 300)])
def test_nearest_span(spark, monkeypatch, pairs, work):
    monkeypatch.setattr(L, "SPAN_PAIRS", pairs, raising=False)
    monkeypatch.setattr(L, "SPAN_WORK", work, raising=False)
    lm, pieces, points, spans = tables(spark)
    near = L._nearest_span(lm, pieces, F.col("x"), F.col("z"), "session_id", ["scale"])
    assert "collect_list" not in near._jdf.queryExecution().toString()
    got = {r.landmark_id: r._near for r in near.collect()}
    assert len(got) == len(points)
    for i, s, x, _, z in points:
        own = [p for p in spans if p[0] == s]
        if not own:
            assert got[i] is None
        elif x is None:
            assert got[i].d is None
        else:
            d, piece = nearest(x, z, own)
            assert (got[i].d, got[i].piece, got[i].s.piece) == (pytest.approx(d, abs=2e-9), piece, piece)


def test_anchors_keep_apart(spark):
    rng, at = random.Random(1), {}
    tags = [(s, k, float(k), rng.uniform(0, 3), rng.uniform(0, 3)) for s in (1, 2) for k in range(80)]
    frames = [(s, k, float(k), rng.uniform(0, 3), rng.uniform(0, 3)) for s in (1, 2) for k in range(80)]
    want = []
    for t, f in zip(tags, frames):
        last = at.get(t[0])
        if last is None or (math.dist(f[3:], last[0]) > 0.8 and math.dist(t[3:], last[1]) > 0.8):
            at[t[0]] = f[3:], t[3:]
            want.append(t[:2])
    got = L.tag_anchors(spark.createDataFrame(tags, "session_id long, tag_id long, tag_t double, facility_x double, facility_y double"),
                        spark.createDataFrame(frames, "session_id long, frame_id long, frame_t double, map_x double, map_z double"))
    assert sorted((r.session_id, r.tag_id) for r in got.collect()) == want and len(want) < 120
