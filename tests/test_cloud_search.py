"""Cloud points find the keypoint a brute force finds, in a first reach that follows the density of the keypoints."""

import math
import random

import pytest

from waygrid.operators import landmarks as L

CLOUD = "point_id string, x double, y double, z double"
PHOTOS = "image_id long, x double, y double, orientation int, width int, height int"
KEYS = "image_id long, kp_idx long, u double, v double, desc string"


def table(seed, points, photos, keys):
    """One crowded place: photos of one spot, keypoints of which many share a pixel, most photos without any."""
    rnd = random.Random(seed)
    big = 1 << 60  # beyond what a double holds
    cloud = [(f"p{i}", rnd.uniform(0, 11), rnd.uniform(0, 11), rnd.uniform(0, 3)) for i in range(points)]
    cams = [(i, 5.0 + i % 3, 5.0, rnd.randrange(360), 160, 120) for i in range(photos)]
    kps = [(rnd.randrange(max(1, photos // 4)), big + j, float(rnd.randrange(160)), rnd.randrange(1200) / 10, f"d{j}") for j in range(keys)]
    kps += [(i, j + 7, u, v, "again") for i, j, u, v, _ in kps[:keys // 4]]  # copies with higher ids
    return cloud, cams, kps


def brute(cloud, cams, kps):
    by = {}
    for i, j, u, v, _ in kps:
        by.setdefault(i, []).append((u, v, j))
    out = {}
    for p, x, y, z in cloud:
        best = None
        for i, cx, cy, deg, w, h in cams:
            a, ex, ey = math.radians(deg), x - cx, y - cy
            right, depth = ex * math.cos(a) - ey * math.sin(a), ex * math.sin(a) + ey * math.cos(a)
            if not (math.hypot(ex, ey) < 12 and 0.4 < depth < 18):
                continue
            f = max(w, h) * 0.85
            pu, pv = f * right / depth + w / 2, f * (1.55 - z) / depth + h / 2
            if not (0 <= pu < w and 0 <= pv < h):
                continue
            for u, v, j in by.get(i, ()):
                e = round(math.hypot(pu - u, pv - v), 9)
                if e <= 6 and (best is None or (e, i, j) < best):
                    best = (e, i, j)
        if best:
            out[p] = best
    return out


def frames(spark, cloud, cams, kps):
    return spark.createDataFrame(cloud, CLOUD), spark.createDataFrame(cams, PHOTOS), spark.createDataFrame(kps, KEYS)


@pytest.mark.parametrize("seed,points,photos,keys", [(1, 300, 40, 6000), (2, 200, 12, 60)])
def test_as_brute_force(spark, monkeypatch, seed, points, photos, keys):
    monkeypatch.setattr(L, "SLICE_POINTS", 20)
    monkeypatch.setattr(L, "MATCH_PAIRS", 50)
    reach, hits = [], L._pixel_hits
    monkeypatch.setattr(L, "_pixel_hits", lambda v, k, r: reach.append(r) or hits(v, k, r))
    cloud, cams, kps = table(seed, points, photos, keys)
    got = L.nearest_landmark_keypoint(*frames(spark, cloud, cams, kps)).collect()
    want = brute(cloud, cams, kps)
    assert {r["point_id"]: (r["image_id"], r["kp_idx"]) for r in got} == {p: b[1:] for p, b in want.items()} and len(got) == len(want)
    assert all(abs(r["px_err"] - want[r["point_id"]][0]) < 2e-9 for r in got)
    assert reach[-1] == L.MATCH_PX and (reach[0] < 3) == (keys > 1000)


def test_odd_rows(spark):
    cloud, cams, kps = table(3, 60, 8, 400)
    want = brute(cloud, cams, kps)
    cloud += [(None, 5.0, 7.0, 1.5), (None, 5.2, 7.0, 1.4), ("far", 1e6, 1e6, 0.0), ("none", None, 1.0, 1.0)]
    cams += [(None, 5.0, 5.0, 0, 640, 480), (900, None, 5.0, 0, 640, 480)]
    kps += [(0, 1, None, 5.0, "n"), (0, 2, float("nan"), 5.0, "n"), (0, 3, float("inf"), 5.0, "n"), (None, 4, 5.0, 5.0, "n"), (900, 5, 5.0, 5.0, "n")]
    got = L.nearest_landmark_keypoint(*frames(spark, cloud, cams, kps)).collect()
    assert {r["point_id"]: (r["image_id"], r["kp_idx"]) for r in got if r["point_id"]} == {p: b[1:] for p, b in want.items()}
    assert sum(r["point_id"] is None for r in got) <= 1  # points without an id are one, in all rounds together


def test_crowded_cell_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(L, "SLICE_POINTS", 10)
    points, photos, _ = frames(spark, *table(4, 400, 5, 1))
    plan = L._views(points, photos)
    assert plan.rdd.glom().map(len).filter(lambda n: n > 0).count() > 1


def test_nothing_to_match(spark):
    none = spark.createDataFrame([], KEYS)
    points, photos, _ = frames(spark, *table(5, 20, 3, 1))
    assert L.nearest_landmark_keypoint(points, photos, none).count() == 0
    with pytest.raises(ValueError):
        L.build_map_from_cloud(points, photos, none)


def test_map_is_searched_once(spark):
    cloud, cams, kps = table(6, 150, 8, 3000)
    out = L.build_map_from_cloud(*frames(spark, cloud, cams, kps), least=5)
    assert "Join" not in out._jdf.queryExecution().toString()  # counting its rows ran the search a second time
    desc = {(i, j): d for i, j, _, _, d in reversed(kps)}
    want = brute(cloud, cams, kps)
    assert {r["point_id"] for r in out.collect()} == set(want)
