"""Hand-made cases and brute-force comparisons."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from waygrid.functions import capture, floors, geometry as G, registry, vectors as V
from waygrid.operators import colour, corridors, guidance, landmarks as L, network as N, ordered, retrieval as R, routing, steps, survey, trajectory
from waygrid.streaming import drift, machines as M


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


# ------------------------------------------------------------------ similarity search
@pytest.fixture(scope="module")
def images(spark):
    rnd = random.Random(7)
    rows = [(i, i % 5 if i % 3 else 0, [rnd.gauss(0, 1) + (i % 5) for _ in range(8)], "G" if i % 2 else "B1", (i * 37) % 360) for i in range(120)]
    return spark.createDataFrame(rows, "image_id long, location_id int, embedding array<double>, floor string, orientation int")


def cosines(images):
    data = {r["image_id"]: r["embedding"] for r in images.collect()}
    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v in data.items()}
    return {a: sorted(((round(sum(x * y for x, y in zip(unit[a], unit[b])), 9), -b) for b in unit if b != a), reverse=True) for a in unit}


def test_topk_blocks_equal_brute_force(images):
    want = cosines(images)
    for block in (16, 4096):
        got = {}
        for r in R.leave_one_out_topk(images, 4, block_rows=block).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = r["candidate_id"]
        assert {q: [d[k] for k in (1, 2, 3, 4)] for q, d in got.items()} == {q: [-b for _, b in w[:4]] for q, w in want.items()}


def test_topk_within_groups(images):
    got = R.leave_one_out_topk(images, 3, by=["floor"], block_rows=16).collect()
    side = {r["image_id"]: r["floor"] for r in images.collect()}
    assert all(side[r["query_id"]] == side[r["candidate_id"]] == r["floor"] for r in got)
    assert len(got) == 360


def test_ranking_scan_equals_brute_force(images):
    place = {r["image_id"]: r["location_id"] for r in images.collect()}
    want = {}
    for q, ranked in cosines(images).items():
        hits, prec, first = 0, [], None
        for k, (_, b) in enumerate(ranked, 1):
            if place[-b] == place[q]:
                hits += 1
                first = first or k
                prec.append(hits / k)
        want[q] = (first, round(sum(prec) / len(prec), 9))
    for budget in (1, 16_000_000):
        got = {r["query_id"]: (r["first_rank"], round(r["average_precision"], 9)) for r in R.ranking_scan(images, block_rows=32, cell_budget=budget).collect()}
        assert got == want


def test_late_fusion_and_constant_rows(spark):
    rows = [(i, [1.0, 0.0], [float(i), 1.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "image_id long, a array<double>, b array<double>")
    stats = {r["query_id"]: r["std"] for r in R.row_statistics(df, "a").collect()}
    assert all(abs(s) < 1e-9 for s in stats.values())
    assert R.late_fusion(df, "a", "b", 2).count() == 10


def test_descriptor_fusion_norms(spark):
    ok = V.fuse_descriptors(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(1.0), F.lit(0.0)))
    assert one(spark, V.norm(ok)) == pytest.approx(1.0)
    assert one(spark, V.fuse_descriptors(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert one(spark, V.fuse_descriptors(F.array(F.lit(float("nan"))), F.array(F.lit(1.0)))) is None


def test_blocked_search_recall(images):
    exact = R.leave_one_out_topk(images, 4)
    found = R.topk_similar_blocked(images, images, 4, bands=8, bits=1, exclude_self=True)
    assert R.recall_against(found, exact).first()["recall"] > 0.9


# ------------------------------------------------------------------ ordered work, whole and sliced
def track(spark, n=40):
    rows = [(d, d * 100 + i, float(i), "b_fix" if i % 9 == 4 else "a_pose", i % 2 == 0 or i % 9 != 4, float(i), 0.5 * i, (i * 31.0) % 360, "G", 0.7) for d in range(3) for i in range(n)]
    return spark.createDataFrame(rows, "device_id long, event_id long, t double, kind string, matched boolean, x double, y double, heading double, floor string, confidence double")


def same(a, b, cols):
    pick = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.select(*cols).collect())
    assert pick(a) == pick(b)


def hot(spark, n=900):
    """One device owns half of the rows; times tie, and one device has no id."""
    rng = random.Random(5)
    rows = []
    for e in range(n):
        fix = rng.random() < 0.1
        rows.append((1 if e % 2 else rng.choice([2, 3, 4, None]), e, float(rng.randrange(200)), "b_fix" if fix else "a_pose", rng.random() < .7,
                     rng.uniform(0, 9), rng.uniform(0, 9), rng.uniform(0, 360), rng.choice(["G", "B1"]), rng.random()))
    return spark.createDataFrame(rows, "device_id long, event_id long, t double, kind string, matched boolean, x double, y double, heading double, floor string, confidence double")


def plain_rows(df, by):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: tuple((v is not None, v) for v in map(r.get, by)))


@pytest.mark.parametrize("parts", [None, 1, 13])
def test_scan_equals_plain_loops(spark, parts):
    df, order = hot(spark), ["t", "kind", "event_id"]
    fix = (F.col("kind") == "b_fix") & F.col("matched")
    got = ordered.scan(df, ["device_id"], order, {"s": F.when(F.col("kind") == "a_pose", F.col("event_id")).otherwise(F.lit(0))},
                       {"at": (F.when(F.col("floor") == "G", F.col("x")), fix)}, {"to": (F.col("y"), fix)}, ["event_id", "floor"], parts)
    got = {r["event_id"]: r.asDict() for r in got.collect()}
    rows, seen = plain_rows(df, ["device_id", *order]), 0
    for d in {r["device_id"] for r in rows}:
        mine, total, at, before = [r for r in rows if r["device_id"] == d], 0, None, {}
        is_fix = [r["kind"] == "b_fix" and r["matched"] for r in mine]
        for i, r in enumerate(mine):
            total += r["event_id"] if r["kind"] == "a_pose" else 0
            at = (r["x"] if r["floor"] == "G" else None) if is_fix[i] else at
            to = next((q["y"] for q, f in zip(mine[i:], is_fix[i:]) if f), None)
            g = got[r["event_id"]]
            assert (g["s"], g["at"], g["to"], g["prev_event_id"], g["prev_floor"]) == (total, at, to, before.get("event_id"), before.get("floor"))
            before, seen = r, seen + 1
    assert seen == len(got) == 900 and "_part" not in got[0]


def test_partitions_do_not_change_operators(spark):
    df = hot(spark).where("device_id IS NOT NULL")
    steps = df.withColumns({"is_fix": F.col("kind") == "b_fix", "is_step": F.col("kind") == "a_pose", "step_m": F.lit(0.7)})
    frames = df.where("event_id % 3 = 0").select(F.col("device_id").alias("session_id"), F.col("event_id").alias("frame_id"), F.col("t").alias("frame_t"), "x")
    tags = df.select(F.col("device_id").alias("session_id"), F.col("event_id").alias("tag_id"), (F.col("t") + 0.5 * (F.col("event_id") % 2)).alias("tag_t"))
    for run, cols in (
        (lambda p: trajectory.fuse_positions(df, parts=p), ["event_id", "fused_x", "fused_y", "fused_confidence", "fused_floor"]),
        (lambda p: trajectory.steps_since_fix(steps, parts=p).fillna(-1.0), ["event_id", "steps_since_fix", "drift_m"]),
        (lambda p: trajectory.infer_walking_offset(steps, parts=p).fillna(-1.0), ["event_id", "steps", "path_m", "fix_m", "offset_deg"]),
        (lambda p: trajectory.device_sessions(df, 3.0, parts=p), ["device_id", "session_no", "start_t", "end_t", "events"]),
        (lambda p: L.nearest_in_time(tags, frames, parts=p), ["session_id", "tag_id", "dt", "frame_id", "x"]),
    ):
        same(run(1), run(11), cols)


def test_nearest_in_time_against_all_frames(spark):
    df = hot(spark, 300)
    frames = df.where("event_id % 5 = 0").select("device_id", F.col("event_id").alias("frame_id"), F.col("t").alias("frame_t"))
    tags = df.where("event_id % 5 = 1").select("device_id", F.col("event_id").alias("tag_id"), (F.col("t") + 0.5 * (F.col("event_id") % 2)).alias("tag_t"))
    fs = [tuple(r) for r in frames.collect()]
    want = sorted((i, min(((abs(ft - t), f) for k, f, ft in fs if k == d), default=(None, None))) for d, i, t in tags.collect())
    got = sorted((r.tag_id, (r.dt, r.frame_id)) for r in L.nearest_in_time(tags, frames, ["device_id"], 7).collect())
    assert got == want
    over_all = L.nearest_in_time(tags.drop("device_id"), frames.drop("device_id"), [], 5).collect()
    assert all((r.dt, r.frame_id) == min((abs(ft - r.tag_t), f) for _, f, ft in fs) for r in over_all) and len(over_all) == 60


@pytest.mark.parametrize("parts", [1, 9])
def test_folds_over_partitions(spark, parts):
    def step(state, row):  # remembers a little, and forgets it at every fix
        if row["kind"] == "b_fix" and row["matched"]:
            state.clear()
        state["n"] = state.get("n", 0) + 1
        state["last"] = row["x"]
        return [{"event_id": row["event_id"], "n": state["n"], "device_id": row["device_id"]}] * (row["event_id"] % 3)
    df, order = hot(spark), ["t", "kind", "event_id"]
    got = sorted((r.event_id, r.n, str(r.device_id)) for r in ordered.fold_ordered(df, ["device_id"], order, step, "event_id long, n long, device_id long", parts=parts).collect())
    want, states = [], {}
    for r in plain_rows(df, ["device_id", *order]):
        want += [(o["event_id"], o["n"], str(o["device_id"])) for o in step(states.setdefault(r["device_id"], {}), r)]
    assert got == sorted(want) and len(got) > 500


def test_folds_and_long_memories(spark):
    df = track(spark)
    run = lambda p: ordered.fold_ordered(df, ["device_id"], ["t", "kind", "event_id"], M.smooth_fix, M.SMOOTH_SCHEMA, parts=p)
    same(run(1), run(7), ["event_id", "x", "y", "confidence", "doubt"])
    route = F.expr("array(struct(0e0 AS x, 0e0 AS y), struct(10e0 AS x, 0e0 AS y), struct(10e0 AS x, 20e0 AS y))")
    d = df.withColumns({"route": route, "t": F.col("t") * 500})
    run = lambda p: ordered.fold_ordered(d, ["device_id"], ["t", "event_id"], drift.detect_drift, drift.DRIFT_SCHEMA, parts=p)
    same(run(1), run(7), ["event_id", "state", "reroute"])


def test_numbers_over_partitions(spark):
    df = hot(spark)
    a, b = (ordered.numbered(df, ["device_id"], [F.col("t"), F.col("event_id")], "n", parts=p) for p in (1, 17))
    same(a, b, ["event_id", "n"])
    every = ordered.numbered(df, [], [F.col("t").desc(), F.col("event_id")], "n", parts=9)
    assert [r["n"] for r in every.orderBy(F.desc("t"), "event_id").collect()] == list(range(1, 901))


@pytest.mark.parametrize("start", [None, 9.81])
def test_averages_as_composed_maps(spark, start):
    df = hot(spark, 1400)
    got = ordered.ewma(df, ["device_id"], ["t", "event_id"], {"g": F.col("x"), "h": F.col("y")}, 0.92, None if start is None else {"g": F.lit(start), "h": F.lit(0.0)}, parts=5)
    got = {r.event_id: (r.g, r.h) for r in got.collect()}
    g = {}
    for r in plain_rows(df, ["device_id", "t", "event_id"]):
        before = g.get(r["device_id"], None if start is None else (start, 0.0))
        now = (r["x"], r["y"]) if before is None else (0.92 * before[0] + 0.08 * r["x"], 0.92 * before[1] + 0.08 * r["y"])
        g[r["device_id"]] = now
        assert got[r["event_id"]] == pytest.approx(now, rel=1e-12)
    assert len(got) == 1400


# ------------------------------------------------------------------ geometry
def test_affine_recovery_and_inverse(spark):
    rows = [("p", float(x), float(y), 0.02 * x + 0.001 * y + 3, 0.0005 * x - 0.019 * y + 40) for x, y in ((0, 0), (900, 0), (0, 700), (500, 300))]
    pts = spark.createDataFrame(rows, "plan string, px double, py double, x double, y double")
    fit = survey.fit_affine(pts, ["plan"])
    r = fit.first()
    assert (r["a"], r["d"], r["tx"]) == pytest.approx((0.02, -0.019, 3.0), abs=1e-9)
    back = survey.overlay_pixels(pts.select("plan", "x", "y", F.col("px").alias("px0")), fit, ["plan"])
    assert all(abs(b["px"] - b["px0"]) < 1e-6 for b in back.collect())
    assert survey.fit_affine(pts.limit(2), ["plan"]).count() == 0
    collinear = spark.createDataFrame([("p", float(i), 2.0 * i, 1.0, 1.0) for i in range(4)], "plan string, px double, py double, x double, y double")
    assert survey.fit_affine(collinear, ["plan"]).count() == 0


def test_band_keeps_inside_pulls_outside_and_takes_points(spark):
    l, r = G.side_widths(F.lit(8.0))
    place = lambda x, y, x2=10.0: one(spark, G.band_place(F.lit(x), F.lit(y), F.lit(0.0), F.lit(0.0), F.lit(x2), F.lit(0.0), l, r))
    assert (place(5.0, 3.0)["bx"], place(5.0, 3.0)["by"], place(5.0, 3.0)["outside"]) == (5.0, 3.0, 0.0)
    assert place(5.0, 6.0)["by"] == pytest.approx(4.0) and place(5.0, 6.0)["outside"] == pytest.approx(2.0)
    assert place(0.0, 6.0, 0.0)["by"] == pytest.approx(4.0)
    l, r = G.side_widths(None, F.lit(1.0), F.lit(5.0))
    assert one(spark, G.band_place(F.lit(5.0), F.lit(3.0), F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(0.0), l, r))["by"] == pytest.approx(1.0)


def test_floor_levels(spark):
    got = {f: one(spark, floors.floor_level(F.lit(f))) for f in ("B2", "G", "L1", "Level 3", "Roof", "0", " b1 ")}
    assert got == {"B2": -2, "G": 0, "L1": 1, "Level 3": 3, "Roof": None, "0": 0, " b1 ": -1}


def test_nearest_piece_equals_brute_force(spark):
    rnd = random.Random(3)
    seg = [("G", i, rnd.uniform(0, 200), rnd.uniform(0, 200)) for i in range(40)]
    segs = spark.createDataFrame([(f, i, x, y, x + rnd.uniform(-30, 30), y + rnd.uniform(-30, 30), rnd.uniform(1, 9)) for f, i, x, y in seg],
                                 "floor string, seg_ord int, x1 double, y1 double, x2 double, y2 double, width double")
    pts = spark.createDataFrame([("G" if i % 9 else "X", i, rnd.uniform(-150, 400), rnd.uniform(-150, 400), float(i % 360)) for i in range(150)],
                                "floor string, pid int, x double, y double, heading double")
    got = {r["pid"]: r["match_cost"] for r in corridors.match_corridor(pts, segs, cell_m=4.0).collect()}
    all_seg = [r.asDict() for r in segs.collect()]
    for p in pts.collect():
        if p["floor"] == "X":
            assert got[p["pid"]] is None
            continue
        best = math.inf
        for s in all_seg:
            ln = math.hypot(s["x2"] - s["x1"], s["y2"] - s["y1"])
            piece = {**s, "len": ln, "ux": (s["x2"] - s["x1"]) / ln, "uy": (s["y2"] - s["y1"]) / ln, "left": s["width"] / 2, "right": s["width"] / 2}
            best = min(best, corridors.corridor_cost(p["x"], p["y"], p["heading"], piece))
        assert got[p["pid"]] == pytest.approx(best, abs=1e-6)


def test_sticky_corridor_does_not_flip(spark):
    segs = spark.createDataFrame([("G", 0, 0.0, 0.0, 50.0, 0.0, 3.0), ("G", 1, 0.0, 4.0, 50.0, 4.0, 3.0)],
                                 "floor string, seg_ord int, x1 double, y1 double, x2 double, y2 double, width double")
    ys = [0.0, 2.1, 1.9, 2.2, 3.9, 4.0]
    fixes = spark.createDataFrame([(1, i, float(i), "G", 10.0 + i, y, 90.0) for i, y in enumerate(ys)],
                                  "device_id long, event_id long, t double, floor string, x double, y double, heading double")
    keys = [r["seg_key"] for r in corridors.sticky_corridor(fixes, segs).orderBy("event_id").collect()]
    assert len(set(keys[:4])) == 1 and keys[-1] != keys[0]


# ------------------------------------------------------------------ network and routes
SEG = "site_id long, floor string, seg_no int, x1 double, y1 double, x2 double, y2 double"


def build(spark, segments, landings=()):
    pieces = N.split_at_junctions(spark.createDataFrame(segments, SEG))
    resolved = routing.resolved_pieces(pieces, N.snap_nodes(N.piece_ends(pieces)))
    lands = spark.createDataFrame(list(landings), "site_id long, connector_id string, floor string, rank int, x double, y double, penalty_cost double")
    doors = N.landing_splice(lands, resolved)
    return resolved, routing.network_edges(resolved, doors, N.vertical_edges(doors))


def ask(spark, net, start, dest):
    req = spark.createDataFrame([(1, 1, *start, *dest)], "request_id long, site_id long, start_floor string, start_x double, start_y double, dest_floor string, dest_x double, dest_y double")
    return routing.route_requests(req, *net)


def bent_rows(seed, n=4):
    """A street of ``n`` pieces whose ends miss each other by centimetres, with a side street at each joint, and their lengths."""
    rng = random.Random(seed)
    off = lambda: rng.uniform(-0.07, 0.07)
    segs, xs = [], [0.0]
    for i in range(n):
        xs.append(xs[-1] + rng.uniform(4, 9))
        segs.append((1, "G", 2 * i, xs[i] + off(), off(), xs[i + 1] + off(), off()))
        segs.append((1, "G", 2 * i + 1, xs[i + 1] + off(), off(), xs[i + 1] + off(), 3.0 + i))
    return segs, xs


@pytest.mark.parametrize("seed", [3, 8])
def test_routes_over_jittered_streets(spark, seed):
    segs, xs = bent_rows(seed)
    net = build(spark, segs)
    asked = [((xs[i] + 0.3 * (xs[i + 1] - xs[i]), 0.4), j) for i in range(3) for j in range(i, 4)]
    req = spark.createDataFrame([(k, 1, "G", *at, "G", xs[j + 1], 3.0 + j) for k, (at, j) in enumerate(asked)],
                                "request_id long, site_id long, start_floor string, start_x double, start_y double, dest_floor string, dest_x double, dest_y double")
    got = {r["request_id"]: r["network_m"] for r in routing.route_requests(req, *net)[0].collect()}
    for k, ((x, _), j) in enumerate(asked):
        assert got[k] == pytest.approx(xs[j + 1] - x + 3.0 + j, abs=0.5), (k, got)  # along the street, then up the side street


def test_a_gap_too_wide_parts_the_network(spark):
    segs, xs = bent_rows(5)
    cut = [s for s in segs if s[2] != 2] + [(1, "G", 2, xs[1] + 0.75, 0.0, xs[2], 0.0)]
    assert ask(spark, build(spark, segs), ("G", 0.0, 0.0), ("G", xs[3], 0.0))[0].first()["network_m"] == pytest.approx(xs[3], abs=0.5)
    assert ask(spark, build(spark, cut), ("G", 0.0, 0.0), ("G", xs[3], 0.0))[0].first()["network_m"] is None


def test_both_ends_on_one_piece(spark):
    rng = random.Random(1)
    for _ in range(2):
        a, b = sorted(rng.uniform(-15, 15) for _ in "ab")
        net = build(spark, [(1, "G", 0, -17.5, 2.0, 16.25, 2.0)])
        assert ask(spark, net, ("G", b, 2.0), ("G", a, 2.0))[0].first()["total_distance"] == pytest.approx(b - a, abs=2e-3)  # places are kept to the millimetre


def test_junctions_are_cut(spark):
    t = N.split_at_junctions(spark.createDataFrame([(1, "G", 0, 0.0, 0.0, 10.0, 0.0), (1, "G", 1, 4.0, 0.05, 4.0, 8.0), (1, "G", 2, 7.0, -3.0, 7.0, 3.0)], SEG))
    per = {r["seg_no"]: r["count"] for r in t.groupBy("seg_no").count().collect()}
    assert per == {0: 3, 1: 1, 2: 2}


def test_two_floors_and_one_ride(spark):
    segs = [(1, f, i, 0.0, 0.0, 10.0, 0.0) for i, f in enumerate(("G", "B1", "B2"))]
    lift = [(1, "lift", f, r, 10.0, 0.0, 12.0) for r, f in enumerate(("B2", "B1", "G"))]
    net = build(spark, segs, lift)
    routes, dist = ask(spark, net, ("G", 0.0, 0.0), ("B2", 0.0, 0.0))
    assert routes.first()["total_distance"] == pytest.approx(10 + 12 + 1 + 10)
    kinds = spark.createDataFrame([("lift", "elevator")], "connector_id string, type string")
    legs = routing.route_legs(routes, routing.route_paths(routes, dist), net[1], kinds).orderBy("leg").collect()
    assert [l["instruction"] for l in legs] == ["Walk to lift", "Take Elevator (lift) to Floor B2", "Follow path to destination"]
    assert sum(l["distance"] for l in legs) == pytest.approx(33.0)


def test_greedy_snapping_matches_a_sequential_registry(spark):
    rnd = random.Random(11)
    pts = [(round(rnd.uniform(0, 3), 2), round(rnd.uniform(0, 3), 2)) for _ in range(120)]
    ends = spark.createDataFrame([(1, "G", i, 0, 0, x, y) for i, (x, y) in enumerate(pts)], "site_id long, floor string, seg_no int, piece_no int, end int, x double, y double")
    ends = ends.withColumn("ordinal", F.struct(F.col("seg_no").cast("long").alias("s"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("e")))
    nodes, want = [], {}
    for i, (x, y) in enumerate(pts):
        hit = next((n for n in nodes if math.hypot(n[0] - x, n[1] - y) <= 0.3), None)
        if hit is None:
            hit = (round(x, 3), round(y, 3))
            nodes.append(hit)
        want[i] = hit
    got = {r["seg_no"]: (r["node_x"], r["node_y"]) for r in N.snap_nodes(ends).collect()}
    assert got == want


# ------------------------------------------------------------------ guidance
def line(*pts):
    return F.array(*[guidance.pt(F.lit(float(x)), F.lit(float(y))) for x, y in pts])


def test_lanes_and_joins(spark):
    lane = lambda p, x, y: one(spark, guidance.lane_walkway(p, F.lit(float(x)), F.lit(float(y))))
    corner = line((0, 0), (10, 0), (10, 10))
    r = lane(corner, 0, 2)
    assert r["mode"] == "direct" and [(p["x"], p["y"]) for p in r["points"]] == [(0, 2), (10, 2), (10, 10)]
    assert lane(line((0, 0), (10, 0)), 0, 2)["mode"] == "end"
    assert lane(corner, 0, 0.2)["mode"] == "none"
    assert lane(line((0, 0), (10, 0), (17, 7)), 0, 2)["mode"] == "L"
    j = one(spark, guidance.join_walkway(line((0, 0), (20, 0)), F.lit(0.0), F.lit(2.0)))
    assert (j["points"][1]["x"], j["added"]) == (4.0, pytest.approx(math.hypot(4, 2) - 4))


def test_progress_rejoin_and_arrival(spark):
    p = line((0, 0), (10, 0), (10, 10))
    g = one(spark, guidance.route_progress(p, F.lit(12.0), F.lit(4.0)))
    assert (g["along"], g["remaining"], g["off"]) == (14.0, 6.0, 2.0)
    assert [(q["x"], q["y"]) for q in one(spark, guidance.clamp_to_dest(line((0, 0), (20, 0), (20, 5)), F.lit(20.0), F.lit(5.0)))] == [(0, 0), (20, 0)]
    assert [(q["x"], q["y"]) for q in one(spark, guidance.rejoin_waypoints(line((0, 0), (10, 0)), F.lit(4.0), F.lit(2.0)))] == [(4, 2), (8, 0), (10, 0)]
    spur = line((0, 0), (10, 0), (10, 6))
    flag = lambda x, y, rem: one(spark, guidance.arrival_flag(spur, F.lit(x), F.lit(y), F.lit(rem)))
    assert flag(9.5, 1.0, 6.5) and not flag(5.0, 0.0, 11.0)


# ------------------------------------------------------------------ maps, registries, state machines
def test_prune_and_export_rules(spark):
    l = spark.createDataFrame([(1, 0.0, 0.0, 0.0, "G", -1, "d"), (2, 1.0, 1.0, 0.0, "G", 2, "d"), (3, 9.0, 9.0, 0.0, "B1", 3, "d"), (4, 1.0, 1.0, 0.0, "G", 2, None)],
                              "landmark_id long, x double, y double, z double, floor string, session_id long, descriptor string")
    kept, gone = L.prune_landmarks(l, "G", None, (0.5, 0.5, 5, 5))
    assert ({r[0] for r in kept.select("landmark_id").collect()}, {r[0] for r in gone.select("landmark_id").collect()}) == ({1, 3}, {2, 4})
    with pytest.raises(ValueError):
        L.prune_landmarks(l)
    al = spark.createDataFrame([(2,)], "session_id long")
    assert {r[0] for r in L.exportable_landmarks(l, al).select("landmark_id").collect()} == {1, 2}
    assert {r[0] for r in L.exportable_landmarks(l, al.limit(0)).select("landmark_id").collect()} == {1, 2, 3}


def test_orphan_tags_find_their_session(spark):
    tags = spark.createDataFrame([(1, 0, 100.0), (2, 1, 180.0)], "tag_id long, session_id long, tag_t double")
    frames = spark.createDataFrame([(1, 1, 110.0), (2, 1, 140.0), (3, 1, 175.0)], "frame_id long, session_id long, frame_t double")
    none = spark.createDataFrame([], "session_id long")
    assert {r["tag_id"]: r["session_id"] for r in L.reattach_orphan_tags(tags, frames, none).collect()} == {1: 1, 2: 1}
    assert {r["tag_id"]: r["session_id"] for r in L.reattach_orphan_tags(tags, frames, none, 5.0).collect()} == {1: 0, 2: 1}


def test_session_alignment_moves_landmarks(spark):
    anchors = spark.createDataFrame([(7, 1, 0.0, 0.0, 100.0, 50.0), (7, 2, 10.0, 0.0, 100.0, 70.0)], "session_id long, tag_id long, map_x double, map_z double, facility_x double, facility_y double")
    lm = spark.createDataFrame([(1, 7, 5.0, 1.5, 0.0), (2, 7, 5.0, 9.0, 0.0)], "landmark_id long, session_id long, x double, y double, z double")
    moved = L.align_sessions(lm, L.session_pieces(anchors))
    r = moved.where("landmark_id = 1").first()
    assert (r["x"], r["y"], r["z"]) == pytest.approx((100.0, 60.0, 1.5))
    assert [q["landmark_id"] for q in L.drop_far_landmarks(moved, anchors).collect()] == [1]


def test_registry_names_and_isolation():
    reg = registry.Registry("scorer")
    reg.register("good", lambda: 1)
    reg.register("broken", lambda: 1 / 0)
    good, bad = reg.available()
    assert good == {"good": 1} and "broken" in bad
    with pytest.raises(KeyError, match="broken, good"):
        reg.get("other")


def motion(rng, n, device=1, turns=0.004):
    """Samples with swings of changing height and rhythm, pauses, and turns of the phone."""
    rows, t = [], 0.0
    for i in range(n):
        t += rng.choice([10, 20, 50, 50, 50, 120]) if rng.random() < 0.97 else 1500
        swing = math.sin(i * rng.choice([.3, .31, .5])) * rng.choice([1, 3, 6]) + rng.gauss(0, .8)
        rows.append((device, device * 10_000 + i, t, rng.gauss(0, .3), rng.gauss(0, .3), 9.81 + swing, None if rng.random() < .1 else 200.0 if rng.random() < turns else 20.0))
    return rows


@pytest.mark.parametrize("name", ["pdr_steps", "gait_steps"])
def test_step_detectors_against_a_walk_through_the_samples(spark, name):
    from waygrid.plans import catalog, q_machines
    rng = random.Random(6)
    rows = motion(rng, 1500) + motion(rng, 300, 2) + motion(rng, 40, 3, 0.2) + [(4, 1, 0.0, 0.0, 0.0, 9.8, 0.0), (5, 1, 0.0, 0.0, 0.0, 0.0, 0.0), (5, 2, 50.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "device_id long, event_id long, t double, ax double, ay double, az double, rot double")
    con = duckdb.connect()
    con.register("given", df.toPandas())
    con.execute("CREATE TABLE s AS SELECT * REPLACE (coalesce(rot, 0) AS rot) FROM given")
    own = q_machines.SAMPLES[q_machines.SAMPLES.index("o AS"):]
    want = con.execute(catalog.oracle_sql()[name].replace(q_machines.SAMPLES, own)).fetchall()
    for parts in (None, 6):
        got = getattr(steps, name)(df, parts).select("device_id", "t", "step_no", "stride_m").collect()
        assert sorted((d, k, t, round(m, 6)) for d, t, k, m in got) == sorted((d, k, t, m) for d, t, k, m in want)
    assert len(want) > 12 and getattr(steps, name)(df.limit(0)).count() == 0


def test_strides_are_scaled_by_the_sample(spark):
    df = spark.createDataFrame(motion(random.Random(2), 400), "device_id long, event_id long, t double, ax double, ay double, az double, rot double")
    one_, two = (steps.pdr_steps(df.withColumn("scale", F.lit(k))).agg(F.sum("stride_m")).first()[0] for k in (1.0, 1.5))
    assert two == pytest.approx(1.5 * one_)


def test_orbit_follows_successors(spark):
    rng, rows, want = random.Random(9), [], []
    for d in (1, 2, None):
        to = 0
        nxt = {}
        for no in range(1, 200):  # never falls, sometimes far ahead, sometimes level for long
            to = max(to, no + 1, to + rng.choice([0, 0, 1, 6]))
            nxt[no] = to if to < 200 else None
        rows += [(d, no, t) for no, t in nxt.items()]
        at = 1
        while at:
            want.append((str(d), at))
            at = nxt[at]
    df = spark.createDataFrame(rows, "device_id long, no long, nxt long")
    got = sorted((str(r.device_id), r.no) for r in steps.orbit(df, ["device_id"], 5).collect())
    assert got == sorted(want) and len(want) < 500


def drift_kinds(points, route=((0, 0), (20, 0), (20, 20))):
    state, out = {}, []
    for i, (x, y) in enumerate(points):
        got = drift.detect_drift(state, {"device_id": 1, "event_id": i, "t": i * 500.0, "x": float(x), "y": float(y), "route": [{"x": a, "y": b} for a, b in route]})
        out.append((got["kind"], got["reroute"]))
    return out


def test_drift_kinds():
    on = drift_kinds([(i * 0.5, 0.2) for i in range(30)])
    assert all(k is None and not r for k, r in on)
    past = drift_kinds([(i * 0.5, 0.1) for i in range(60)])
    assert ("overshoot", True) in past
    side = drift_kinds([(i * 0.4, 0.0) for i in range(12)] + [(4.4 + i * 0.1, i * 0.5) for i in range(16)])
    assert any(r and k in ("early_turn", "off_route") for k, r in side)
    end = drift_kinds([(i * 0.5, 0.0) for i in range(50)], ((0, 0), (20, 0)))
    assert any(r and k == "passed_destination" for k, r in end)


def test_grey_image_quality(spark):
    px = [(1, x, y, 255 if x >= 60 else 0) for x in range(120) for y in range(80)]
    q = colour.image_quality(spark.createDataFrame(px, "image_id int, px int, py int, gray int")).first()
    assert (q["width"], q["height"], q["brightness_mean"]) == (120, 80, 127.5) and q["laplacian_variance"] > 0


def test_parking_links(spark):
    r = one(spark, capture.parse_parking_link(F.lit("https://x.org/?slot=86-03c&kiosk=k2")))
    assert (r["slot"], r["kiosk"]) == ("86-03C", "K2")
    assert one(spark, capture.parse_parking_link(F.lit("hello"))) is None
