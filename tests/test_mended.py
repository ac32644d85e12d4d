import json
import random

import pytest
from pyspark.sql import functions as F

from waygrid.operators import colour, corridors, evaluation
from waygrid.operators import network as N
from waygrid.operators import routing
from waygrid.operators.ordered import fold_ordered
from waygrid.plans import catalog
from waygrid.session import cut
from waygrid.sources import files
from waygrid.streaming import machines


def test_every_csv_file_goes_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffpixel_x, pixel_y,real_x,real_y\n1,2,3,4\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("# note\nreal_x,real_y,extra,pixel_x,pixel_y\n7,8,,5, 6\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("pixel_x,real_x\n9,\n", encoding="utf-8")
    got = files.read_csv(spark, str(tmp_path), {c: "double" for c in ("pixel_x", "pixel_y", "real_x", "real_y")}, comment="#")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [(1, 2, 3, 4), (5, 6, 7, 8), (9, None, None, None)]


def test_site_without_references(spark):
    hist, sat = [1 / 36] * 36, [0.25] * 4
    sig = spark.createDataFrame([(1, 1, 0.5, hist, sat), (2, 9, 0.5, hist, sat)], "image_id int, site_id int, colour_frac double, hist array<double>, sat_hist array<double>")
    refs = spark.createDataFrame([(1, "G", hist, sat, 0.5)], "site_id int, floor string, hist array<double>, sat_hist array<double>, colour_frac double")
    got = {r.image_id: r for r in colour.classify_colour(sig, refs).collect()}
    assert got[1].floor == "G" and got[2].reason == "no_refs" and got[2].floor is None and got[2].score == 0


def test_votes_grow_old(spark):
    rows = [(1, k, k * 1000.0, 90.0, 0.3) for k in range(3)] + [(2, k, k * 3_600_000.0, 90.0, 0.3) for k in range(3)]
    df = spark.createDataFrame(rows, "device_id bigint, event_id bigint, t double, heading double, yaw double")
    got = fold_ordered(df, ["device_id"], ["t", "event_id"], machines.heading_vote, machines.VOTE_SCHEMA).collect()
    assert [r.device_id for r in got] == [1] and got[0].event_id == 2


def test_lift_rides_repeat(spark):
    leg = [("G", 1.0), ("B1", 9.0), ("G", 9.0), ("G", 1.0), ("B1", 9.0)]
    rows = [(1, k, k * 1000.0, door, floor, "G", "B1", 0.1) for k, (floor, door) in enumerate(leg)]
    # landed by waiting: the floor still reads G, so the door must be left before the next ride
    slow = [(0.0, 1.0, 0.0), (60_000.0, 1.0, 99.0), (61_000.0, 1.0, 0.0), (62_000.0, 30.0, 0.0), (63_000.0, 1.0, 0.0)]
    rows += [(2, k, t, door, "G", "G", "B1", motion) for k, (t, door, motion) in enumerate(slow)]
    df = spark.createDataFrame(rows, "device_id bigint, event_id bigint, t double, door_m double, floor string, from_floor string, to_floor string, motion double")
    got = fold_ordered(df, ["device_id"], ["t", "event_id"], machines.lift_state, machines.LIFT_SCHEMA).collect()
    events = lambda d: [(r.event_id, r.event) for r in sorted(got, key=lambda r: r.event_id) if r.device_id == d]
    assert events(1) == [(0, "enter"), (1, "land"), (3, "enter"), (4, "land")]
    assert events(2) == [(0, "enter"), (1, "auto_land"), (4, "enter")]


def _network(spark, segments, landings):
    pieces = cut(N.split_at_junctions(spark.createDataFrame(segments, "site_id long, floor string, seg_no int, x1 double, y1 double, x2 double, y2 double")))
    resolved = cut(routing.resolved_pieces(pieces, N.snap_nodes(N.piece_ends(pieces))))
    lands = spark.createDataFrame(landings, "site_id long, connector_id string, floor string, rank int, x double, y double, penalty_cost double")
    doors = cut(N.landing_splice(lands, resolved))
    return resolved, doors, cut(routing.network_edges(resolved, doors, N.vertical_edges(doors)))


def _total(spark, resolved, edges, start, dest):
    req = spark.createDataFrame([(1, 1, *start, *dest)], "request_id long, site_id long, start_floor string, start_x double, start_y double, dest_floor string, dest_x double, dest_y double")
    return routing.route_requests(req, resolved, edges)[0].first()["total_distance"]


def test_doors_hang_on_the_nodes_of_their_piece(spark):
    """The door's piece has both drawn ends moved onto earlier nodes: 8 + 5 + 12 + 5 + 8."""
    ends = [(0, 0.0, 10.0), (1, 20.2, 30.0), (2, 10.2, 20.0)]
    segs = [(1, f, n, a, 0.0, b, 0.0) for f in ("G", "B1") for n, a, b in ends]
    resolved, doors, edges = _network(spark, segs, [(1, "lift", f, k, 15.0, 1.0, 12.0) for k, f in enumerate(("B1", "G"))])
    assert {(r.p_x1, r.p_x2, r.door_x) for r in doors.collect()} == {(10.0, 20.2, 15.0)}
    assert _total(spark, resolved, edges, ("G", 2.0, 0.0), ("B1", 2.0, 0.0)) == pytest.approx(38.0)


def test_doors_and_points_take_the_first_node_in_reach(spark):
    """A door 0.2 m past a corner is the corner; two doors 0.1 m apart are one; a floor without walkways has none."""
    segs = [(1, f, 0, 0.0, 0.0, 10.0, 0.0) for f in ("G", "B1")] + [(1, f, 1, 10.0, 0.0, 10.0, 10.0) for f in ("G", "B1")]
    lands = [(1, "a", f, k, 9.8, -0.4, 12.0) for k, f in enumerate(("B1", "G"))]
    lands += [(1, c, f, k, x, 0.0, 12.0) for c, x in (("b", 5.0), ("c", 5.1)) for k, f in enumerate(("B1", "G"))]
    lands += [(1, "a", "B2", 2, 1.0, 1.0, 12.0)]
    resolved, doors, edges = _network(spark, segs, lands)
    at = {(r.connector_id, r.floor): (r.door_x, r.door_y) for r in doors.collect()}
    assert at["a", "G"] == (10.0, 0.0) and at["b", "G"] == at["c", "G"] == (5.0, 0.0) and at["a", "B2"] == (1.0, 1.0)
    assert edges.where("src like '%null%' or dst like '%null%' or weight is null").isEmpty()
    points = spark.createDataFrame([(1, "G", 9.75, 0.0)], "site_id long, floor string, x double, y double")
    got = routing.attach_point(points, resolved, F.lit(True)).first()
    assert (got.at_x, got.at_y) == (10.0, 0.0) and min(e.d for e in got.ends) == 0


def test_heading_consensus_puts_events_nine_seconds_apart(spark, tmp_path):
    rows = [(15 * k, user, f"2024-01-01 {at}") for user, ats in (
        (1, ("00:00:00", "00:00:10", "00:00:20")), (2, ("01:00:00", "01:00:20", "01:00:40")), (3, ("02:00:00", "03:00:00")))
            for k, at in enumerate(ats, 10 * user)]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.queries()["heading_consensus"](spark, str(tmp_path)).collect()
    assert sorted((r.device_id, r.event_id) for r in got) == [(1, 15 * 12), (2, 15 * 22)]


def test_percentiles_over_partitions(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)])) for _ in range(700)] + [("one", 7), ("none", None)]
    df = spark.createDataFrame(rows, "source string, ms int")
    got = {r.source: (r.mean_ms, r.p95_ms, r.max_ms) for r in evaluation.latency_stats(df, "ms", ["source"], parts=6).collect()}
    want = {r.source: (r.m, r.p, r.x) for r in df.groupBy("source").agg(F.avg("ms").alias("m"), F.percentile("ms", 0.95).alias("p"), F.max("ms").alias("x")).collect()}
    assert got.keys() == want.keys() and got["none"] == (None, None, None)
    assert all(got[k] == pytest.approx(want[k]) for k in want if k != "none")
    assert evaluation.latency_stats(df, "ms").first().p95_ms == pytest.approx(df.agg(F.percentile("ms", 0.95)).first()[0])


def test_a_seed_ends_the_memory_of_the_corridor(spark):
    segs = spark.createDataFrame([("G", 0, 0.0, 0.0, 20.0, 0.0, 2.0), ("G", 1, 0.0, 2.2, 20.0, 2.2, 2.0)], "floor string, seg_ord long, x1 double, y1 double, x2 double, y2 double, width double")
    # held in the first corridor, then slightly nearer to the second
    rows = [(1, 0, 0.0, "G", 5.0, 0.0, 90.0, False), (1, 1, 1.0, "G", 6.0, 1.4, 90.0, False), (1, 2, 2.0, "G", 7.0, 9.0, 90.0, True), (1, 3, 3.0, "G", 8.0, 1.4, 90.0, False)]
    df = spark.createDataFrame(rows, "device_id long, event_id long, t double, floor string, x double, y double, heading double, seed boolean")
    got = {r.event_id: (r.seg_key, r.placed_y) for r in corridors.sticky_corridor(df, segs).collect()}
    assert got[0][0] == got[1][0] and got[3][0] not in (None, got[0][0])
    assert got[2] == (None, 9.0)  # a seed stands where it says
    kept = {r.event_id: r.seg_key for r in corridors.sticky_corridor(df.drop("seed"), segs).collect()}
    assert kept[1] == got[0][0]


def test_votes_are_gated_and_cleared():
    vote = lambda s, k, **more: machines.heading_vote(s, {"device_id": 1, "event_id": k, "t": 1000.0 * k, "heading": 90.0 + k, "yaw": 0.3, **more})
    s = {}
    assert [bool(vote(s, k)) for k in range(4)] == [False, False, True, False]
    s = {}
    assert [bool(vote(s, k, strong=k == 1)) for k in range(4)] == [False, False, False, True]
    s = {}
    assert [bool(vote(s, k, fixed=k == 2)) for k in range(6)] == [False, False, False, False, False, True]


def test_snapshots_refuse_short_writes_and_second_writers(spark, tmp_path, monkeypatch):
    from waygrid.sources import snapshots
    base, df = str(tmp_path), spark.range(100).repartition(3)
    first = snapshots.publish_snapshot(df, base, 1)
    manifest = json.loads((tmp_path / first / "_manifest.json").read_text())
    assert manifest["rows"] == 100 == sum(manifest["files"].values()) and len(manifest["files"]) == 3
    (tmp_path / "map.current.lock").write_text("someone")
    with pytest.raises(IOError):
        snapshots.publish_snapshot(df, base, 2)
    assert snapshots.current_name(spark, base) == first and not (tmp_path / "map_2").exists()
    (tmp_path / "map.current.lock").unlink()
    (tmp_path / ".map.current.lock.crc").unlink(missing_ok=True)
    pointed = snapshots._pointed
    seen = iter(["", "map_9"])  # the pointer moves while the second version is written
    monkeypatch.setattr(snapshots, "_pointed", lambda *a: next(seen, "map_9"))
    with pytest.raises(IOError):
        snapshots.publish_snapshot(df, base, 3)
    monkeypatch.setattr(snapshots, "_pointed", pointed)
    assert snapshots.current_name(spark, base) == first and snapshots.read_current(spark, base).count() == 100
    with pytest.raises(ValueError):
        snapshots.publish_snapshot(df.where("id < 0"), base, 4)
    assert snapshots.publish_snapshot(df.where("id < 50"), base, 5) == "map_5" and snapshots.read_current(spark, base).count() == 50
