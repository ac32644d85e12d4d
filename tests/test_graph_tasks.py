"""Graphs are solved in tasks that hold them; larger ones by rounds of joins, with the same rows."""

import os
import random

from pyspark.sql import functions as F

from waygrid.operators import corridors, network as N, routing, spatial
from waygrid.session import scratch_dir

from .test_operators import bent_rows, build


def graphs(spark):
    rng, rows = random.Random(5), []
    for g in ("a", "b", "c/*"):
        for _ in range(60):  # few lengths: many ways are equally long
            a, b, w = rng.randrange(25), rng.randrange(25), rng.choice([1.0, 2.0, 0.1, 0.2])
            rows += [(g, f"n{a}", f"n{b}", w), (g, f"n{b}", f"n{a}", w)]
    edges = spark.createDataFrame([r for r in rows if r[1] != r[2]], "graph string, src string, dst string, weight double")
    return edges, edges.select("graph", F.col("src").alias("source")).unionByName(spark.createDataFrame([("a", "alone"), ("d", "n1")], "graph string, source string"))


def found(df):
    return sorted((r.graph, r.source, r.node, r.dist, r.prev or "") for r in df.collect())


def test_tasks_and_rounds_agree(spark, monkeypatch):
    edges, sources = graphs(spark)
    want = found(N._distances_by_rounds(edges.select("graph", F.col("src").alias("node"), "dst", "weight"), sources.distinct(), "graph"))
    assert found(N.shortest_distances(edges, sources, "graph")) == want and len(want) > 1500
    monkeypatch.setattr(N, "SOLVE_WORK", 500)
    assert found(N.shortest_distances(edges, sources, "graph")) == want
    monkeypatch.setattr(N, "GRAPH_EDGES", 10)
    assert found(N.shortest_distances(edges, sources, "graph")) == want


def test_no_table_for_each_round(spark):
    edges, sources = graphs(spark)
    tables = lambda: set(os.listdir(scratch_dir(spark))) if os.path.isdir(scratch_dir(spark)) else set()
    before = tables()
    N.shortest_distances(edges, sources, "graph").count()
    assert len(tables() - before) <= 1


def test_paths_in_tasks_and_by_rounds(spark, monkeypatch):
    segs, xs = bent_rows(3)
    net = build(spark, segs)
    req = spark.createDataFrame([(k, 1, "G", xs[0] + 1.0, 0.2, "G", xs[j + 1], 3.0 + j) for k, j in enumerate(range(4))] + [(9, 1, "G", 1.0, 0.0, "B7", 1.0, 0.0)],
                                "request_id long, site_id long, start_floor string, start_x double, start_y double, dest_floor string, dest_x double, dest_y double")
    routes, dist = routing.route_requests(req, *net)
    got = lambda: sorted(map(tuple, routing.route_paths(routes, dist).collect()))
    tables = lambda: set(os.listdir(scratch_dir(spark)))
    before, want = tables(), got()
    assert len(tables() - before) <= 2
    assert {r[0] for r in want} == {0, 1, 2, 3} and len(want) > 12
    assert routes.where("request_id = 9 AND network_m IS NULL").count() == 1
    monkeypatch.setattr(routing, "TREE_NODES", 1)
    assert got() == want


def test_only_open_points_ask_the_next_grid(spark, monkeypatch):
    rng = random.Random(2)
    pieces = spark.createDataFrame([("G", i, *[rng.uniform(0, 300) for _ in range(4)], 2.0) for i in range(40)], "floor string, seg_ord int, x1 double, y1 double, x2 double, y2 double, width double")
    points = spark.createDataFrame([(i, "G" if i % 9 else "B", rng.uniform(-50, 400), rng.uniform(-50, 400)) for i in range(300)], "pid int, floor string, x double, y double")
    got = lambda: sorted((r.pid, r.snap_x, r.snap_y, r.snap_dist) for r in corridors.snap_to_walkable(points, pieces, ["floor"]).where("piece IS NOT NULL").collect())
    want = got()
    monkeypatch.setattr(spatial, "BROADCAST_PIECES", 0)
    assert got() == want and len(want) == 266
