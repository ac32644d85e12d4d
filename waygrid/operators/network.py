"""Walkable network: junction splitting, node snapping, edges, shortest distances."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.geometry import nearest_on_segment
from ..session import cut, large
from .corridors import snap_to_walkable

# Snap tolerance and ride cost per extra floor.
SNAP_TOLERANCE_M = 0.3
RIDE_PER_FLOOR_COST = 1.0
FLOOR_KEYS = ("site_id", "floor")
# Edges of a graph that a task holds, edges times sources that it solves for a graph, rows it gives out at once.
GRAPH_EDGES, SOLVE_WORK, OUT_ROWS = 200_000, 20_000_000, 50_000


def _box_cells(df: DataFrame, cell: float, pad: float) -> DataFrame:
    """One row per grid cell touched by each segment's padded box."""
    lo = lambda c: F.floor((F.least(f"{c}1", f"{c}2") - pad) / cell)
    hi = lambda c: F.floor((F.greatest(f"{c}1", f"{c}2") + pad) / cell)
    d = df.withColumn("gx", F.explode(F.sequence(lo("x"), hi("x"))))
    return d.withColumn("gy", F.explode(F.sequence(lo("y"), hi("y"))))


def _interior_t(p: str, px: Column, py: Column, tol: float) -> Column:
    """Place of a point on the inside of segment ``p``, NULL if it is not there."""
    x1, y1, x2, y2 = (F.col(f"{p}.{c}") for c in ("x1", "y1", "x2", "y2"))
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    t = F.try_divide((px - x1) * dx + (py - y1) * dy, len2)
    ln = F.sqrt(len2)
    ok = (len2 >= 1e-12) & (t * ln > tol) & ((1 - t) * ln > tol) & (F.hypot(px - (x1 + t * dx), py - (y1 + t * dy)) <= tol)
    return F.when(ok, F.round(t, 6))


def split_at_junctions(
    segments: DataFrame, keys: Sequence[str] = FLOOR_KEYS, order: str = "seg_no", tol: float = SNAP_TOLERANCE_M,
    cell_m: float = 16.0,
) -> DataFrame:
    """Cut segments where another one ends on them or crosses them.

    Only segments sharing a grid cell can meet. Attributes go on to the pieces; ``piece_no``
    counts along the segment.
    """
    keys = list(keys)
    base = segments.select(*keys, order, "x1", "y1", "x2", "y2")
    near = _box_cells(base, cell_m, tol)
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*keys, "gx", "gy")]
    pair = near.alias("a").join(large(near.alias("b")), [*on, F.col(f"a.{order}") != F.col(f"b.{order}")])
    # a pair may share several cells: it counts once, in the lowest shared one
    a = {c: F.col(f"a.{c}") for c in ("x1", "y1", "x2", "y2")}
    b = {c: F.col(f"b.{c}") for c in ("x1", "y1", "x2", "y2")}
    first = lambda c, g: F.col(f"a.{g}") == F.floor((F.greatest(
        F.least(a[f"{c}1"], a[f"{c}2"]), F.least(b[f"{c}1"], b[f"{c}2"])) - tol) / cell_m)
    pair = pair.where(first("x", "gx") & first("y", "gy"))
    den = (a["x1"] - a["x2"]) * (b["y1"] - b["y2"]) - (a["y1"] - a["y2"]) * (b["x1"] - b["x2"])
    ta = F.try_divide((a["x1"] - b["x1"]) * (b["y1"] - b["y2"]) - (a["y1"] - b["y1"]) * (b["x1"] - b["x2"]), den)
    tb = -F.try_divide((a["x1"] - a["x2"]) * (a["y1"] - b["y1"]) - (a["y1"] - a["y2"]) * (a["x1"] - b["x1"]), den)
    crosses = (F.abs(den) >= 1e-12) & (ta > 0) & (ta < 1) & (tb > 0) & (tb < 1)
    cx, cy = a["x1"] + ta * (a["x2"] - a["x1"]), a["y1"] + ta * (a["y2"] - a["y1"])
    cuts = F.array(_interior_t("a", b["x1"], b["y1"], tol), _interior_t("a", b["x2"], b["y2"], tol),
                   F.when(crosses, _interior_t("a", cx, cy, tol)))
    found = pair.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col(f"a.{order}").alias(order), F.explode(cuts).alias("t"))
    found = found.where("t is not null").groupBy(*keys, order).agg(F.collect_set("t").alias("ts"))
    rows = segments.join(large(found), [*keys, order], "left")
    marks = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.coalesce("ts", F.array().cast("array<double>")))))
    rows = rows.withColumn("_m", marks).drop("ts")
    spans = F.transform(F.sequence(F.lit(1), F.size("_m") - 1), lambda i: F.struct(
        F.element_at("_m", i).alias("a"), F.element_at("_m", i + 1).alias("b")))
    rows = rows.select("*", F.posexplode(spans).alias("piece_no", "_s")).drop("_m")
    at = lambda c, e: F.col(f"{c}1") + F.col(f"_s.{e}") * (F.col(f"{c}2") - F.col(f"{c}1"))
    ends = {"_x1": at("x", "a"), "_y1": at("y", "a"), "_x2": at("x", "b"), "_y2": at("y", "b")}
    rows = rows.withColumns(ends).drop("x1", "y1", "x2", "y2", "_s")
    return rows.withColumnsRenamed({f"_{c}": c for c in ("x1", "y1", "x2", "y2")})


def piece_ends(pieces: DataFrame, keys: Sequence[str] = FLOOR_KEYS, order: str = "seg_no") -> DataFrame:
    """Both ends of every piece with the order in which a builder would register them."""
    ends = F.array(F.struct(F.lit(0).alias("end"), F.col("x1").alias("x"), F.col("y1").alias("y")),
                   F.struct(F.lit(1).alias("end"), F.col("x2").alias("x"), F.col("y2").alias("y")))
    e = pieces.select(*keys, order, "piece_no", F.inline(ends))
    return e.withColumn("ordinal", F.struct(F.col(order).cast("long").alias("s"), F.col("piece_no").cast("long").alias("p"), F.col("end").cast("long").alias("e")))


def snap_nodes(ends: DataFrame, keys: Sequence[str] = FLOOR_KEYS, tol: float = SNAP_TOLERANCE_M) -> DataFrame:
    """Node of every end: the first registered node within tolerance.

    First come, first kept equals the lexicographic-first independent set of the closeness
    graph: in each round a place with no earlier undecided place close by becomes a node and
    removes the places around it. ``ends``: keys, x, y, ordinal. Adds node_x, node_y.
    """
    keys = list(keys)
    # equal coordinates always share a fate, so they are decided once
    spots = ends.groupBy(*keys, "x", "y").agg(F.min("ordinal").alias("ord"))
    cell = lambda c: F.floor(F.col(c) / tol)
    around = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    homes = spots.withColumns({"gx": cell("x"), "gy": cell("y")})
    spread = homes.withColumn("dx", around).withColumn("dy", around).withColumns(
        {"gx": F.col("gx") + F.col("dx"), "gy": F.col("gy") + F.col("dy")}).drop("dx", "dy")
    # a node is kept at 3 dp, and distances are taken from there
    on = [F.col(f"l.{k}") == F.col(f"e.{k}") for k in (*keys, "gx", "gy")]
    close = F.hypot(F.bround("e.x", 3) - F.col("l.x"), F.bround("e.y", 3) - F.col("l.y")) <= tol
    links = homes.alias("l").join(large(spread.alias("e")), [*on, close, F.col("e.ord") < F.col("l.ord")]).select(
        *[F.col(f"l.{k}").alias(k) for k in keys], F.col("l.ord").alias("ord"), F.col("e.ord").alias("early"))
    linked = links.select(*keys, "ord").distinct()
    free = spots.join(large(linked), [*keys, "ord"], "left_anti").select(*keys, "ord")
    nodes, undecided = free, links
    if not links.isEmpty():
        undecided = cut(links)
        nodes = cut(free)
        fresh = nodes
        while True:
            # places next to a new node are taken; their claims on later places end
            taken = undecided.join(large(fresh.withColumnRenamed("ord", "early")), [*keys, "early"], "left_semi").select(*keys, "ord").distinct()
            left = undecided.join(large(taken), [*keys, "ord"], "left_anti")
            gone = taken.withColumnRenamed("ord", "early")
            still = cut(left.join(large(gone), [*keys, "early"], "left_anti"))
            blocked = still.select(*keys, "ord").distinct()
            fresh = cut(left.select(*keys, "ord").distinct().join(large(blocked), [*keys, "ord"], "left_anti"))
            nodes = nodes.unionByName(fresh)
            undecided = still
            if still.isEmpty():
                break
    at = spots.join(large(nodes), [*keys, "ord"], "left_semi")
    own = at.select(*keys, F.col("ord").alias("n_ord"), F.bround("x", 3).alias("node_x"), F.bround("y", 3).alias("node_y"))
    cells = own.withColumns({"gx": F.floor(F.col("node_x") / tol), "gy": F.floor(F.col("node_y") / tol)})
    wide = cells.withColumn("dx", around).withColumn("dy", around).withColumns(
        {"gx": F.col("gx") + F.col("dx"), "gy": F.col("gy") + F.col("dy")}).drop("dx", "dy")
    near = F.hypot(F.col("node_x") - F.col("x"), F.col("node_y") - F.col("y")) <= tol + 1e-12
    first = homes.join(large(wide), [*keys, "gx", "gy"]).where(near & (F.col("n_ord") <= F.col("ord"))).groupBy(*keys, "x", "y").agg(
        F.min_by(F.struct("node_x", "node_y"), "n_ord").alias("n"))
    return ends.join(large(first.select(*keys, "x", "y", "n.node_x", "n.node_y")), [*keys, "x", "y"])


def build_edges(pieces: DataFrame, keys: Sequence[str] = FLOOR_KEYS, order: str = "seg_no", tol: float = SNAP_TOLERANCE_M) -> DataFrame:
    """Undirected walk edges between snapped nodes: keys, ax, ay, bx, by, weight (ax,ay) <= (bx,by)."""
    keys = list(keys)
    ends = snap_nodes(piece_ends(pieces, keys, order), keys, tol)
    pick = lambda e, c: F.max(F.when(F.col("end") == e, F.col(c)))
    e = ends.groupBy(*keys, order, "piece_no").agg(
        pick(0, "node_x").alias("ax"), pick(0, "node_y").alias("ay"), pick(1, "node_x").alias("bx"), pick(1, "node_y").alias("by"))
    return undirected(e, keys)


def undirected(e: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per unordered node pair; self-loops are of no use to a route."""
    a, b = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))
    e = e.where(a != b).select(*keys, F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    return e.select(*keys, F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"),
                    F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")).alias("weight"))


def node_id(floor, x, y) -> Column:
    """Readable node key: floor and coordinates at 3 dp."""
    c = lambda v: F.format_string("%.3f", (F.col(v) if isinstance(v, str) else v) + F.lit(0.0))
    return F.concat_ws("/", F.col(floor) if isinstance(floor, str) else floor, c(x), c(y))


def registered_nodes(resolved: DataFrame, order: str = "piece_ord") -> DataFrame:
    """Every node of the walkways (keys, node_x, node_y) with ``n_ord``, the first piece end that used it."""
    ends = F.array(F.struct(F.lit(0).alias("end"), F.col("ax").alias("node_x"), F.col("ay").alias("node_y")),
                   F.struct(F.lit(1).alias("end"), F.col("bx").alias("node_x"), F.col("by").alias("node_y")))
    e = resolved.select(*FLOOR_KEYS, F.col(order).alias("_o"), F.inline(ends))
    return e.groupBy(*FLOOR_KEYS, "node_x", "node_y").agg(F.min(F.struct("_o", "end")).alias("n_ord"))


def first_node(places: DataFrame, nodes: DataFrame, x: str, y: str, tol: float = SNAP_TOLERANCE_M) -> DataFrame:
    """Add node_x, node_y: the earliest of ``nodes`` within tolerance of each place, NULL if there is none."""
    keys = list(FLOOR_KEYS)
    cell = lambda c: F.floor(F.col(c) / tol)
    around = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    wide = nodes.withColumn("_dx", around).withColumn("_dy", around).withColumns(
        {"_gx": cell("node_x") + F.col("_dx"), "_gy": cell("node_y") + F.col("_dy")}).drop("_dx", "_dy")
    near = F.hypot(F.col("node_x") - F.col(x), F.col("node_y") - F.col(y)) <= tol + 1e-12
    spots = places.select(*keys, x, y).distinct().withColumns({"_gx": cell(x), "_gy": cell(y)})
    found = spots.join(large(wide), [*keys, "_gx", "_gy"]).where(near).groupBy(*keys, x, y).agg(
        F.min_by(F.struct("node_x", "node_y"), "n_ord").alias("_n"))
    return places.join(large(found), [*keys, x, y], "left").withColumns({"node_x": F.col("_n.node_x"), "node_y": F.col("_n.node_y")}).drop("_n")


def landing_splice(landings: DataFrame, resolved: DataFrame, order: str = "piece_ord") -> DataFrame:
    """Connector doors at the nearest walkway point of their floor, with the nodes of that piece's ends.

    ``resolved``: pieces with their end nodes (``routing.resolved_pieces``). A door within snap
    tolerance of a node is that node; other doors of a floor are registered in order of connector.
    """
    snapped = snap_to_walkable(landings, resolved, FLOOR_KEYS, order).drop("piece")
    ends = resolved.select(*FLOOR_KEYS, F.col(order).alias("snap_ord"), F.col("ax").alias("p_x1"), F.col("ay").alias("p_y1"),
                           F.col("bx").alias("p_x2"), F.col("by").alias("p_y2"))
    rows = cut(first_node(snapped.join(large(ends), [*FLOOR_KEYS, "snap_ord"], "left"), registered_nodes(resolved, order), "snap_x", "snap_y"))
    fresh = rows.where("node_x is null").select(*FLOOR_KEYS, F.col("snap_x").alias("x"), F.col("snap_y").alias("y"), F.struct(
        "connector_id", "snap_x", "snap_y").alias("ordinal"))
    fresh = cut(fresh.groupBy(*FLOOR_KEYS, "x", "y").agg(F.min("ordinal").alias("ordinal")))
    fresh = fresh.withColumns({"node_x": F.lit(None).cast("double"), "node_y": F.lit(None).cast("double")}) if fresh.isEmpty() else snap_nodes(fresh)
    fresh = fresh.select(*FLOOR_KEYS, F.col("x").alias("snap_x"), F.col("y").alias("snap_y"), F.col("node_x").alias("_fx"), F.col("node_y").alias("_fy"))
    rows = rows.join(large(fresh), [*FLOOR_KEYS, "snap_x", "snap_y"], "left")
    return cut(rows.withColumns({"door_x": F.coalesce("node_x", "_fx"), "door_y": F.coalesce("node_y", "_fy")}).drop("node_x", "node_y", "_fx", "_fy"))


def vertical_edges(landings: DataFrame) -> DataFrame:
    """Every pair of floors a connector serves: boarding penalty, extra floors, planar shift.

    ``landings``: site_id, connector_id, floor, rank (bottom up), door_x, door_y, penalty_cost.
    """
    w = Window.partitionBy("site_id", "connector_id").orderBy("rank")
    l = landings.withColumn("stop", F.row_number().over(w))
    side = lambda p: l.select("site_id", "connector_id", "penalty_cost", *[
        F.col(c).alias(f"{p}_{c}") for c in ("floor", "stop", "door_x", "door_y")])
    pair = side("a").join(large(side("b")), ["site_id", "connector_id", "penalty_cost"]).where("a_stop < b_stop")
    planar = F.hypot(F.col("a_door_x") - F.col("b_door_x"), F.col("a_door_y") - F.col("b_door_y"))
    weight = F.col("penalty_cost") + RIDE_PER_FLOOR_COST * (F.col("b_stop") - F.col("a_stop") - 1) + planar
    return pair.select("site_id", "connector_id", "a_floor", "a_door_x", "a_door_y", "b_floor", "b_door_x", "b_door_y", weight.alias("weight"))


def layered_edges(walk: DataFrame, doors: DataFrame, vertical: DataFrame) -> DataFrame:
    """Directed edges (site_id, src, dst, weight, connector_id) of the whole building."""
    pair = lambda d, a, b, w, c: d.select("site_id", a.alias("src"), b.alias("dst"), w.alias("weight"), c.alias("connector_id"))
    none = F.lit(None).cast("string")
    parts = [pair(walk, node_id("floor", "ax", "ay"), node_id("floor", "bx", "by"), F.col("weight"), none)]
    # a floor without walkways has doors that lead nowhere
    spliced = doors.where("p_x1 is not null")
    for end in ("1", "2"):
        ex, ey = f"p_x{end}", f"p_y{end}"
        parts.append(pair(spliced, node_id("floor", "door_x", "door_y"), node_id("floor", ex, ey),
                          F.hypot(F.col("door_x") - F.col(ex), F.col("door_y") - F.col(ey)), none))
    parts.append(pair(vertical, node_id("a_floor", "a_door_x", "a_door_y"), node_id("b_floor", "b_door_x", "b_door_y"),
                      F.col("weight"), F.col("connector_id")))
    one = parts[0]
    for p in parts[1:]:
        one = one.unionByName(p)
    one = one.where("src <> dst")
    both = one.unionByName(one.select("site_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "connector_id"))
    # parallel links: only the cheapest can lie on a shortest route
    return both.groupBy("site_id", "src", "dst").agg(
        F.min(F.struct("weight", "connector_id")).alias("e")).select("site_id", "src", "dst", "e.weight", "e.connector_id")


def by_graph(edges: DataFrame, asked: DataFrame, keys: Sequence[str], load: Callable, answer: Callable, schema: T.StructType) -> DataFrame:
    """Answer the rows of ``asked`` in tasks that hold the edges of their graph: what ``answer`` gives for each.

    ``keys`` tell graphs apart in both tables. ``load(table)`` makes a graph of its edges (None, if it has none);
    ``answer(graph, table)`` yields record batches of ``schema`` for a batch of one graph's questions. In a task a graph's
    edges come first, then its questions stream past them.
    """
    keys = list(keys)
    mine = [c for c in edges.columns if c not in keys]
    both = edges.withColumn("_kind", F.lit(0)).unionByName(asked.withColumn("_kind", F.lit(1)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, graph, acc, held = None, [], None, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            codes = [b.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy() for k in keys] + [b.column("_kind").to_numpy()]
            cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                rows = b.slice(lo, hi - lo)
                now = tuple(rows.column(k)[0].as_py() for k in keys)
                if now != here:
                    here, parts, graph = now, [], None
                if rows.column("_kind")[0].as_py() == 0:
                    parts.append(rows.select(mine))
                    continue
                if graph is None:
                    graph = load(pa.Table.from_batches(parts) if parts else None)
                for out in answer(graph, rows):
                    acc.append(out)
                    held += out.num_rows
                if held >= OUT_ROWS:
                    yield from pa.Table.from_batches(acc).combine_chunks().to_batches()
                    acc, held = [], 0
        if acc:
            yield from pa.Table.from_batches(acc).combine_chunks().to_batches()

    # few bytes and much work: Spark would put graphs together again, were the number of tasks not given
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(n, *keys).sortWithinPartitions(*keys, "_kind").mapInArrow(run, schema)


class _Graph:
    """Edges of a graph by node; nodes are numbered in the order of their names."""

    def __init__(self, edges: pa.Table | None):
        ends = [edges[c].to_pylist() for c in ("node", "dst")] if edges else [[], []]
        self.names = sorted({*ends[0], *ends[1]})
        self.no = {x: i for i, x in enumerate(self.names)}
        self.out: list[list] = [[] for _ in self.names]
        for a, b, w in zip(*ends, edges["weight"].to_pylist() if edges else ()):
            self.out[self.no[a]].append((self.no[b], w))
        self.given = pa.array(self.names, pa.string())

    def tree(self, source: int) -> tuple[list, list, list]:
        """Nodes reached, their distances and predecessors (-1: none). Of several ways of one length that with the fewest
        edges counts, then the predecessor with the lowest name."""
        n = len(self.names)
        dist, hops, prev, done = [math.inf] * n, [0] * n, [-1] * n, [False] * n
        dist[source], heap, seen = 0.0, [(0.0, 0, source)], []
        while heap:
            d, h, u = heapq.heappop(heap)
            if done[u]:
                continue
            done[u] = True
            seen.append(u)
            h += 1
            for v, w in self.out[u]:
                if done[v]:
                    continue
                # 9 dp keep float noise from looking like an improvement
                to, old = math.floor((d + w) * 1e9 + 0.5) / 1e9, dist[v]
                if to < old or (to == old and (h < hops[v] or (h == hops[v] and u < prev[v]))):
                    if to < old or h < hops[v]:
                        heapq.heappush(heap, (to, h, v))
                    dist[v], hops[v], prev[v] = to, h, u
        return seen, [dist[v] for v in seen], [prev[v] for v in seen]


def shortest_distances(edges: DataFrame, sources: DataFrame, graph: str = "site_id") -> DataFrame:
    """Distance and predecessor from each source to every node it reaches.

    ``edges``: graph, src, dst, weight (positive). ``sources``: graph, source. A task holds the edges of a graph and
    solves its sources one after another; many sources of a graph are dealt to several tasks. Graphs of more than
    ``GRAPH_EDGES`` are solved by rounds of joins, in which no graph is held in one task.
    """
    e = edges.where(F.col(graph).isNotNull()).select(graph, F.col("src").alias("node"), "dst", F.col("weight").cast("double").alias("weight"))
    asked = sources.select(graph, "source").distinct()
    name = lambda d, n: d.groupBy(graph).agg(F.count("*").alias(n))
    sizes = name(e, "_e").join(large(name(asked, "_s")), graph).withColumn("_slots", F.ceil(F.col("_e") * F.col("_s") / SOLVE_WORK))
    sizes = sizes.where((F.col("_e") > GRAPH_EDGES) | (F.col("_slots") > 1)).select(graph, (F.col("_e") > GRAPH_EDGES).alias("_big"), "_slots")
    sizes = cut(sizes)
    big = sizes.where("_big").select(graph)
    many = sizes.where("NOT _big").select(graph, F.col("_slots").cast("int").alias("_slots"))
    by_rounds = None
    if not big.isEmpty():
        by_rounds = _distances_by_rounds(e.join(big, graph, "left_semi"), asked.join(big, graph, "left_semi"), graph)
        e, asked = e.join(big, graph, "left_anti"), asked.join(big, graph, "left_anti")
    if many.isEmpty():
        e, asked = e.withColumn("_slot", F.lit(0)), asked.withColumn("_slot", F.lit(0))
    else:
        n = F.coalesce("_slots", F.lit(1))
        e = e.join(many, graph, "left").withColumn("_slot", F.explode(F.sequence(F.lit(0), n - 1))).drop("_slots")
        asked = asked.join(many, graph, "left").withColumn("_slot", F.pmod(F.xxhash64("source"), n).cast("int")).drop("_slots")
    kind = asked.schema[graph]
    schema = T.StructType([kind, *[T.StructField(c, T.StringType()) for c in ("source", "node")], T.StructField("dist", T.DoubleType()), T.StructField("prev", T.StringType())])
    arrow = to_arrow_schema(schema)

    def answer(g: _Graph, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        asked, at, names = rows.column("source"), [], g.given
        nodes: list = []
        dist: list = []
        prev: list = []
        for i, source in enumerate(asked.to_pylist()):
            if source in g.no:
                seen, far, before = g.tree(g.no[source])
                nodes += seen
                dist += far
                prev += before
            else:  # nothing leads anywhere from here
                names = pa.concat_arrays([names, pa.array([source], pa.string())])
                seen = [len(names) - 1]
                nodes += seen
                dist.append(0.0)
                prev.append(-1)
            at += [i] * len(seen)
            if len(at) >= OUT_ROWS or i + 1 == rows.num_rows:
                row, before = pa.array(at), np.array(prev)
                yield pa.RecordBatch.from_arrays([rows.column(graph).take(row), asked.take(row), names.take(pa.array(nodes)),
                                                  pa.array(dist, pa.float64()), names.take(pa.array(before, mask=before < 0))], schema=arrow)
                at, nodes, dist, prev, names = [], [], [], [], g.given

    solved = by_graph(e, asked, [graph, "_slot"], _Graph, answer, schema)
    return solved if by_rounds is None else solved.unionByName(by_rounds.select(*solved.columns))


def _distances_by_rounds(e: DataFrame, sources: DataFrame, graph: str) -> DataFrame:
    """Each round moves the improved nodes one edge on and keeps what got shorter; it ends when nothing did. Rounds are
    joins on (graph, node), so no graph or source is held in one task.
    """
    key = [graph, "source", "node"]
    e = cut(e)
    start = sources.select(
        graph, "source", F.col("source").alias("node"), F.lit(0.0).alias("dist"), F.lit(None).cast("string").alias("prev"))
    frontier = known = cut(start)
    while True:
        step = frontier.join(large(e), [graph, "node"]).select(
            graph, "source", F.col("dst").alias("to"), F.col("node").alias("via"),
            # 9 dp keep float noise from looking like an improvement
            F.round(F.col("dist") + F.col("weight"), 9).alias("d"))
        offer = step.groupBy(graph, "source", F.col("to").alias("node")).agg(F.min(F.struct("d", "via")).alias("o"))
        # only nodes just reached are looked up; what got shorter is appended, nothing is written again
        held = known.join(large(offer.select(*key)), key, "left_semi").groupBy(*key).agg(F.min("dist").alias("dist"))
        frontier = cut(offer.join(large(held), key, "left").where(F.col("dist").isNull() | (F.col("o.d") < F.col("dist"))).select(
            *key, F.col("o.d").alias("dist"), F.col("o.via").alias("prev")))
        if frontier.isEmpty():
            best = known.groupBy(*key).agg(F.min_by(F.struct("prev"), "dist").alias("b"), F.min("dist").alias("dist"))
            return cut(best.select(*key, "dist", "b.prev"))
        known = known.unionByName(frontier)
