"""Driver tables seen as positioning data, for Spark and (as SQL text) for the oracle.

Each view is a list of portable expressions over one table, so both engines compute
the same rows. Network views give every supplier a three-storey building.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

SIMPLE = {
    "v_images": ("embeddings", [
        "vec_id AS image_id", "label AS location_id",
        "CASE label % 3 WHEN 0 THEN 'G' WHEN 1 THEN 'B1' ELSE 'B2' END AS floor",
        "CASE WHEN label % 2 = 0 THEN 'zone_a' ELSE 'zone_b' END AS zone",
        "label * 3e0 AS x", "(label % 4) * 25e-1 AS y",
        "CAST((vec_id * 37) % 360 AS INT) AS orientation", "embedding"]),
    "v_points": ("events", [
        "event_id", "user_id AS device_id", "ts",
        "((event_id * 7919) % 60000) / 1e3 - 10e0 AS x", "((event_id * 104729) % 60000) / 1e3 - 10e0 AS y",
        "CASE user_id % 3 WHEN 0 THEN 'B1' WHEN 1 THEN 'G' ELSE '1' END AS floor",
        "CAST((event_id * 53) % 360 AS DOUBLE) AS heading",
        "CASE event_type WHEN 'purchase' THEN 'VPR' WHEN 'error' THEN 'VPR_MISS' WHEN 'signup' THEN 'SEED' ELSE 'PDR' END AS source",
        "CAST(floor(value) AS INT) * 10 AS latency_ms", "(event_id % 61) / 1e2 + 4e-1 AS confidence"]),
    "v_slots": ("part", [
        "p_partkey AS slot_id", "CASE p_partkey % 3 WHEN 0 THEN 'B1' WHEN 1 THEN 'G' ELSE '1' END AS floor",
        "((p_partkey * 7) % 401) / 1e1 AS x", "((p_partkey * 11) % 401) / 1e1 AS y"]),
    "v_landmarks": ("orders", [
        "o_orderkey AS landmark_id", "((o_orderkey * 13 + o_custkey * 29) % 5000) / 1e2 AS x",
        "((o_orderkey * 97 + o_custkey) % 5000) / 1e2 AS y", "((o_orderkey * 7) % 400) / 1e2 AS z",
        "CASE o_orderkey % 3 WHEN 0 THEN 'G' WHEN 1 THEN 'B1' ELSE 'B2' END AS floor",
        "CAST(o_orderkey % 4 AS INT) AS session_id"]),
    "v_pixels": ("lineitem", [
        "l_orderkey % 40 AS image_id", "l_linenumber AS px", "l_orderkey AS py",
        "CAST((l_partkey * 7) % 180 AS INT) AS h", "CAST((l_suppkey * 31 + l_linenumber) % 256 AS INT) AS s",
        "CAST((l_orderkey * 11) % 256 AS INT) AS v"]),
    # every order line is a position fix in the building of its supplier
    "v_fixes": ("lineitem", [
        "l_orderkey * 10 + l_linenumber AS fix_id", "l_suppkey AS site_id",
        "CASE l_partkey % 3 WHEN 0 THEN 'B1' WHEN 1 THEN 'G' ELSE '1' END AS floor",
        "((l_orderkey * 7919 + l_linenumber * 31) % 30000) / 1e3 - 4e0 AS x",
        "((l_partkey * 104729 + l_linenumber * 17) % 30000) / 1e3 - 4e0 AS y",
        "CAST((l_orderkey * 53 + l_partkey) % 360 AS DOUBLE) AS heading"]),
    # floor-plan control points: supplier = floor plan, true transform plus a small error
    "v_control": ("lineitem", [
        "l_suppkey AS plan_id", "CAST((l_partkey * 37) % 1000 AS DOUBLE) AS px", "CAST((l_orderkey * 53) % 800 AS DOUBLE) AS py",
        "((l_partkey * 37) % 1000) * 2e-2 + ((l_orderkey * 53) % 800) * 1e-3 + l_suppkey + ((l_orderkey * 7 + l_linenumber) % 11 - 5) * 2e-3 AS x",
        "((l_partkey * 37) % 1000) * 5e-4 - ((l_orderkey * 53) % 800) * 19e-3 + 40e0 + ((l_partkey * 3 + l_linenumber) % 13 - 6) * 2e-3 AS y"]),
}

FLOORS3 = "CASE lvl WHEN 0 THEN 'B1' WHEN 1 THEN 'G' ELSE '1' END"

# one route request per order: nodes and storeys in the building of its first supplier
REQUESTS = ("l_orderkey AS request_id", "min(l_suppkey) AS site_id", "CAST(min(l_partkey) % 9 AS INT) AS start_node",
            "CAST(max(l_partkey) % 9 AS INT) AS dest_node", "CAST(min(l_partkey) % 3 AS INT) AS start_lvl",
            "CAST(max(l_partkey) % 3 AS INT) AS dest_lvl")

ORACLE_VIEWS = {
    "v_requests": f"SELECT {', '.join(REQUESTS)} FROM lineitem GROUP BY l_orderkey",
    # three floors of a 3 x 3 grid per supplier, pitch 10, 11 or 12 m
    "v_sites": "SELECT s_suppkey AS site_id, 10e0 + s_suppkey % 3 AS pitch FROM supplier",
    "v_levels": "SELECT * FROM (VALUES (0), (1), (2)) t(lvl)",
    "v_nodes": f"""SELECT site_id, {FLOORS3} AS floor, lvl, node, (node % 3) * pitch AS x,
        CAST(floor(node / 3e0) AS INT) * pitch AS y
        FROM v_sites, v_levels, (SELECT CAST(range AS INT) AS node FROM range(9)) n""",
    "v_corridors": f"""SELECT site_id, {FLOORS3} AS floor, lvl, r AS seg_no,
        CASE WHEN r < 3 THEN 0e0 ELSE (r - 3) * pitch END AS x1, CASE WHEN r < 3 THEN r * pitch ELSE 0e0 END AS y1,
        CASE WHEN r < 3 THEN 2 * pitch ELSE (r - 3) * pitch END AS x2, CASE WHEN r < 3 THEN r * pitch ELSE 2 * pitch END AS y2,
        CASE WHEN r < 3 THEN 6e0 ELSE 3e0 END AS width
        FROM v_sites, v_levels, (SELECT CAST(range AS INT) AS r FROM range(6)) n""",
    "v_pieces": """SELECT c.site_id, c.floor, c.lvl, c.seg_no, CAST(h AS INT) AS piece_no,
        x1 + h * (x2 - x1) / 2e0 AS x1, y1 + h * (y2 - y1) / 2e0 AS y1,
        x1 + (h + 1) * (x2 - x1) / 2e0 AS x2, y1 + (h + 1) * (y2 - y1) / 2e0 AS y2, width
        FROM v_corridors c, (SELECT range AS h FROM range(2)) n""",
    "v_landings": """SELECT site_id, connector_id, floor, lvl, node, x, y, 12e0 AS penalty_cost
        FROM v_nodes JOIN (VALUES ('lift_a', 0), ('lift_b', 8)) k(connector_id, n) ON node = n""",
}


def simple_sql(name: str) -> str:
    table, exprs = SIMPLE[name]
    return f"SELECT {', '.join(exprs)} FROM {table}"


def oracle(sql: str) -> str:
    """``sql`` with the views it names put in front as CTEs."""
    order: list[str] = []

    def need(text: str):
        for name in dict.fromkeys(re.findall(r"\bv_\w+", text)):
            if name in order or name not in {**SIMPLE, **ORACLE_VIEWS}:
                continue
            body = simple_sql(name) if name in SIMPLE else ORACLE_VIEWS[name]
            need(body)
            order.append(name)

    need(sql)
    if not order:
        return sql.strip()
    bodies = [f"{n} AS ({simple_sql(n) if n in SIMPLE else ORACLE_VIEWS[n]})" for n in order]
    text = sql.strip()
    if text.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(bodies) + ", " + text[len("WITH RECURSIVE"):]
    if text.upper().startswith("WITH"):
        return "WITH " + ", ".join(bodies) + ", " + text[len("WITH"):]
    return "WITH " + ", ".join(bodies) + " " + text


class Tables:
    """Driver tables and views as DataFrames: ``t.orders``, ``t.v_images``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name in SIMPLE:
            table, exprs = SIMPLE[name]
            return getattr(self, table).selectExpr(*exprs)
        raise AttributeError(name)

    @cached_property
    def v_sites(self) -> DataFrame:
        return self.supplier.selectExpr("s_suppkey AS site_id", "10e0 + s_suppkey % 3 AS pitch")

    def _storeys(self) -> DataFrame:
        return self.v_sites.withColumn("lvl", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("floor", F.expr(FLOORS3))

    @property
    def v_nodes(self) -> DataFrame:
        n = self._storeys().withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(8))))
        return n.selectExpr("site_id", "floor", "lvl", "node", "(node % 3) * pitch AS x",
                            "CAST(floor(node / 3e0) AS INT) * pitch AS y")

    @property
    def v_corridors(self) -> DataFrame:
        """Three walkways each way per floor; they cross at the nodes."""
        c = self._storeys().withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(5))))
        return c.selectExpr(
            "site_id", "floor", "lvl", "r AS seg_no",
            "CASE WHEN r < 3 THEN 0e0 ELSE (r - 3) * pitch END AS x1", "CASE WHEN r < 3 THEN r * pitch ELSE 0e0 END AS y1",
            "CASE WHEN r < 3 THEN 2 * pitch ELSE (r - 3) * pitch END AS x2",
            "CASE WHEN r < 3 THEN r * pitch ELSE 2 * pitch END AS y2", "CASE WHEN r < 3 THEN 6e0 ELSE 3e0 END AS width")

    @property
    def v_pieces(self) -> DataFrame:
        p = self.v_corridors.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(1))))
        return p.selectExpr(
            "site_id", "floor", "lvl", "seg_no", "h AS piece_no",
            "x1 + h * (x2 - x1) / 2e0 AS x1", "y1 + h * (y2 - y1) / 2e0 AS y1",
            "x1 + (h + 1) * (x2 - x1) / 2e0 AS x2", "y1 + (h + 1) * (y2 - y1) / 2e0 AS y2", "width")

    @property
    def v_requests(self) -> DataFrame:
        return self.lineitem.groupBy("l_orderkey").agg(*[F.expr(e) for e in REQUESTS[1:]]).withColumnRenamed(
            "l_orderkey", "request_id")

    @property
    def v_landings(self) -> DataFrame:
        lift = F.when(F.col("node") == 0, "lift_a").when(F.col("node") == 8, "lift_b")
        return self.v_nodes.where("node in (0, 8)").select(
            "site_id", lift.alias("connector_id"), "floor", "lvl", "node", "x", "y", F.lit(12.0).alias("penalty_cost"))
