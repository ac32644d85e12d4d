"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waygrid.session import shared_dir

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text; a text without any gives an empty array."""
    return F.filter(F.split(text, BLANK, -1), lambda w: w != "")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b) of long ids: (node, component = smallest id).

    Alternating large-star and small-star rounds; each ends in a written table. A node's neighbours
    never meet in one row: both stars are a grouped minimum joined back to the edges.
    """
    def both(e):
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e, large: bool):
        nbrs = both(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = nbrs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = nbrs.join(low, "a")
        if large:
            out = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    edges = materialise(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    key = "sum(cast(xxhash64(a, b) as decimal(38, 0))) AS s"
    seen = None
    while True:
        edges = materialise(star(star(edges, True), False), "edges")
        now = edges.selectExpr("count(*) AS n", key).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
