"""Corpus pipeline: quality rules, near-duplicates, decontamination, secret masking, byte-level BPE."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from waygrid.llm import bpe, decontam, neardup, quality, secrets
from waygrid.llm.common import materialise, table
from waygrid.session import shared_dir

NEAR_PERCENT = 80  # word shingles that near copies share; op4 alone is held to 85


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null and empty texts have too few words and go; each row is judged by itself."""
    out = _free(docs, "quality")
    return quality.apply_rules(docs, out=out).where(F.col(out)["kept"]).drop(out)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a written number each, and its name: ids may be null or repeat, and exact repeats differ in nothing else."""
    key = _free(docs, "row_key")
    return materialise(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near copies: the one with the smallest id, rows without an id last; rows that are
    alike in that go by a digest of their columns. Every row counts for itself, also where ids are null or repeat.
    Rows without words are like no other and stay.
    """
    keyed, key = _keyed(docs)
    rows = keyed.select(F.col(key).alias("doc_id"), "text")  # as the operator reads it, the id being the row's own number
    groups = neardup.near_duplicates(rows, NEAR_PERCENT).select(F.col("doc_id").alias("key"), F.col("component_id").alias("group"))
    digest = F.sha2(F.to_json(F.struct(*docs.columns)), 256)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), digest.alias("digest"), F.col(key).alias("key"))
    first = keyed.select(F.col(key).alias("key"), rank.alias("rank")).join(groups, "key").groupBy("group").agg(F.min("rank")["key"].alias(key))
    return keyed.join(first, key, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark item; each is judged by its own text, whatever its id."""
    keyed, key = _keyed(docs)
    rows = keyed.select(F.col(key).alias("doc_id"), "text")
    leaks = decontam.contaminated(rows, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(leaks, key, "left_anti").select(*docs.columns)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret masked; ``n_chars`` follows the text. Null texts stay null; rows are masked one by one."""
    out = _free(docs, "spans")
    masked = secrets.scan(docs, out=out).withColumn("text", secrets.redact(F.col("text"), F.col(out)))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.size(out) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every row: what training reads, and proof that it decodes. A null text
    encodes as an empty one; other columns are not returned.
    """
    out = bpe.round_trip(docs)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secret_masking", secret_masking), ("byte_bpe", byte_bpe)]

#: Signatures, chains of links and byte-pair merges are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
