"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "waygrid", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE, RocksDB state)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    for key, value in settings.items():
        b = b.config(key, value)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediates.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may fall
    back to a temporary folder: elsewhere executors could not read it back.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    path = os.path.join(tempfile.gettempdir(), f"waygrid-{spark.sparkContext.applicationId}")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage and drop its lineage. A written table is made in one run, a checkpoint in two."""
    return written(df, "cut")


def scratch_dir(spark: SparkSession) -> str:
    """The application's own folder in the shared one; ``clean_up`` deletes it."""
    return f"{shared_dir(spark)}/waygrid-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the scratch folder and read it back: cuts the lineage, keeps columns apart."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """A side of a join that is shuffled and never broadcast through the driver. Spark takes the size of exploded rows
    from the rows they come from, and that of a written table from its compressed files, so it would broadcast either
    at a hundred times the size that it allows.
    """
    return df.hint("merge")


def clean_up(spark: SparkSession) -> None:
    """Delete all intermediate tables of the application, once its results have been written. The caller decides when:
    a plan that still reads them cannot run afterwards.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
