"""Readers and writers for survey, site, log, report and point-cloud files."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.floors import normalize_floor

REFERENCE_IMAGE = ("image_id string, floor string, zone string, x double, y double, orientation int, timestamp string, "
                   "camera_information struct<device:string,focal_length_mm:double,resolution:string>, processed_path string, location_id string")
MISS = ("site_id string, received_at double, device_id string, capture_trigger string, ground_truth_location_id string, ground_truth_in_top_k boolean, "
        "failure_stage string, candidate_count int, candidates array<struct<rank:int,image_id:string,similarity:double,location_id:string,x:double,y:double,"
        "num_matches:int,num_inliers:int,inlier_ratio:double,passed:boolean,timestamp:string>>, client struct<motion_score:double,laplacian_variance:double>, "
        "server_image struct<width:int,height:int,laplacian_variance:double,brightness_mean:double>, vpr_latency_ms double")
EVAL_REPORT = ("embedder string, total_images int, results array<struct<image_id:string,status:string,location_error_m:double,inlier_ratio:double,matched_image_id:string>>, "
               "threshold_sweep array<struct<threshold:double,correct:int,wrong_location:int,no_match:int,correct_rate:double>>")
# Colour of points without one, markers and kiosks defaults.
DEFAULT_RGB = (52, 199, 89)
MARKER_HEIGHT_M, MARKER_SIZE_M, KIOSK_STAND_M, CONNECTOR_PENALTY = 1.4, 0.23, 0.8, 10.0


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) names anything, on any Hadoop file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


# ------------------------------------------------------------------ survey records
def read_reference_images(spark: SparkSession, path: str) -> DataFrame:
    """Survey records, one JSON object per line; an absent file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], REFERENCE_IMAGE)
    df = spark.read.schema(REFERENCE_IMAGE).option("mode", "PERMISSIVE").json(path).where("image_id is not null")
    return df.withColumns({"floor": normalize_floor("floor"), "location_id": F.coalesce("location_id", F.lit(""))})


def append_reference_images(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def overwrite_reference_images(records: DataFrame, path: str) -> None:
    """Replace all records. The table may not be read from the folder it replaces."""
    records.write.mode("overwrite").json(path)


def read_csv(spark: SparkSession, path: str, columns: dict[str, str], comment: str | None = None) -> DataFrame:
    """Headed CSV with tidy names; ``columns`` maps the wanted names to types. Every file goes by its own header,
    so files may differ in their columns and in the order of them."""
    reader = spark.read.option("encoding", "UTF-8")
    if comment:
        reader = reader.option("comment", comment)
    width = spark.read.text(path).select(F.max(F.size(F.split("value", ",")))).first()[0] or 1
    cells = [f"c{i}" for i in range(width)]
    rows = reader.schema(", ".join(f"{c} string" for c in cells)).csv(path).select(
        F.col("_metadata.file_path").alias("file"), F.array(*cells).alias("cells"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"))
    heads = rows.groupBy("file").agg(F.min_by("cells", "at").alias("head"))
    names = F.transform("head", lambda c: F.trim(F.regexp_replace(c, "^\ufeff", "")))
    body = rows.join(heads, "file").where("NOT (cells <=> head)").select("cells", names.alias("names"))
    pick = lambda c: F.nullif(F.trim(F.get("cells", F.nullif(F.array_position("names", c), F.lit(0)) - 1)), F.lit(""))
    return body.select(*[pick(c).cast(t).alias(c) for c, t in columns.items()])


LOCATION = {"location_id": "string", "floor": "string", "zone": "string", "x": "double", "y": "double"}


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in LOCATION.items()))
    return read_csv(spark, path, LOCATION).withColumn("floor", normalize_floor("floor"))


def write_locations(locations: DataFrame, path: str) -> None:
    locations.select(*LOCATION).write.mode("overwrite").option("header", True).csv(path)


PIXEL_TABLES = {
    "control_points": {"pixel_x": "double", "pixel_y": "double", "real_x": "double", "real_y": "double"},
    "locations": {"pixel_x": "double", "pixel_y": "double", "location_id": "string", "floor": "string", "zone": "string"},
    "segments": {"x1": "double", "y1": "double", "x2": "double", "y2": "double", "width": "double"},
    "slots": {"slot_id": "string", "zone": "string", "pixel_x": "double", "pixel_y": "double"},
    "headings": {"location_id": "string", "filename": "string", "heading_degrees": "double"},
    "ordered_headings": {"location_id": "string", "headings": "string"},
}


def read_pixel_csvs(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Floor-plan CSVs: control points, locations, segments, slots, headings."""
    return read_csv(spark, path, PIXEL_TABLES[kind])


# ------------------------------------------------------------------ embeddings
def write_embeddings(df: DataFrame, path: str, version: str) -> None:
    """Vectors with the version of the record set they were made from."""
    df.select("image_id", F.col("embedding").cast("array<float>").alias("embedding"), F.lit(version).alias("dataset_version")).write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("dataset_version") == version) if version else df


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """Twelve hex digits that depend on the records but not on their order or partitioning."""
    h = F.xxhash64(*[F.to_json(F.col(c)) if isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(c) for c in df.columns])
    a = df.select(h.alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))
    text = F.concat_ws(":", F.col("n").cast("string"), F.col("x").cast("string"), F.col("s").cast("string"))
    return a.select(F.left(F.sha1(text), F.lit(12)).alias("version"))


# ------------------------------------------------------------------ site configurations
SITE = ("site_id string, floors array<struct<floor:string,"
        "walkable_segments:array<struct<x1:double,y1:double,x2:double,y2:double,width:double,width_left:double,width_right:double>>,"
        "vehicle_slots:array<struct<slot_id:string,zone:string,x:double,y:double>>,"
        "markers:array<struct<marker_id:string,x:string,y:string,height_m:string,facing_deg:string,size_m:string>>,"
        "kiosks:array<struct<kiosk_id:string,x:string,y:string,facing_deg:string,stand_m:string,marker_id:string>>>>, "
        "vertical_connectors array<struct<connector_id:string,type:string,penalty_cost:double,nodes:map<string,struct<x:double,y:double>>>>")


def _yaml_to_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml
    for b in batches:
        yield pd.DataFrame({"doc": pd.Series([json.dumps(yaml.safe_load(v) or {}, default=str) for v in b["value"]], dtype=object)})


def read_site_configs(spark: SparkSession, glob: str) -> dict[str, DataFrame]:
    """segments, slots, markers, kiosks, connectors and floors of every site file (one YAML per site)."""
    docs = spark.read.text(glob, wholetext=True).mapInPandas(_yaml_to_json, "doc string")
    site = docs.select(F.from_json("doc", SITE).alias("s")).select("s.*")
    fl = site.select("site_id", F.posexplode("floors").alias("pos", "f")).withColumn("floor", normalize_floor("f.floor"))
    part = lambda name, order: fl.select("site_id", "floor", F.posexplode(f"f.{name}").alias(order, "r")).select("site_id", "floor", order, "r.*")
    n = lambda c, d: F.coalesce(F.col(c).try_cast("double"), F.lit(d)) if d is not None else F.col(c).try_cast("double")
    markers = part("markers", "pos").select(
        "site_id", "floor", F.col("marker_id").try_cast("int").alias("marker_id"), n("x", None).alias("x"), n("y", None).alias("y"), n("height_m", MARKER_HEIGHT_M).alias("height_m"),
        F.pmod(n("facing_deg", 0.0), F.lit(360.0)).alias("facing_deg"), n("size_m", MARKER_SIZE_M).alias("size_m")).where("marker_id is not null and x is not null and y is not null")
    kiosks = part("kiosks", "pos").select(
        "site_id", "floor", F.upper(F.trim("kiosk_id")).alias("kiosk_id"), n("x", None).alias("x"), n("y", None).alias("y"), F.pmod(n("facing_deg", 0.0), F.lit(360.0)).alias("facing_deg"),
        n("stand_m", KIOSK_STAND_M).alias("stand_m"), F.col("marker_id").try_cast("int").alias("marker_id")).where("kiosk_id is not null and x is not null and y is not null")
    conn = site.select("site_id", F.explode("vertical_connectors").alias("c")).select(
        "site_id", F.coalesce("c.connector_id", F.lit("connector")).alias("connector_id"), F.coalesce("c.type", F.lit("stairs")).alias("type"),
        F.coalesce("c.penalty_cost", F.lit(CONNECTOR_PENALTY)).alias("penalty_cost"), F.transform_keys("c.nodes", lambda k, v: normalize_floor(k)).alias("nodes"))
    return {"floors": fl.select("site_id", "floor", "pos"), "segments": part("walkable_segments", "seg_no"), "slots": part("vehicle_slots", "pos").drop("pos"),
            "markers": markers, "kiosks": kiosks, "connectors": conn.where(F.size("nodes") >= 2)}


# ------------------------------------------------------------------ logs and reports
LOG = {"timestamp": "string", "floor": "string", "x": "double", "y": "double", "heading": "double", "confidence": "double", "tracking": "boolean", "latency_ms": "int", "trigger": "string",
       "source": "string", "step_count": "int", "steps_since_fix": "int", "drift_m": "double"}


def read_live_log(spark: SparkSession, path: str) -> DataFrame:
    """Capture logs of either shape; the short one holds camera fixes only."""
    df = read_csv(spark, path, LOG, comment="#")
    at = F.try_to_timestamp("timestamp")
    source = F.coalesce("source", F.when(F.col("tracking"), "VPR").otherwise("VPR_MISS"))
    return df.withColumns({"ts": F.coalesce(at, F.timestamp_micros((F.col("timestamp").try_cast("double") * 1e6).cast("long"))), "floor": normalize_floor("floor"), "source": source})


def read_misses(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(MISS).json(path)


def read_client_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Known fields as columns, everything else kept in ``body`` (VARIANT)."""
    lines = (spark.readStream if stream else spark.read).text(path).where(F.trim("value") != "")
    v = lines.select(F.try_parse_json("value").alias("body")).where("body is not null")
    get = lambda f, t: F.try_variant_get("body", f"$.{f}", t).alias(f)
    return v.select(get("site_id", "string"), get("received_at", "double"), get("device_id", "string"), get("event", "string"), get("reason", "string"), "body")


def read_eval_reports(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """(result rows, sweep rows) of all evaluation reports, with their file name."""
    r = spark.read.schema(EVAL_REPORT).option("multiLine", True).json(glob).withColumn("report", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return r.select("report", F.inline("results")), r.select("report", F.inline("threshold_sweep"))


# ------------------------------------------------------------------ point clouds
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def read_point_cloud(spark: SparkSession, path: str) -> DataFrame:
    """ASCII point rows ``x y z [r g b]``; header lines are not numeric and drop out."""
    line = F.trim(F.regexp_replace("value", r"\s+", " "))
    rows = spark.read.text(path).select(line.alias("l")).where(F.col("l").rlike(rf"^{NUMBER} {NUMBER} {NUMBER}( .*)?$"))
    p = F.split("l", " ")
    rgb = lambda i: F.when(F.size(p) >= 6, F.get(p, F.lit(3 + i)).cast("int")).otherwise(F.lit(DEFAULT_RGB[i]))
    return rows.select(*[F.get(p, F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")], *[rgb(i).alias(c) for i, c in enumerate("rgb")])


def write_point_cloud(df: DataFrame, path: str) -> None:
    """Finite points as text parts plus a header file that sorts first.

    The header needs the point count, so points are counted once; parts stay distributed.
    """
    ok = F.lit(True)
    for c in "xyz":
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = df.where(ok)
    rgb = [F.coalesce(F.col(c), F.lit(d)) if c in df.columns else F.lit(d) for c, d in zip("rgb", DEFAULT_RGB)]
    text = F.format_string("%.4f %.4f %.4f %d %d %d", "x", "y", "z", *[c.cast("int") for c in rgb])
    good.select(text.alias("value")).write.mode("overwrite").text(path)
    head = ["ply", "format ascii 1.0", f"element vertex {good.count()}", *[f"property float {c}" for c in "xyz"],
            *[f"property uchar {c}" for c in ("red", "green", "blue")], "end_header"]
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path, "header.ply")
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(("\n".join(head) + "\n").encode()))
    out.close()


def per_floor_export(df: DataFrame, path: str, keys: Sequence[str] = ("site_id", "floor_id")) -> None:
    """One folder per site and floor; hot floors are spread over several files by row count."""
    df.write.mode("overwrite").option("maxRecordsPerFile", 5_000_000).partitionBy(*keys).parquet(path)
