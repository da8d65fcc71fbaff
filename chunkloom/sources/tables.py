"""Reading and writing tables: explicit schemas, JSON lines, manifests, staged writes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOG = T.StructType([
    T.StructField("document_id", T.StringType()), T.StructField("document_title", T.StringType()), T.StructField("source_path", T.StringType()),
    T.StructField("source_url", T.StringType()), T.StructField("include_in_index", T.BooleanType()),
])
CHUNK = "chunk_id string, kind string, seq int, text string, retrieval_text string, metadata struct<document_id:string, document_title:string, source_path:string, source_url:string, section_path:array<string>, image_path:string, visual_type:string, label:string, prev_text_chunk_id:string, next_text_chunk_id:string, caption_chunk_ids:array<string>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A plain scan in at least as many partitions as there are cores; a table of few files is shuffled for that, a large one is left as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); in local mode, where there is but one machine, a temporary one if none is set."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not there and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not there:
        app = spark.sparkContext.applicationId
        there = _local[app] = _local.get(app) or tempfile.mkdtemp(prefix="spark-")
    return there


def kept(rows: DataFrame) -> DataFrame:
    """The rows as a table written into the shared folder: computed once, however often they are used, and safe from lost executors."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/chunkloom-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType = CHUNK) -> DataFrame:
    """Records of JSON lines; a line that does not parse is an error, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_list(spark: SparkSession, path: str, field: str, element: T.StructType) -> DataFrame:
    """The rows of one list in a JSON document."""
    whole = T.StructType([T.StructField(field, T.ArrayType(element))])
    return spark.read.schema(whole).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode(field).alias("r")).select("r.*")


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, source_path, text) of Markdown files; the id is the file's stem."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text"))
    return files.select(F.regexp_extract("source_path", r"([^/]+)\.[^.]*$", 1).alias("document_id"), "source_path", "text")


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_new(rows: DataFrame, path: str, manifest: DataFrame | None = None) -> None:
    """Writes a table that must not exist yet; the manifest follows last, so that a table without one is not complete."""
    rows.write.mode("errorifexists").parquet(path)
    if manifest is not None:
        manifest.write.mode("errorifexists").json(f"{path.rstrip('/')}.manifest")


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def content_manifest(rows: DataFrame, key: str, body: str) -> DataFrame:
    """(key, rows, bytes, digest) of each key's rows; the digest adds up the bodies' hashes, so it needs no order and no group in one place."""
    part = F.conv(F.substring(F.sha2(F.coalesce(body, F.lit("")), 256), 1, 8), 16, 10).cast("long")
    return rows.groupBy(key).agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.coalesce(body, F.lit("")))).alias("bytes"), F.sum(part).alias("digest"))
