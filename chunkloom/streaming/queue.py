"""The job queue as streams: idempotent submission and windowed load."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import shared_folder


def arriving(spark: SparkSession, path: str, files_each: int | None = None) -> DataFrame:
    """A table's files as a stream, be it a folder or one file; files_each bounds how many a batch takes."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_each:
        reader = reader.option("maxFilesPerTrigger", files_each)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, a single file is taken too


def drained(stream: DataFrame, spark: SparkSession, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream until what is there is read, and returns the table it wrote in the shared folder.

    Without keys rows are appended.  With keys every batch writes the rows that
    changed, and the last one of each key counts.
    """
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if keys:
        save = lambda rows, batch: rows.withColumn("__batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
        out = out.outputMode("update").foreachBatch(save)
    else:
        out = out.outputMode("append").format("parquet").option("path", f"{path}/rows")
    out.start().awaitTermination()
    if not keys:
        return spark.read.schema(stream.schema).parquet(f"{path}/rows")
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("__batch", T.LongType())])).parquet(f"{path}/rows/*")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("r")).select(*keys, "r.*")


def submitted_once(jobs: DataFrame, lateness: str = "7 days") -> DataFrame:
    """The first row of each job that arrives; rows sent again within ``lateness`` of the first by time of receipt are dropped, in state that is kept no longer."""
    return jobs.filter("job_id IS NOT NULL").withWatermark("received_at", lateness).dropDuplicatesWithinWatermark(["job_id"])


def hourly_load(jobs: DataFrame, lateness: str = "60 days") -> DataFrame:
    """(hour, status, jobs) by the time of creation; jobs that come later than ``lateness`` are not counted, and the state is kept no longer."""
    w = jobs.filter("created_at IS NOT NULL").withWatermark("created_at", lateness).groupBy(F.window("created_at", "1 hour"), "status").agg(F.count("*").alias("jobs"))
    return w.select(F.unix_seconds("window.start").alias("hour"), "status", "jobs")
