"""What the text operators share: reading tables, lasting cuts of lineage, language names."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings of languages in the tables, and the code they mean.
LANGUAGES = {
    "en": "en", "english": "en", "zh": "zh", "中文": "zh", "chinese": "zh", "de": "de", "deutsch": "de", "german": "de",
    "fr": "fr", "français": "fr", "francais": "fr", "french": "fr", "es": "es", "español": "es", "espanol": "es", "spanish": "es",
}


_shipped: set[str] = set()
_local: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that they need no copy of it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}_code.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language(column: Column) -> Column:
    """One code per language: region suffixes, case and names folded; null or unknown is 'und'."""
    base = F.lower(F.trim(F.regexp_extract(column, r"^\s*([^-_]*)", 1)))
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(known[base], F.lit("und"))


def content() -> Column:
    """The content of a record: retrieval_text where it is not null, otherwise text."""
    return F.coalesce(F.col("retrieval_text"), F.col("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); in local mode, where there is but one machine, a temporary one if none is set."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not there and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not there:
        app = spark.sparkContext.applicationId
        there = _local[app] = _local.get(app) or tempfile.mkdtemp(prefix="spark-")
    return there


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes a table into the shared folder and reads it, so that lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/chunkloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Has the driver collect its garbage: only then does Spark delete the shuffle files of steps that are over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
