"""Profile catalogs in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusworks import fixed
from corpusworks.operators.routing import with_adapter_ids
from corpusworks.sources.pairs import path_exists

CATALOG = (
    "base_model string, adapter_repo string, "
    "phases map<string,struct<adapters:array<string>,description:string>>, "
    "adapters map<string,struct<phase:int,threshold:double,pairs:bigint>>"
)


def _read(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], CATALOG)
    return spark.read.schema(CATALOG).option("multiLine", True).json(path)


def read_adapter_catalog(spark: SparkSession, path: str) -> DataFrame:
    """profile, phase, threshold, pairs, adapter_id, base_model; missing values take the defaults
    and a missing file gives no rows."""
    rows = _read(spark, path).select("base_model", "adapter_repo", F.explode("adapters").alias("profile", "entry"))
    rows = rows.select(
        "profile",
        F.coalesce("entry.phase", F.lit(fixed.DEFAULT_PHASE)).alias("phase"),
        F.coalesce("entry.threshold", F.lit(fixed.DEFAULT_THRESHOLD)).alias("threshold"),
        F.coalesce("entry.pairs", F.lit(fixed.DEFAULT_PAIRS)).cast("bigint").alias("pairs"),
        F.col("adapter_repo").alias("_repo"),
        F.coalesce("base_model", F.lit(fixed.BASE_MODEL)).alias("_base"),
    )
    return with_adapter_ids(rows, F.col("_repo"), F.col("_base")).drop("_repo", "_base")


def read_phase_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row per phase and profile, with the phase's description."""
    rows = _read(spark, path).select(F.explode("phases").alias("phase", "entry"))
    return rows.select(
        F.col("phase").cast("int").alias("phase"), F.explode("entry.adapters").alias("profile"),
        F.col("entry.description").alias("description"),
    )
