"""Training pairs as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS = (
    "system string, prompt string, completion string, "
    "metadata struct<category:string,adapter:string,construct:string,idx:int,block_id:string,"
    "block_name:string,failing_checks:array<string>,timestamp:string>"
)
CORRUPT = "_corrupt_record"


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every non-blank line with its fields; lines that are not JSON objects fill _corrupt_record.

    A field of another type than expected is null and its line is kept. Lines are read as text and
    parsed by an expression, so that counts and filters on the corrupt column alone work as on any other.
    """
    schema = f"{PAIRS}, {CORRUPT} string"
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"{schema}, file string")
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    lines = spark.read.text(path).where(F.trim("value") != "")
    is_object = F.ltrim("value").startswith("{") & F.try_parse_json("value").isNotNull()
    corrupt = F.when(~is_object, F.col("value")).alias(CORRUPT)
    rows = lines.select(parsed.alias("row"), corrupt, F.col("_metadata.file_path").alias("file"))
    fields = [F.when(F.col(CORRUPT).isNull(), F.col(f"row.{f}")).alias(f) for f in ("system", "prompt", "completion", "metadata")]
    return rows.select(*fields, CORRUPT, "file")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Readable lines only; a missing path gives no rows. Missing keys are null."""
    return read_lines(spark, path).where(F.col(CORRUPT).isNull()).drop(CORRUPT, "file")


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines read_pairs leaves out."""
    return read_lines(spark, path).where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"))


def _clustered(rows: DataFrame, files: int) -> DataFrame:
    """Rows of an (adapter, split) folder together, in ``files`` files at the most; a hot folder keeps that many writers."""
    return rows.repartition("adapter", "split", F.pmod(F.xxhash64("prompt"), F.lit(files)))


def write_pairs(df: DataFrame, path: str, mode: str = "overwrite", files: int = 8) -> None:
    """One JSON object per line below adapter=…/split=…; null fields are left out."""
    rows = df.withColumn("adapter", F.col("metadata.adapter")) if "adapter" not in df.columns else df
    rows = rows if "split" in rows.columns else rows.withColumn("split", F.lit("train"))
    _clustered(rows, files).write.mode(mode).partitionBy("adapter", "split").json(path)


def append_corrections(df: DataFrame, path: str, files: int = 8, compression: str | None = None) -> None:
    """Append correction pairs below adapter=…/split=corrections; earlier files stay untouched.

    Lines repeat their texts, so with ``compression`` ("gzip") files are much smaller; Spark reads both kinds, also
    side by side, but their names no longer end in .json.
    """
    rows = df.withColumns({"adapter": F.col("metadata.adapter"), "split": F.lit("corrections")})
    _clustered(rows, files).write.mode("append").partitionBy("adapter", "split").json(path, compression=compression)


#: Finds adapter and kind in the paths of write_pairs and append_corrections, and in flat adapter/kind.jsonl.
LAYOUT = r"/(?:adapter=)?([^/=]+)/(?:split=)?(train|val|validation|corrections)(?:\.jsonl$|/[^/]+$)"


def file_counts(spark: SparkSession, pattern: str, adapters: DataFrame, layout: str = LAYOUT) -> DataFrame:
    """Rows per adapter and file kind (train, validation, corrections) in the files that match the
    pattern; missing files count 0. ``layout`` finds adapter and kind in a file path, and both
    names of the validation file are understood."""
    kinds = F.array(*[F.lit(k) for k in ("train", "validation", "corrections")])
    grid = adapters.select("adapter", F.explode(kinds).alias("kind"))
    if not path_exists(spark, pattern):
        return grid.withColumn("rows", F.lit(0).cast("bigint"))
    path = F.col("_metadata.file_path")
    kind = F.regexp_extract(path, layout, 2)
    lines = spark.read.text(pattern).where(F.trim("value") != "").select(
        F.regexp_extract(path, layout, 1).alias("adapter"), F.when(kind == "val", "validation").otherwise(kind).alias("kind")
    )
    counts = lines.groupBy("adapter", "kind").agg(F.count("*").alias("rows"))
    return grid.join(counts, ["adapter", "kind"], "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("bigint")))
