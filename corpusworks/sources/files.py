"""Source files and versioned tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusworks.sources.pairs import path_exists


def read_sources(spark: SparkSession, glob: str) -> DataFrame:
    """One row per file: path and whole text."""
    return spark.read.text(glob, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("source")
    )


def write_pieces(pieces: DataFrame, folder: str, key: str, pos: str, text: str) -> None:
    """Write each key's pieces into ``folder``/key=…, in the order of ``pos``.

    Read by name, a key's files give its text: tasks hold consecutive ranges of (key, pos), so a long
    text spreads over many files and none is gathered. Pieces must end with a line break, which the
    writer puts back after each one.
    """
    placed = pieces.repartitionByRange(key, pos).sortWithinPartitions(key, pos)
    line = F.regexp_replace(text, r"\n\z", "").alias("value")
    placed.select(key, line).write.partitionBy(key).text(folder)


def write_version(df: DataFrame, root: str, version: int, retry: bool = False) -> str:
    """Write one numbered version of a table. A version is never overwritten, so a job may read
    the latest one while it writes the next. With ``retry`` a version that a failed attempt left
    behind is written again; the writer then reads an earlier version by number."""
    path = f"{root}/v={version:08d}"
    df.write.mode("overwrite" if retry else "errorifexists").parquet(path)
    return path


def latest_version(spark: SparkSession, root: str) -> int | None:
    """Number of the newest complete version (its success mark exists), or None."""
    pattern = f"{root}/v=*/_SUCCESS"
    if not path_exists(spark, pattern):
        return None
    target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    marks = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return max(int(m.getPath().getParent().getName().removeprefix("v=")) for m in marks)


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    version = latest_version(spark, root) if version is None else version
    return spark.read.parquet(f"{root}/v={version:08d}")


@dataclass(frozen=True)
class BucketedTable:
    """A table cut by a hash of ``key`` into ``buckets``, of which each version holds only those it changed.

    Version n lies in ``root``/v=n/_bucket=b; a bucket's rows are those of its newest version up to the one that is
    read. Versions are never changed, so a job may read one while it writes the next, and a repeated job writes the
    same files again. Version 0 holds all buckets. Choose ``buckets`` so that one is worth a rewrite; it stays the
    same for the life of a table.
    """

    root: str
    key: str
    buckets: int = 64

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def write(self, df: DataFrame, version: int, retry: bool = False) -> None:
        """Write the buckets that ``df`` has rows of; they must be whole. A large bucket is spread over files."""
        placed = df.withColumn("_bucket", self.bucket_of(F.col(self.key))).hint("rebalance", "_bucket")
        placed.write.partitionBy("_bucket").mode("overwrite" if retry else "errorifexists").parquet(f"{self.root}/v={version:08d}")

    def newest(self, spark: SparkSession, version: int) -> dict[int, str]:
        """Folder of each bucket's rows at a version."""
        pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/v=*/_bucket=*")
        found: dict[int, tuple[int, str]] = {}
        for status in pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []:
            path = status.getPath()
            at, bucket = int(path.getParent().getName().removeprefix("v=")), int(path.getName().removeprefix("_bucket="))
            if at <= version and at >= found.get(bucket, (-1, ""))[0]:
                found[bucket] = (at, path.toString())
        return {bucket: path for bucket, (_, path) in found.items()}

    def read(self, spark: SparkSession, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The table at a version (by default the newest complete one), or only some of its buckets."""
        version = latest_version(spark, self.root) if version is None else version
        schema = spark.read.parquet(f"{self.root}/v={0:08d}").drop("_bucket").schema
        paths = [path for bucket, path in sorted(self.newest(spark, version).items()) if only is None or bucket in only]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def compact(self, spark: SparkSession, version: int, root: str) -> BucketedTable:
        """The table at a version as version 0 of a new root, when many versions have come together."""
        fresh = BucketedTable(root, self.key, self.buckets)
        fresh.write(self.read(spark, version), 0)
        return fresh
