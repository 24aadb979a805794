"""Event streams: emit, subscribe, filters, corrections, progress, validation and index feeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusworks.operators.validate import validate
from corpusworks.session import scratch_path
from corpusworks.sources.pairs import PAIRS


def stream_table(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream; new files that match the pattern are picked up, so many a batch."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
    return rows.parquet(folder)


def drain(stream: DataFrame, label: str = "stream", mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return the rows it wrote."""
    spark = stream.sparkSession
    path, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", state)
        .trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def emit(df: DataFrame, event: str, fields: list[str]) -> DataFrame:
    """Named event records: event and its fields as JSON."""
    return df.select(F.lit(event).alias("event"), F.to_json(F.struct(*fields)).alias("payload"))


def subscribe(
    stream: DataFrame, event: str, handler: Callable[[DataFrame, int], None], checkpoint: str, **trigger
) -> StreamingQuery:
    """Run handler(batch, batch_id) on the records of one event."""
    chosen = stream.where(F.col("event") == event)
    return (
        chosen.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def stream_filter(stream: DataFrame, where: Column | str) -> DataFrame:
    return stream.where(F.expr(where) if isinstance(where, str) else where)


def stream_corrections(spark: SparkSession, folder: str) -> DataFrame:
    """Corrections as they are appended below adapter=… folders."""
    return spark.readStream.schema(f"{PAIRS}, adapter string, split string").json(folder)


def corrections_per_adapter(corrections: DataFrame) -> DataFrame:
    """Running count per adapter, for complete or update mode."""
    return corrections.groupBy("adapter").agg(F.count("*").alias("rows"))


def progress_windows(rows: DataFrame, good: Column, ts: str = "ts", width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """good, failed and done per time window; the watermark lets finished windows be appended."""
    stream = rows.withWatermark(ts, late) if rows.isStreaming else rows
    return (
        stream.groupBy(F.window(ts, width))
        .agg(F.count_if(good).alias("good"), F.count_if(~good).alias("failed"), F.count("*").alias("done"))
        .select(F.col("window.start").alias("start"), "good", "failed", "done")
    )


def validate_stream(compiled: DataFrame) -> DataFrame:
    """The batch validator as it is: it keeps no state."""
    return validate(compiled)


def dirty_feed(changes: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Feed index changes: on_batch writes the next index version from a batch of changed module ids."""
    return (
        changes.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
