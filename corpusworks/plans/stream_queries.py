"""Streams over the event log and the corpus, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusworks.operators import index as I
from corpusworks.operators.validate import validate
from corpusworks.plans.check_queries import ALL_CHECKED
from corpusworks.plans.inputs import compiled, table, view
from corpusworks.plans.registry import register
from corpusworks.plans.index_queries import SEEDS, base, closure
from corpusworks.session import scratch_path
from corpusworks.sources import files
from corpusworks.sources.pairs import append_corrections
from corpusworks.streaming import events as E
from corpusworks.streaming import stateful as S


def event_stream(spark, sf) -> DataFrame:
    return E.stream_table(spark, sf, "events.parquet", table(spark, sf, "events").schema)


@register("stream_filter", "select event_id, user_id, value from events where event_type = 'purchase' and value > 5")
def stream_filter(spark, sf) -> DataFrame:
    rows = E.stream_filter(event_stream(spark, sf), "event_type = 'purchase' and value > 5")
    return E.drain(rows.select("event_id", "user_id", "value"), "purchases")


@register(
    "emit_subscribe",
    "select event_id, value from events where event_type = 'signup' union all select event_id, -value from events where event_type = 'error'",
)
def emit_subscribe(spark, sf) -> DataFrame:
    """Publish two events to a record log; one handler per event writes what it gets."""
    log, out = scratch_path(spark, "events"), scratch_path(spark, "handled")
    rows = event_stream(spark, sf)
    emitted = E.emit(rows.where("event_type = 'signup'"), "user_signed_up", ["event_id", "value"]).unionByName(
        E.emit(rows.where("event_type = 'error'"), "failed", ["event_id", "value"])
    )
    emitted.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "emit-state")).trigger(availableNow=True).start(log).awaitTermination()

    def handler(sign: int):
        def handle(batch: DataFrame, batch_id: int) -> None:
            record = F.from_json("payload", "event_id bigint, value double")
            rows = batch.select(record.alias("r")).select("r.event_id", (F.col("r.value") * sign).alias("value"))
            rows.write.mode("overwrite").parquet(f"{out}/sign={sign}/batch={batch_id}")

        return handle

    for event, sign in (("user_signed_up", 1), ("failed", -1)):
        records = spark.readStream.schema(emitted.schema).parquet(log)
        E.subscribe(records, event, handler(sign), scratch_path(spark, "subscribe-state")).awaitTermination()
    return spark.read.parquet(f"{out}/*/*").select("event_id", "value")


@register(
    "progress_windows",
    """select date_trunc('hour', ts)::timestamp as start, count(*) filter (where event_type <> 'error') as good, count(*) filter (where event_type = 'error') as failed, count(*) as done
       from events group by 1""",
)
def progress_windows(spark, sf) -> DataFrame:
    """Complete mode over hour windows, so that the last open window counts too."""
    stream = event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = scratch_path(spark, "windows")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id:06d}")

    counted = E.progress_windows(stream, F.col("event_type") != "error", width="1 hour")
    query = counted.writeStream.outputMode("complete").foreachBatch(keep).option(
        "checkpointLocation", scratch_path(spark, "windows-state")
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    # Every batch holds the whole result so far; the last one counts.
    rows = spark.read.parquet(out)
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), "batch").select(F.col("start").cast("timestamp_ntz").alias("start"), "good", "failed", "done")


@register("corrections_stream", "select profile as adapter, count(*) as rows from compiled group by 1", ["compiled"])
def corrections_stream(spark, sf) -> DataFrame:
    from corpusworks.operators.rendering import render_correction
    from corpusworks.plans.text_queries import failed_rows

    path, out = scratch_path(spark, "corrections"), scratch_path(spark, "counts")
    append_corrections(render_correction(failed_rows(spark, sf), F.expr("timestamp_ntz'2024-02-01'")), path, compression="gzip")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id:06d}")

    counts = E.corrections_per_adapter(E.stream_corrections(spark, path))
    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", scratch_path(spark, "counts-state")).trigger(
        availableNow=True
    ).start().awaitTermination()
    rows = spark.read.parquet(out)
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), "batch").select("adapter", "rows")


# Users' blocks are dealt to three tiers with 2, 3 and 4 retries.
BUDGETS = [("sql_postgres", 2), ("python_fastapi", 3), ("rust_axum", 4)]


@register(
    "retry_budget_state",
    """with w as (select user_id, max(case when event_type = 'purchase' then ts end) as won from events where event_type in ('error', 'purchase') group by 1)
       select user_id as block_id, count(*) filter (where event_type = 'error' and (won is null or ts > won)) > user_id % 3 + 2 as escalate
       from events join w using (user_id) where event_type in ('error', 'purchase') group by 1""",
)
def retry_budget_state(spark, sf) -> DataFrame:
    """Errors are failed attempts of a user's block, purchases are successes."""
    profiles = F.array(*[F.lit(p) for p, _ in BUDGETS])
    rows = event_stream(spark, sf).where("event_type in ('error', 'purchase')").select(
        F.col("user_id").alias("block_id"),
        F.element_at(profiles, (F.col("user_id") % 3).cast("int") + 1).alias("profile"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        (F.col("event_type") == "purchase").alias("success"),
    )
    out = scratch_path(spark, "retries")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id:06d}")

    S.retry_budget_state(rows).writeStream.outputMode("update").foreachBatch(keep).option(
        "checkpointLocation", scratch_path(spark, "retries-state")
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("block_id").agg(F.max_by("escalate", "batch").alias("escalate"))


@register(
    "cache_state",
    """select g.event_id, g.user_id, case when g.ts < s.ts + interval 1 hour then s.value end as value
       from (select * from events where event_type = 'view') g asof left join (select * from events where event_type = 'click') s on g.user_id = s.user_id and g.ts >= s.ts""",
)
def cache_state(spark, sf) -> DataFrame:
    """The streaming twin of cache_lookup: clicks set a value, views get it within the hour."""
    rows = event_stream(spark, sf).where("event_type in ('view', 'click')").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("row_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        (F.col("event_type") == "view").alias("is_get"), "value",
    )
    answers = E.drain(S.cache_state(rows, ttl=3_600_000_000, late="3660 days"), "cache")
    return answers.select(F.col("row_id").alias("event_id"), F.col("key").alias("user_id"), "value")


@register("validate_stream", f"{ALL_CHECKED} select doc_id, passed from seven", ["compiled"])
def validate_stream(spark, sf) -> DataFrame:
    """Compilations are validated as they arrive: the batch validator on a stream."""
    path = scratch_path(spark, "compiled")
    compiled(spark, sf).write.parquet(path)
    rows = spark.readStream.schema(compiled(spark, sf).schema).parquet(path)
    return E.drain(validate(rows).select("doc_id", "passed"), "validated")


@register("dirty_feed", f"with recursive {SEEDS}, {closure()} select m.id, m.id in (select id from reached) as dirty from modules m", ["modules", "deps", "blocks"])
def dirty_feed(spark, sf) -> DataFrame:
    """Changed module ids arrive as a stream; each batch writes the next version of the buckets it touches."""
    index = base(spark, sf, dirty=False)
    feed = scratch_path(spark, "feed")
    modules = files.BucketedTable(scratch_path(spark, "feed-modules"), "id")
    blocks = files.BucketedTable(scratch_path(spark, "feed-blocks"), "module_id")
    index.modules.where("namespace = 'app.Brand#7'").select("id").write.parquet(feed)
    modules.write(index.modules, 0)
    blocks.write(index.blocks, 0)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        # Batch n turns version n into version n + 1, so a repeated batch gives the same versions.
        I.mark_dirty_buckets(modules, blocks, index.deps, batch, batch_id)

    changes = spark.readStream.schema("id string").option("maxFilesPerTrigger", 100).parquet(feed)
    E.dirty_feed(changes, on_batch, scratch_path(spark, "feed-state")).awaitTermination()
    return modules.read(spark).select("id", "dirty")
