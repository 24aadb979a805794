"""State across several micro-batches, and streams equal to their batch twins."""

import random

from pyspark.sql import functions as F

from corpusworks.session import scratch_path
from corpusworks.streaming import events as E
from corpusworks.streaming import stateful as S


def feed(spark, tmp_path, batches, schema):
    """A file stream that delivers one batch per file."""
    folder = str(tmp_path / "feed")
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def collected(stream, mode):
    rows = []
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda b, n: rows.append([tuple(r) for r in b.collect()])).option(
        "checkpointLocation", scratch_path(stream.sparkSession, "state")
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows


def test_retry_budget_over_batches(spark, tmp_path):
    schema = "block_id bigint, profile string, at bigint, success boolean"
    sql, rust = "sql_postgres", "rust_axum"  # 2 and 4 retries
    batches = [
        [(1, sql, -30, False), (1, sql, -20, False), (2, sql, 10, False), (3, rust, -10, False), (3, rust, 0, False), (3, rust, 1, False)],
        [(1, sql, -10, False), (2, sql, 20, True), (3, rust, 2, False)],
        [(1, sql, -15, True), (2, sql, 30, False), (3, rust, 3, False)],  # a late success takes back the failures before it
    ]
    out = collected(S.retry_budget_state(feed(spark, tmp_path, batches, schema)), "update")
    by_batch = [dict(b) for b in out if b]
    assert by_batch == [{1: False, 2: False, 3: False}, {1: True, 2: False, 3: False}, {1: False, 2: False, 3: True}]


def test_cache_over_batches(spark, tmp_path):
    schema = "key bigint, row_id bigint, at bigint, is_get boolean, value double"
    batches = [
        [(1, 0, 10, False, 5.0), (1, 1, 12, True, None), (1, 2, 9, True, None)],
        [(1, 3, 19, True, None), (1, 4, 20, True, None), (2, 5, 20, True, None)],
        [(1, 6, 30, False, 6.0), (1, 7, 30, True, None)],
    ]
    out = collected(S.cache_state(feed(spark, tmp_path, batches, schema), ttl=10), "append")
    answers = {row_id: value for batch in out for _, row_id, value in batch}
    assert answers[1] == 5.0 and answers[3] == 5.0 and answers[7] == 6.0
    assert all(v is None or v != v for v in (answers[2], answers[4], answers[5]))


def plain_cache(batches, ttl):
    """Answer each get from all sets of its batch and the earlier ones."""
    sets, answers = [], {}
    for rows in batches:
        sets += [(at, row_id, key, value) for key, row_id, at, is_get, value in rows if not is_get]
        for key, row_id, at, is_get, _ in rows:
            if is_get:
                before = [s for s in sets if s[2] == key and s[0] <= at]
                last = max(before, default=None)
                answers[row_id] = last[3] if last and at < last[0] + ttl else None
    return answers


def answered(stream):
    return {row_id: None if value != value else value for batch in collected(stream, "append") for _, row_id, value in batch}


def test_cache_equals_plain_lookups(spark, tmp_path):
    """Several batches without order, one key with a third of the rows, sets that outlive their slice, ties, late gets."""
    draw, ttl = random.Random(5), 1000
    rows = [(0 if draw.random() < 0.34 else draw.randint(1, 9), n, draw.randrange(-3000, 40_000) // 3 * 3, draw.random() < 0.5, None) for n in range(3000)]
    rows = [(k, n, at, g, None if g else float(n)) for k, n, at, g, _ in rows]
    batches = [rows[:1000], rows[1000:1800], rows[1800:]]
    for width in (None, 1000, 3500):
        folder = tmp_path / str(width)
        folder.mkdir()
        stream = feed(spark, folder, batches, "key bigint, row_id bigint, at bigint, is_get boolean, value double")
        assert answered(S.cache_state(stream, ttl, width)) == plain_cache(batches, ttl)


def test_slices_are_freed_by_event_time(spark, tmp_path):
    """Once the watermark is past a slice its state is gone; what comes later than that is not answered."""
    day, ttl = 86_400_000_000, 3_600_000_000
    schema = "key bigint, row_id bigint, at bigint, is_get boolean, value double"
    batches = [[(1, n, d * day + 1, False, float(d)) for n, d in enumerate(range(3 * b, 3 * b + 3))] for b in range(4)]
    batches[1].append((1, 50, 2 * day + 5, True, None))  # a day late, in time
    batches[3].append((1, 51, 0 * day + 5, True, None))  # beyond the watermark: dropped
    batches[3].append((1, 52, 11 * day + 5, True, None))
    stream, states = feed(spark, tmp_path, batches, schema), []
    query = S.cache_state(stream, ttl, width=day, late="2 days").writeStream.outputMode("append").format("noop").option(
        "checkpointLocation", scratch_path(spark, "state")
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    states = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(states) <= 2 * 6 + 2 and states[-1] <= 2 * 4  # twelve days of sets went through
    (tmp_path / "again").mkdir()
    got = answered(S.cache_state(feed(spark, tmp_path / "again", batches, schema), ttl, width=day, late="2 days"))
    assert got == {50: 2.0, 52: 11.0}


def test_cache_of_a_hot_key_in_one_batch(spark, tmp_path):
    """More rows of a key than an Arrow chunk holds, shuffled: every get sees the set just before it."""
    draw = random.Random(1)
    rows = [(1, n, n // 2, n % 2 == 1, None if n % 2 else float(n)) for n in range(40_000)]
    draw.shuffle(rows)
    schema = "key bigint, row_id bigint, at bigint, is_get boolean, value double"
    answers = answered(S.cache_state(feed(spark, tmp_path, [rows], schema), ttl=1, width=500))
    assert len(answers) == 20_000 and all(v == n - 1 for n, v in answers.items())


def test_cache_of_many_keys_needs_few_states(spark, tmp_path):
    """Keys share states, so their number does not grow with the keys; answers stay those of each key, without one too."""
    draw = random.Random(2)
    rows = [(draw.choice([None, *range(700)]), n, draw.randrange(1000), draw.random() < 0.5) for n in range(4000)]
    rows = [(k, n, at, g, None if g else float(n)) for k, n, at, g in rows]
    schema = "key bigint, row_id bigint, at bigint, is_get boolean, value double"
    calls = spark.sparkContext.accumulator(0)

    class Counted(S.Cache):
        def handleInputRows(self, *a):
            calls.add(1)
            return super().handleInputRows(*a)

    plain, S.Cache = S.Cache, Counted
    try:
        got = answered(S.cache_state(feed(spark, tmp_path, [rows], schema), ttl=1000, width=1000, buckets=4))
    finally:
        S.Cache = plain
    assert got == plain_cache([rows], 1000) and calls.value <= 2 * 5


def test_windows_equal_batch(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    good = F.col("event_type") != "error"
    batch = sorted(map(tuple, E.progress_windows(events, good, width="6 hours").collect()))
    source = E.stream_table(spark, sf, "events.parquet", spark.read.parquet(f"{sf}/events.parquet").schema)
    stream = source.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = collected(E.progress_windows(stream, good, width="6 hours"), "complete")[-1]
    assert sorted(rows) == batch
