"""Keyed state across micro-batches: retry budgets and a cache with expiry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusworks.operators.routing import tier_value

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_KEY = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark) -> None:
    """Stateful processors need a store with column families; an existing choice other than the
    default in-memory one is kept."""
    if not spark.conf.get(STORE_KEY, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(STORE_KEY, ROCKSDB)


class RetryBudget(StatefulProcessor):
    """Whether a block's failures since its last success use up its budget.

    Rows of a batch may arrive in any order, so the state keeps times, not a counter: the last
    success, and the latest failures after it. A first attempt and ``budget`` retries decide the
    question, so budget + 1 failures are kept, which bounds the state however often a block fails.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("retries", "last_success bigint, failures array<bigint>, budget int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, failures, budget = self.state.get() if self.state.exists() else (None, [], 0)
        failures = list(failures)
        for pdf in rows:
            budget = max(budget, int(pdf["budget"].max()))
            wins = pdf.loc[pdf["success"], "at"]
            if not wins.empty:
                last = int(wins.max()) if last is None else max(last, int(wins.max()))
            failures = sorted([*failures, *pdf.loc[~pdf["success"], "at"].tolist()])
            failures = [t for t in failures if last is None or t > last][-(budget + 1) :]
        self.state.update((last, [int(t) for t in failures], budget))
        yield pd.DataFrame({"block_id": [key[0]], "escalate": [len(failures) > budget]})

    def close(self) -> None:
        pass


def retry_budget_state(stream: DataFrame, profile: str = "profile") -> DataFrame:
    """block_id, profile, at (bigint time), success → after each batch: whether the budget of the
    profile's tier is used up, that is, the first attempt and all retries since the last success failed.

    A profile of no tier has no retries. The largest budget seen for a block counts.
    """
    use_rocksdb(stream.sparkSession)
    budget = F.coalesce(tier_value(F.col(profile), 2).cast("int"), F.lit(0)).alias("budget")
    return stream.select("block_id", "at", "success", budget).groupBy("block_id").transformWithStateInPandas(
        statefulProcessor=RetryBudget(),
        outputStructType="block_id bigint, escalate boolean",
        outputMode="Update",
        timeMode="None",
    )


class Cache(StatefulProcessor):
    """The sets of the keys of one bucket in one time slice; gets of the slice are answered with them."""

    def __init__(self, ttl: int, width: int, timed: bool):
        self.ttl, self.width, self.timed = ttl, width, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sets = handle.getListState("sets", "key bigint, at bigint, row_id bigint, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start = key[1] * self.width
        new, asked, earlier = [], [], None
        for pdf in rows:  # no order across chunks: sets and gets are told apart, rows themselves are not kept
            gets = pdf["is_get"].to_numpy(dtype=bool)
            asked.append(pdf.loc[gets, ["of", "at", "row_id"]].to_numpy(dtype=np.int64))
            puts = pdf.loc[~gets, ["of", "at", "row_id", "value"]]
            before = (puts["at"] < start).to_numpy()
            new.append(puts[~before])
            if before.any():  # of the slice before this one only the latest set of a key counts
                last = puts[before] if earlier is None else pd.concat([earlier, puts[before]])
                earlier = last.sort_values(["of", "at", "row_id"]).drop_duplicates("of", keep="last")
        asked = np.concatenate(asked)
        added = [
            (int(k), int(a), int(r), float(v))
            for part in (new if earlier is None else [*new, earlier])
            for k, a, r, v in part.itertuples(index=False, name=None)
        ]
        if len(asked):
            known = [tuple(r) for r in self.sets.get()] if self.sets.exists() else []
            yield self.answers(key[0] == NO_KEY, asked, known + added)
        if added:
            self.sets.appendList(added)
            if self.timed:  # once the watermark is past the slice, no get of it can come
                self.handle.registerTimer((key[1] + 1) * self.width // 1000)

    def answers(self, no_key: bool, asked: np.ndarray, sets: list[tuple]) -> pd.DataFrame:
        out = np.full(len(asked), np.nan)
        if sets:
            keys, at, ids, values = (np.array(c, dtype=t) for c, t in zip(zip(*sets, strict=True), (np.int64,) * 3 + (float,), strict=True))
            n = len(keys)
            keys, at = np.concatenate([keys, asked[:, 0]]), np.concatenate([at, asked[:, 1]])
            # sets and gets of a key in one order, a get behind the sets of its instant; the last set before it answers
            order = np.lexsort((np.concatenate([ids, asked[:, 2]]), np.arange(len(keys)) >= n, at, keys))
            place = np.maximum.accumulate(np.where(order < n, np.arange(len(order)), -1))
            hit = np.flatnonzero((order >= n) & (place >= 0))
            get, put = order[hit], order[place[hit]]
            good = (keys[get] == keys[put]) & (at[get] < at[put] + self.ttl)
            out[get[good] - n] = values[put[good]]
        return pd.DataFrame({"key": None if no_key else asked[:, 0], "row_id": asked[:, 2], "value": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.sets.clear()
        return iter([])

    def close(self) -> None:
        pass


#: The bucket of rows without a key.
NO_KEY = -1


def cache_state(stream: DataFrame, ttl: int, width: int | None = None, late: str | None = None, buckets: int = 128) -> DataFrame:
    """key, row_id, at (bigint time in microseconds), is_get, value → one row per get.

    A get is answered with the latest set at or before it, of those that arrived in earlier batches or its own, if
    less than ``ttl`` has passed between them; gets that come late too. Of sets at one instant the larger row_id
    counts.

    State is kept per time slice of ``width`` (24 times ``ttl`` by default, ``ttl`` at least) and one of ``buckets``
    that keys are dealt to, so a busy key spreads over its slices, and the cost of a state, which is that of many
    rows, does not come with each key. A set that outlives its slice also goes to the next one, which needs no more
    than the latest of a key. A task holds one bucket's sets of a slice, and of its gets the instants of one batch;
    choose ``buckets``, ``width`` and the source's maxFilesPerTrigger so that they fit.

    With ``late`` a slice is freed by an event-time timer as soon as the watermark, that far behind the latest
    instant seen, has passed it; rows older than the watermark are dropped. Without it all slices are kept: for runs
    over a closed log.
    """
    use_rocksdb(stream.sparkSession)
    width = 24 * ttl if width is None else width
    if width < ttl:
        raise ValueError("a slice must not be shorter than the time to live")
    own = F.floor(F.col("at") / width).cast("bigint")
    outlives = ~F.col("is_get") & (F.col("at") + ttl > (own + 1) * width)
    dealt = stream.withColumn("_slice", F.explode(F.when(outlives, F.array(own, own + 1)).otherwise(F.array(own))))
    if late is not None:
        dealt = dealt.withColumn("_instant", F.timestamp_micros("at")).withWatermark("_instant", late)
    bucket = F.when(F.col("key").isNull(), NO_KEY).otherwise(F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    dealt = dealt.withColumns({"_bucket": bucket, "of": F.coalesce(F.col("key"), F.lit(0)).cast("bigint")})
    return dealt.groupBy("_bucket", "_slice").transformWithStateInPandas(
        statefulProcessor=Cache(ttl, width, late is not None),
        outputStructType="key bigint, row_id bigint, value double",
        outputMode="Append",
        timeMode="None" if late is None else "EventTime",
    )
