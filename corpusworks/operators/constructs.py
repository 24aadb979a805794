"""The data statements of the block language as DataFrame operators."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusworks.functions.scalars import AGGREGATES, MERGEABLES, TRANSFORMS
from corpusworks.operators.numbering import dense_positions
from corpusworks.session import materialise


def _condition(where: Column | str) -> Column:
    return F.expr(where) if isinstance(where, str) else where


# --- reading and changing tables --------------------------------------------------------------
def query(df: DataFrame, where: Column | str, limit: int | None = None, order_by: list | None = None) -> DataFrame:
    out = df.where(_condition(where))
    out = out.orderBy(*order_by) if order_by else out
    return out if limit is None else out.limit(limit)


def persist_insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows, allowMissingColumns=True)


def persist_update(df: DataFrame, changes: dict[str, Column], where: Column | str) -> DataFrame:
    hit = F.coalesce(_condition(where), F.lit(False))
    return df.withColumns({c: F.when(hit, new).otherwise(F.col(c)) for c, new in changes.items()})


def returning(df: DataFrame, changes: dict[str, Column], where: Column | str) -> DataFrame:
    """Only the updated rows, as RETURNING gives them."""
    return df.where(_condition(where)).withColumns(changes)


def persist_delete(df: DataFrame, where: Column | str) -> DataFrame:
    return df.where(~F.coalesce(_condition(where), F.lit(False)))


def upsert(df: DataFrame, rows: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows replace those of equal key; keys must be unique in ``rows``."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(rows.select(*keys), keys, "left_anti").select(*df.columns).unionByName(rows)


def audit_append(df: DataFrame, audit: DataFrame, action: str, key: str, at: Column) -> DataFrame:
    """The audit table with one more row per mutated row."""
    entries = df.select(F.lit(action).alias("action"), F.col(key).cast("string").alias("row_key"), at.alias("at"))
    return audit.unionByName(entries)


def archive_move(df: DataFrame, condition: Column | str) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): two complementary filters, so every row is in exactly one."""
    old = F.coalesce(_condition(condition), F.lit(False))
    return df.where(~old), df.where(old)


def all_or_nothing(df: DataFrame, txn: str, ok: Column | str) -> DataFrame:
    """Rows of transactions whose rows are all valid.

    Only the keys of failed transactions travel (distinct before the shuffle), so a transaction
    that holds a third of all rows is not gathered in one task.
    """
    valid = F.coalesce(_condition(ok), F.lit(False))
    failed = df.where(~valid).select(F.col(txn).alias("_failed")).distinct()
    return df.join(failed, F.col(txn).eqNullSafe(F.col("_failed")), "left_anti")


# --- pages ----------------------------------------------------------------------------------------
@dataclass(frozen=True)
class _Key:
    """One column of a row order."""

    name: str
    down: bool
    nulls_first: bool

    @staticmethod
    def of(item: str | Column, df: DataFrame) -> _Key:
        if isinstance(item, str):
            return _Key(item, False, True)
        shown = re.fullmatch(r"Column<'(.*?)(?: (ASC|DESC) NULLS (FIRST|LAST))?'>", str(item))
        if shown is None or shown[1] not in df.columns:
            raise ValueError(f"pages are ordered by columns; add {item} as one")
        return _Key(shown[1], shown[2] == "DESC", shown[3] != "LAST")

    def sorted(self) -> Column:
        c = F.col(self.name)
        if self.down:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()

    def before(self, bound) -> Column:
        """Whether a row's value comes before the bound."""
        c = F.col(self.name)
        if bound is None:
            return F.lit(False) if self.nulls_first else c.isNotNull()
        ahead = F.coalesce(c > F.lit(bound) if self.down else c < F.lit(bound), F.lit(False))
        return c.isNull() | ahead if self.nulls_first else ahead


def _before(keys: list[_Key], bound: tuple) -> Column:
    """Whether a row comes before the bound, by its first key that differs from it."""
    ahead, same = F.lit(False), F.lit(True)
    for key, value in zip(keys, bound, strict=True):
        ahead = ahead | (same & key.before(value))
        same = same & F.col(key.name).eqNullSafe(F.lit(value))
    return ahead


def _range_of(keys: list[_Key], bounds: list[tuple], first: int = 0) -> Column:
    """How many of the bounds a row has reached, found by halving."""
    if not bounds:
        return F.lit(first)
    middle = len(bounds) // 2
    low, high = _range_of(keys, bounds[:middle], first), _range_of(keys, bounds[middle + 1 :], first + middle + 1)
    return F.when(_before(keys, bounds[middle]), low).otherwise(high)


#: Bounds per level of counts, and rows of a range that one sort takes.
BOUNDS, SORTED = 48, 20_000


def _page(df: DataFrame, order: list, page: int, size: int, take: int) -> tuple[DataFrame, int]:
    """Rows of the page and the number of all rows."""
    keys = [_Key.of(item, df) for item in order]
    names, rows, first = [k.name for k in keys], df, (page - 1) * size
    total = left = df.count()
    if first >= total:
        return df.limit(0), total
    while left > take:
        # the sample only chooses bounds; counts, and so the page, are exact
        draw = F.pmod(F.xxhash64(*names, F.lit(left)), F.lit(1 << 30)) < max(1, int(BOUNDS * 8 / left * (1 << 30)))
        seen = rows.where(draw).select(*names).distinct().orderBy(*[k.sorted() for k in keys]).collect()
        bounds = [tuple(r) for r in seen[:: max(1, len(seen) // BOUNDS)]]
        counts = {r.part: r["count"] for r in rows.groupBy(_range_of(keys, bounds).alias("part")).count().collect()}
        low, before = 0, 0
        while before + counts.get(low, 0) <= first:
            before += counts.get(low, 0)
            low += 1
        high, held = low, counts.get(low, 0)
        while before + held < min(first + size, left) and high < len(bounds):
            high += 1
            held += counts.get(high, 0)
        if held == left:
            break
        if low:
            rows = rows.where(~_before(keys, bounds[low - 1]))
            if not keys[0].down and bounds[low - 1][0] is not None and keys[0].nulls_first:
                rows = rows.where(F.col(names[0]) >= F.lit(bounds[low - 1][0]))  # in a form that reaches the scan
        if high < len(bounds):
            rows = rows.where(_before(keys, bounds[high]))
        first, left = first - before, held
    return rows.orderBy(*[k.sorted() for k in keys]).offset(first).limit(size), total


def paginate(df: DataFrame, order: list, page: int, size: int, take: int = SORTED) -> DataFrame:
    """Page ``page`` (from 1) of ``size`` rows in a total order of columns, each ascending or descending.

    Rows are counted between bounds on the order's columns, then between closer bounds in the range that holds the
    page, until ``take`` rows or fewer are left (or rows that are equal in all of these columns); only they are
    sorted. Each level is a scan of the order's columns, so a deep page costs what the first one does, and rows are
    neither shuffled nor written. paginate_after() needs no counts.
    """
    return _page(df, order, page, size, take)[0]


def paginate_after(df: DataFrame, key: str, last, size: int) -> DataFrame:
    """The page after a known key: the filter reaches the scan and only ``size`` rows are kept."""
    return df.where(F.col(key) > F.lit(last)).orderBy(key).limit(size)


def page_envelope(df: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """Items of a page with total_count and page beside them; an empty page gives no rows."""
    rows, total = _page(df, order, page, size, SORTED)
    return rows.withColumns({"total_count": F.lit(total).cast("bigint"), "page": F.lit(page)})


# --- aggregates -------------------------------------------------------------------------------------
def aggregate(df: DataFrame, by: list[str], compute: dict[str, tuple[str, str]]) -> DataFrame:
    """compute: output name → (function name, column); names come from the AGGREGATES registry."""
    return df.groupBy(*by).agg(*[AGGREGATES[fn.upper()](F.col(c) if c != "*" else F.lit(1)).alias(out)
                                 for out, (fn, c) in compute.items()])


#: Groups whose states a task holds before it passes them on, and parts that a group's states are merged in.
HELD, PARTS = 20_000, 32


def aggregate_merging(df: DataFrame, by: list[str], fn: str, col: str, out: str) -> DataFrame:
    """by and ``out``: an aggregate with a state of its own, from the MERGEABLES registry.

    Tasks turn the rows they read into one bounded state per group and pass states on, not rows. States are merged
    in PARTS parts per group, then across parts, so no task gathers a group however many rows or tasks it has.
    """
    kind = MERGEABLES[fn.upper()]
    keys = df.select(*by).schema
    names = [f"_by{i}" for i in range(len(by))]
    fields = [T.StructField(n, f.dataType) for n, f in zip(names, keys.fields, strict=True)]
    schema = T.StructType([*fields, T.StructField("_part", T.IntegerType()), T.StructField("_state", T.ArrayType(T.DoubleType()))])
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col(col).cast("double").alias("_value"))

    def states(held: dict, part: int) -> pd.DataFrame:
        columns = list(zip(*held, strict=True)) or [()] * len(names)
        # null keys stay null whatever their type
        table = {n: pd.Series(list(c), dtype=object) for n, c in zip(names, columns, strict=True)}
        # without groups the column must still be one of lists
        found = pd.Series([list(map(float, s)) for s in held.values()], dtype=object)
        return pd.DataFrame({**table, "_part": part, "_state": found})

    def partial(batches):
        held, part = {}, TaskContext.get().partitionId() % PARTS  # the same when a task is run again
        for batch in batches:
            for key, values in batch.groupby(names, dropna=False)["_value"] if names else [((), batch["_value"])]:
                key = tuple(None if pd.isna(k) else k for k in key)
                state = kind.partial(values.dropna().to_numpy(dtype=float))
                held[key] = kind.merge(held[key], state) if key in held else state
            if len(held) > HELD:
                yield states(held, part)
                held = {}
        yield states(held, part)

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        state = functools.reduce(kind.merge, map(np.asarray, rows["_state"]))
        return rows.iloc[:1].assign(_state=[list(map(float, state))])

    def finished(rows: pd.DataFrame) -> pd.DataFrame:
        state = functools.reduce(kind.merge, map(np.asarray, rows["_state"]))
        return rows.iloc[:1][names].assign(_out=[kind.finish(state)])

    some = rows.mapInPandas(partial, schema).groupBy(*names, "_part").applyInPandas(merged, schema)
    done = some.groupBy(*names).applyInPandas(finished, T.StructType([*fields, T.StructField("_out", T.DoubleType())]))
    return done.select(*[F.col(n).alias(c) for n, c in zip(names, by, strict=True)], F.col("_out").alias(out))


def aggregate_having(df: DataFrame, by: list[str], aggs: list[Column], having: Column | str) -> DataFrame:
    return df.groupBy(*by).agg(*aggs).where(_condition(having))


def aggregate_where(df: DataFrame, by: list[str], conditions: dict[str, Column]) -> DataFrame:
    """Count of rows per condition, all in one pass."""
    return df.groupBy(*by).agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def collect_where(df: DataFrame, condition: Column | str) -> DataFrame:
    """The rows meeting a condition; kept as rows, since a collected list has no size bound."""
    return df.where(_condition(condition))


def aggregate_join(
    fact: DataFrame, dims: list[tuple[DataFrame, Column]], by: list[str], aggs: list[Column], where: Column | None = None
) -> DataFrame:
    """Join fact with each (dimension, condition), filter, group and aggregate."""
    joined = fact
    for dim, on in dims:
        joined = joined.join(dim, on)
    joined = joined if where is None else joined.where(where)
    return joined.groupBy(*by).agg(*aggs)


def bucket_counts(df: DataFrame, rules: list[tuple[str, Column]], other: str) -> DataFrame:
    """Rows per computed class; the first rule that holds names the class."""
    bucket = F.lit(other)
    for name, condition in reversed(rules):
        bucket = F.when(condition, name).otherwise(bucket)
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def string_agg(df: DataFrame, by: list[str], col: str, order: list[str], sep: str = ", ") -> DataFrame:
    """Pieces (by, pos, piece) of the values joined per key in a total order; null values are left out.

    Read in the order of ``pos`` (from 1) the pieces are the joined text: every piece but the first
    starts with the separator. A key's rows are numbered by a spread sort and stay rows whatever
    their number.
    """
    values = df.where(F.col(col).isNotNull()).select(*dict.fromkeys([*by, col, *order]))
    numbered = dense_positions(values, order, by=by, name="pos")
    text = F.col(col).cast("string")
    return numbered.select(*by, "pos", F.when(F.col("pos") == 1, text).otherwise(F.concat(F.lit(sep), text)).alias("piece"))


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: str, min_weight: float) -> DataFrame:
    """mean(v), Σ v·w / Σ w and the count, over rows whose weight reaches the minimum."""
    v, w = F.col(value), F.col(weight)
    return (
        df.where(w >= min_weight)
        .groupBy(*by)
        .agg(F.avg(v).alias("mean"), F.try_divide(F.sum(v * w), F.sum(w)).alias("weighted"), F.count("*").alias("n"))
    )


def ratio_metrics(df: DataFrame, by: list[str], hit: Column, score: Column) -> DataFrame:
    """Share of hits and mean score per group."""
    n = F.count("*")
    return df.groupBy(*by).agg(
        n.alias("n"), F.try_divide(F.count_if(hit), n).alias("hit_ratio"), F.try_divide(F.sum(score), n).alias("score_ratio")
    )


def trending(df: DataFrame, dim: str, score: str, having: int, k: int) -> DataFrame:
    """Top k groups by average score among those with more than ``having`` rows."""
    groups = df.groupBy(dim).agg(F.count("*").alias("n"), F.avg(score).alias("average"))
    return groups.where(F.col("n") > having).orderBy(F.desc("average"), dim).limit(k)


# --- values ------------------------------------------------------------------------------------------
def transform(df: DataFrame, col: str, using: list[str] | str, out: str | None = None) -> DataFrame:
    """Apply a chain of named functions from the TRANSFORMS registry to a column."""
    value = F.col(col)
    for name in [using] if isinstance(using, str) else using:
        value = TRANSFORMS[name](value)
    return df.withColumn(out or col, value)


def loop(df: DataFrame, items: str, var: str, fn: Callable[[Column], Column] | None = None) -> DataFrame:
    """Without fn: one row per item (rows with empty lists stay, item null). With fn: map the list."""
    if fn is None:
        return df.withColumn(var, F.explode_outer(items))
    return df.withColumn(var, F.transform(items, fn))


def if_then_else(condition: Column, then: Column, otherwise: Column) -> Column:
    return F.when(condition, then).otherwise(otherwise)


def fallback(primary: DataFrame, backup: DataFrame, key: str, ok: Column | str) -> DataFrame:
    """Primary rows that succeeded, else the backup row of the key; ``source`` tells which."""
    good = primary.where(F.coalesce(_condition(ok), F.lit(False)))
    rest = backup.join(good.select(key), key, "left_anti").select(*primary.columns)
    return good.withColumn("source", F.lit("primary")).unionByName(rest.withColumn("source", F.lit("backup")))


def recent(df: DataFrame, ts: str, now: Column, interval: str) -> DataFrame:
    return df.where(F.col(ts) > now - F.expr(f"interval {interval}"))


def in_list(df: DataFrame, col: str, values: list) -> DataFrame:
    return df.where(F.col(col).isin(values))


def observe(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """Count around a step without a second pass: read the Observation after an action."""
    seen = Observation()
    return df.observe(seen, *[m.alias(name) for name, m in metrics.items()]), seen


def search_rank(df: DataFrame, text: str, needle: str, score: Column, n: int, tie: str) -> DataFrame:
    """Rows containing the needle in any letter case, best score first."""
    hits = df.where(F.lower(F.col(text)).contains(needle.lower()))
    return hits.withColumn("score", score).orderBy(F.desc("score"), tie).limit(n)


def normalize_band(
    df: DataFrame, col: str, lo: float, hi: float, cuts: tuple[float, float] = (0.33, 0.67)
) -> tuple[DataFrame, DataFrame]:
    """(scaled, rejected): in-range rows with ``scaled`` in [0, 1] and a band, and the others."""
    inside = F.coalesce(F.col(col).between(lo, hi), F.lit(False))
    scaled = (F.col(col) - lo) / (hi - lo)
    band = F.when(scaled < cuts[0], "low").when(scaled < cuts[1], "medium").otherwise("high")
    return df.where(inside).withColumns({"scaled": scaled, "band": band}), df.where(~inside)


def tier_prices(df: DataFrame, rates: DataFrame, key: str, price: str, discounts: dict[str, float]) -> DataFrame:
    """Add the converted price and a struct of tier prices; ``rates`` holds (key, rate)."""
    converted = F.col(price) * F.coalesce(F.col("rate"), F.lit(1.0))
    tiers = F.struct(*[(F.col("converted") * (1 - d)).alias(name) for name, d in discounts.items()])
    return df.join(rates.select(key, "rate"), key, "left").withColumn("converted", converted).withColumn("prices", tiers)


def normalize_events(df: DataFrame, payload: str, schema: str, kind: str, source: str) -> DataFrame:
    """JSON payload → flat record: type, source, the parsed data's fields and a checksum."""
    return (
        df.withColumn("_data", F.from_json(payload, schema))
        .select(
            *[c for c in df.columns if c not in (payload, kind)],
            F.col(kind).alias("type"),
            F.lit(source).alias("source"),
            "_data.*",
            F.sha2(F.col(payload), 256).alias("checksum"),
        )
    )


# --- lookups and joins ---------------------------------------------------------------------------------
def cache_lookup(
    gets: DataFrame, sets: DataFrame, key: str = "key", ts: str = "ts", value: str = "value", ttl: str = "1 hour"
) -> DataFrame:
    """Each get with the value of the latest set at or before it, null when none or expired.

    An as-of join without pairing rows, as a prefix scan: gets and sets are stacked and range-partitioned by key and
    time, so a busy key, hour or instant spreads over as many partitions as its rows need. A running window carries
    the latest set inside a partition; across partitions only the last set of each key travels. A set counts before
    a get of the same instant. Of sets at one instant the largest value counts. Null keys meet no set.
    ``gets`` may hold further columns; ``sets`` needs key, ts and value. The stacked rows are written once, so that
    partitions stay what they are.
    """
    extra = [c for c in gets.columns if c not in (key, ts)]
    entry = F.struct(F.col(ts).alias("set_ts"), F.col(value).alias("v")).alias("_set")
    puts = sets.where(F.col(key).isNotNull()).select(key, ts, entry, F.lit(0).alias("_kind"))
    asks = gets.select(key, ts, F.lit(1).alias("_kind"), F.struct(*extra).alias("_more") if extra else F.lit(None).cast("string").alias("_more"))
    stacked = puts.unionByName(asks, allowMissingColumns=True)
    tie = F.xxhash64("_more") if extra else F.rand(7)
    placed = stacked.withColumn("_tie", tie).repartitionByRange(key, ts, "_kind", "_set", "_tie").withColumn("_part", F.spark_partition_id())
    placed = materialise(placed.drop("_tie"), "lookups")

    last_sets = placed.where("_kind = 0").groupBy(key, "_part").agg(F.max("_set").alias("_last"))
    parts = last_sets.unionByName(placed.where("_kind = 1").select(key, "_part").distinct(), allowMissingColumns=True)
    parts = parts.groupBy(key, "_part").agg(F.max("_last").alias("_last"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(key, "_part", F.last("_last", ignorenulls=True).over(earlier).alias("_carried")).where("_carried is not null")

    running = Window.partitionBy("_part", key).orderBy(ts, "_kind", "_set").rowsBetween(Window.unboundedPreceding, 0)
    found = placed.withColumn("_here", F.last("_set", ignorenulls=True).over(running)).where("_kind = 1")
    joined = found.join(carried, ["_part", key], "left")
    latest = F.coalesce("_here", "_carried")
    alive = F.col(ts) < latest.set_ts + F.expr(f"interval {ttl}")
    return joined.select(key, ts, *[F.col("_more")[c].alias(c) for c in extra], F.when(alive, latest.v).alias(value))


def cached_report(computed: DataFrame, cache: DataFrame, params: list[str], now: Column, ttl: str) -> DataFrame:
    """Report rows with key and expiry; unexpired cached rows of the same key are reused.

    ``cache`` has the columns of the result: those of ``computed`` plus report_key and expires_at.
    """
    keyed = computed.withColumns(
        {
            "report_key": F.concat_ws("|", *[F.col(p).cast("string") for p in params]),
            "expires_at": now + F.expr(f"interval {ttl}"),
        }
    )
    alive = cache.where(F.col("expires_at") > now).join(keyed.select("report_key"), "report_key", "left_semi")
    fresh = keyed.join(alive.select("report_key"), "report_key", "left_anti").select(*keyed.columns)
    return alive.select(*keyed.columns).withColumn("reused", F.lit(True)).unionByName(
        fresh.withColumn("reused", F.lit(False))
    )


def semi_in(df: DataFrame, keys: DataFrame, on: str, key: str | None = None) -> DataFrame:
    """Rows whose value is among the keys (IN, EXISTS)."""
    listed = keys.select(F.col(key or on).alias("_key"))
    return df.join(listed, F.col(on) == F.col("_key"), "left_semi")


def not_in(df: DataFrame, keys: DataFrame, on: str, key: str | None = None, sql_nulls: bool = False) -> DataFrame:
    """Rows whose value is not among the keys.

    By default nulls among the keys are ignored and rows with a null value stay. With sql_nulls the
    result is that of SQL NOT IN: a null among the keys gives no rows, and null values drop out.
    """
    listed = keys.select(F.col(key or on).alias("_key"))
    out = df.join(listed.where("_key is not null"), F.col(on) == F.col("_key"), "left_anti")
    if not sql_nulls:
        return out
    # One row that tells whether the list is empty and whether it holds a null.
    facts = listed.agg(F.count("*").alias("_size"), F.count_if(F.col("_key").isNull()).alias("_nulls"))
    kept = (F.col("_size") == 0) | ((F.col("_nulls") == 0) & F.col(on).isNotNull())
    return out.join(F.broadcast(facts)).where(kept).drop("_size", "_nulls")


def equi_join(a: DataFrame, b: DataFrame, on: list[str] | Column, where: Column | None = None) -> DataFrame:
    joined = a.join(b, on, "inner")
    return joined if where is None else joined.where(where)


def scalar_lookup(df: DataFrame, dim: DataFrame, on: str, value: str, default) -> DataFrame:
    """Looked-up value per row or the default; dim must hold each key once."""
    looked = df.join(dim.select(on, value), on, "left")
    return looked.withColumn(value, F.coalesce(F.col(value), F.lit(default)))
