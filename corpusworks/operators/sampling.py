"""Quotas, draws, splits and row selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusworks import fixed
from corpusworks.functions import text as T
from corpusworks.functions.draws import draw, uniform_choice
from corpusworks.operators.numbering import dense_positions
from corpusworks.session import materialise


def construct_schedule(needs: DataFrame, seed: int | str, by: str = "adapter", need: str = "need") -> DataFrame:
    """Work orders: (by, construct, slot) rows, ``need`` per group.

    Each high-frequency construct gets min(100, need div 22) rows and each other one 50; random
    constructs fill up to need, or the drawn order cuts down to it. Every group's rows are made by
    the tasks that hold its (group, construct) rows, and the slots are numbered by a spread sort.
    """
    n_constructs = len(fixed.CONSTRUCTS)
    high = F.least(F.lit(fixed.HIGH_FREQUENCY_QUOTA).cast("bigint"), F.floor(F.col(need) / n_constructs))
    base = high * len(fixed.HIGH_FREQUENCY) + fixed.CONSTRUCT_QUOTA * (n_constructs - len(fixed.HIGH_FREQUENCY))
    named = F.array(*[F.lit(c) for c in fixed.CONSTRUCTS])
    rows = needs.select(by, need, base.alias("_base"), high.alias("_high"), F.explode(named).alias("construct"))
    quota = F.when(F.col("construct").isin(fixed.HIGH_FREQUENCY), F.col("_high")).otherwise(
        F.lit(fixed.CONSTRUCT_QUOTA).cast("bigint")
    )
    fixed_rows = rows.withColumn("_quota", quota).where("_quota > 0").select(
        by, need, "construct", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_quota"))).alias("_n")
    )
    # Padding: one row per missing slot. Chunks keep the generated arrays short.
    missing = needs.select(by, need, F.greatest(F.lit(0).cast("bigint"), F.col(need) - base).alias("_missing"))
    chunk = 10_000
    chunks = missing.where("_missing > 0").select(
        by, need, "_missing",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_missing") - 1) / chunk))).alias("_chunk"),
    )
    first = F.col("_chunk") * chunk + 1
    padding = chunks.select(
        by, need, F.explode(F.sequence(first, F.least(first + (chunk - 1), F.col("_missing")))).alias("_n")
    )
    pad_key = F.concat_ws(":", F.lit("pad"), F.col(by), F.col("_n"))
    padding = padding.select(by, need, uniform_choice(pad_key, fixed.CONSTRUCTS, seed).alias("construct"),
                             (F.col("_n") + 1_000_000).alias("_n"))
    slots = fixed_rows.unionByName(padding)
    slots = slots.withColumn("_draw", draw(F.concat_ws(":", by, "construct", "_n"), seed))
    numbered = dense_positions(slots, ["_draw", "construct", "_n"], by=[by], name="slot")
    return numbered.where(F.col("slot") <= F.col(need)).select(by, "construct", "slot")


def shuffle(df: DataFrame, key: str, seed: int | str) -> DataFrame:
    """Random but repeatable order: a range-partitioned sort by draw, ties by key."""
    return df.orderBy(draw(F.col(key), seed), F.col(key))


def _exact_picks(n_val: int, by: str):
    """Of one group's candidates in drawn order: those that together have exactly n_val rows, or none.

    A candidate is taken if the rest can still be made up from the ones behind it; the sums that can are bits of
    one number per place.
    """
    everything = (1 << (n_val + 1)) - 1

    def picks(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_draw", "_key"], kind="stable")
        sizes, reach = rows["_n"].tolist(), [1]
        for n in reversed(sizes):
            reach.append((reach[-1] | reach[-1] << n) & everything)
        reach.reverse()
        left, taken = n_val, []
        if reach[0] >> n_val & 1:
            for place, n in enumerate(sizes):
                taken.append(n <= left and bool(reach[place + 1] >> (left - n) & 1))
                left -= n if taken[-1] else 0
        return rows.loc[taken if taken else [False] * len(rows), [by, "_key"]]

    return picks


def split_train_val(
    pairs: DataFrame,
    n_val: int = fixed.VALIDATION_PAIRS,
    seed: int | str = 0,
    by: str = "adapter",
    prompt: str = "prompt",
) -> DataFrame:
    """Add ``split``: all copies of a prompt fall on one side within their ``by`` group.

    Copies are counted first (partial counts before the shuffle, keys instead of texts). Where some prompts have
    exactly n_val rows together, such a set is taken: prompts in drawn order, each one that leaves a rest that the
    later ones can make up. Of a number of copies at most n_val div that number of prompts are ever needed, so
    n_val log n_val prompts per group decide. Where no set fits, prompts are taken in drawn order until n_val rows
    are reached: the last one overshoots, a group with fewer rows validates whole, and split_sizes() reports it.
    The list of chosen prompts is written out, so that the planner knows its size: it is broadcast while it is
    small, and the texts are not shuffled then.
    """
    keyed = pairs.withColumn("_key", T.text_key(F.col(prompt)))
    groups = keyed.groupBy(by, "_key").agg(F.count("*").alias("_n")).withColumn(
        "_draw", draw(F.lower(F.hex("_key")), seed)
    )
    groups = materialise(groups, "prompt-groups")
    in_order = Window.partitionBy(by).orderBy("_draw", "_key")
    # The limits are pushed below the shuffle as per-task ones, which bounds each group.
    first = groups.withColumn("_place", F.row_number().over(in_order)).where(F.col("_place") <= n_val)
    before = F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    first = first.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < n_val).select(by, "_key")
    alike = Window.partitionBy(by, "_n").orderBy("_draw", "_key")
    few = groups.where(F.col("_n") <= n_val).withColumn("_place", F.row_number().over(alike)).where(F.col("_place") <= n_val)
    few = few.where(F.col("_place") * F.col("_n") <= n_val).select(by, "_key", "_n", "_draw")
    exact = materialise(few.groupBy(by).applyInPandas(_exact_picks(n_val, by), few.select(by, "_key").schema), "exact")
    settled = exact.select(F.col(by).alias("_by")).distinct()
    others = first.join(settled, F.col(by).eqNullSafe(F.col("_by")), "left_anti")
    chosen = exact.unionByName(others).select(F.col(by).alias("_by"), F.col("_key").alias("_chosen"))
    chosen = materialise(chosen, "validation")
    matched = keyed.join(chosen, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_key") == F.col("_chosen")), "left")
    split = F.when(F.col("_chosen").isNotNull(), "validation").otherwise("train")
    return matched.withColumn("split", split).drop("_key", "_by", "_chosen")


def split_sizes(split: DataFrame, n_val: int = fixed.VALIDATION_PAIRS, by: str = "adapter") -> DataFrame:
    """Rows on each side per group, and by how many the validation side exceeds n_val."""
    sizes = split.groupBy(by).agg(
        F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "validation").alias("validation")
    )
    return sizes.withColumn("overshoot", F.greatest(F.lit(0).cast("bigint"), F.col("validation") - n_val))


def micro_batches(df: DataFrame, key: str, size: int = fixed.BATCH_SIZE) -> DataFrame:
    """Add ``batch`` and ``place``: consecutive groups of ``size`` in key order."""
    numbered = dense_positions(df, [key], name="_pos")
    return numbered.withColumns(
        {
            "batch": F.floor((F.col("_pos") - 1) / size),
            "place": ((F.col("_pos") - 1) % size).cast("int"),
        }
    ).drop("_pos")


def checkpoint_numbers(df: DataFrame, key: str, every: int = fixed.CHECKPOINT_EVERY) -> DataFrame:
    """Add ``checkpoint``: number of the write batch a row falls into, ``every`` rows each."""
    numbered = dense_positions(df, [key], name="_pos")
    return numbered.withColumn("checkpoint", F.floor((F.col("_pos") - 1) / every)).drop("_pos")


def block_number(letter: str, number: Column) -> Column:
    """f0007 style ids: at least four digits."""
    return F.format_string(f"{letter}%04d", number.cast("bigint"))


def next_ids(existing: DataFrame, new: DataFrame, order: str, key: str = "id", letter: str = "f") -> DataFrame:
    """Add ``key`` to new rows: numbers go on after the largest existing one."""
    number = F.regexp_extract(F.col(key), rf"^{letter}(\d+)$", 1)
    last = existing.agg(F.coalesce(F.max(F.when(number != "", number.cast("bigint"))), F.lit(0)).alias("_last"))
    numbered = dense_positions(new, [order], name="_pos")
    joined = numbered.join(F.broadcast(last))  # one row by construction
    return joined.withColumn(key, block_number(letter, F.col("_last") + F.col("_pos"))).drop("_last", "_pos")


def first_occurrence(pairs: DataFrame, key: str = "idx", prompt: str = "prompt") -> DataFrame:
    """Keep the row with the smallest key of each duplicate prompt; rows without a prompt all stay.

    ``key`` is unique. Prompt keys are written once beside the row keys; rows are compared by them,
    copies collapse in the partial aggregate, and only the list of later copies meets the full rows.
    """
    keyed = pairs.where(F.col(prompt).isNotNull()).select(key, T.text_key(F.col(prompt)).alias("_key"))
    keyed = materialise(keyed, "prompt-keys")
    groups = keyed.groupBy("_key").agg(F.min(key).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    later = keyed.join(groups, "_key").where(F.col(key) != F.col("_first")).select(key)
    return pairs.join(later, key, "left_anti")


def modules_ordered(modules: DataFrame) -> DataFrame:
    return modules.orderBy("id")


def blocks_of_module(blocks: DataFrame, module_id: str) -> DataFrame:
    return blocks.where(F.col("module_id") == module_id).orderBy("id")


def lookup(df: DataFrame, value: str, key: str = "id") -> DataFrame:
    return df.where(F.col(key) == value)


def top_k_per_group(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """At most k rows per group; the limit also runs before the shuffle (window group limit)."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)
