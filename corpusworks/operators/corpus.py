"""Corpus audits: leakage, coverage, mix, duplicates, rates, progress and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusworks import fixed
from corpusworks.functions import text as T
from corpusworks.functions.tokens import token_count
from corpusworks.operators.routing import with_tier


def _keys(pairs: DataFrame, by: list[str], prompt: str) -> DataFrame:
    """Distinct prompt keys; copies collapse in the partial aggregate before any shuffle."""
    return pairs.select(*by, T.text_key(F.col(prompt)).alias("prompt_key")).distinct()


def leaked_keys(train: DataFrame, valid: DataFrame, by: list[str] = (), prompt: str = "prompt") -> DataFrame:
    """Prompt keys present in both sides (set intersection); empty for a clean split."""
    return _keys(train, by, prompt).intersect(_keys(valid, by, prompt))


def _leaked_rows(rows: DataFrame, others: DataFrame, key: str, by: list[str], prompt: str) -> DataFrame:
    """(key, prompt_key) of the rows whose prompt is among the others': no text is shuffled, a prompt
    with many copies meets one row, and AQE splits a hot key of the left side."""
    narrow = rows.select(key, *by, T.text_key(F.col(prompt)).alias("prompt_key"))
    return narrow.join(leaked_keys(rows, others, by, prompt), [*by, "prompt_key"], "left_semi").select(key, "prompt_key")


def leakage(train: DataFrame, valid: DataFrame, key: str, by: list[str] = (), prompt: str = "prompt") -> DataFrame:
    """Validation rows whose prompt also trains, with the prompt's key. ``key`` is unique in ``valid``."""
    return valid.join(_leaked_rows(valid, train, key, by, prompt), key)


def without_leakage(train: DataFrame, valid: DataFrame, key: str, by: list[str] = (), prompt: str = "prompt") -> DataFrame:
    """Training rows whose prompt is not in the validation side. ``key`` is unique in ``train``."""
    return train.join(_leaked_rows(train, valid, key, by, prompt).select(key), key, "left_anti")


def split_leakage(pairs: DataFrame, by: str = "adapter", prompt: str = "prompt") -> DataFrame:
    """Distinct prompts per group and how many of them are on both sides of ``split``: one pass over
    the texts, one shuffle of keys."""
    keys = pairs.groupBy(by, T.text_key(F.col(prompt)).alias("prompt_key")).agg(
        F.max(F.col("split") == "train").alias("_train"), F.max(F.col("split") == "validation").alias("_valid")
    )
    return keys.groupBy(by).agg(
        F.count("*").alias("prompts"), F.count_if(F.col("_train") & F.col("_valid")).alias("leaked")
    )


def duplicate_prompts(pairs: DataFrame, key: str = "idx", prompt: str = "prompt") -> DataFrame:
    """Prompts that occur more than once: key, copies and the first row."""
    groups = pairs.where(F.col(prompt).isNotNull()).groupBy(T.text_key(F.col(prompt)).alias("prompt_key")).agg(
        F.count("*").alias("copies"), F.min(key).alias("first_row")
    )
    return groups.where("copies > 1")


def category_mix(pairs: DataFrame) -> DataFrame:
    """Share of each category per adapter, with the target share and the deviation from it."""
    counts = pairs.groupBy("adapter", "category").agg(F.count("*").alias("n"))
    totals = counts.groupBy("adapter").agg(F.sum("n").alias("total"))
    target = F.create_map(*[F.lit(x) for share in fixed.CATEGORY_SHARES for x in share])
    # Counts are at most adapters × categories rows, whatever the corpus size.
    return (
        counts.join(totals, "adapter")
        .withColumn("share", F.col("n") / F.col("total"))
        .withColumn("target", target[F.col("category")])
        .withColumn("deviation", F.col("share") - F.col("target"))
    )


def coverage_grid(adapters: DataFrame) -> DataFrame:
    """Every adapter with every construct, so that zero counts show: an explode of the fixed list."""
    listed = F.array(
        *[
            F.struct(
                F.lit(c).alias("construct"),
                F.lit(fixed.HIGH_FREQUENCY_QUOTA if c in fixed.HIGH_FREQUENCY else fixed.CONSTRUCT_QUOTA)
                .cast("bigint")
                .alias("needed"),
            )
            for c in fixed.CONSTRUCTS
        ]
    )
    return adapters.select("adapter", F.inline(listed))


def construct_coverage(pairs: DataFrame, adapters: DataFrame | None = None) -> DataFrame:
    """Pairs per adapter and construct against the quota, with the shortfall."""
    adapters = pairs.select("adapter").distinct() if adapters is None else adapters
    counts = pairs.groupBy("adapter", "construct").agg(F.count("*").alias("have"))
    grid = coverage_grid(adapters).join(counts, ["adapter", "construct"], "left")
    have = F.coalesce("have", F.lit(0).cast("bigint"))
    return grid.withColumn("have", have).withColumn(
        "shortfall", F.greatest(F.lit(0).cast("bigint"), F.col("needed") - F.col("have"))
    )


def patch_target_coverage(pairs: DataFrame) -> DataFrame:
    """Constructs that no patch pair (category B) of an adapter touches yet show have = 0."""
    adapters = pairs.select("adapter").distinct()
    covered = construct_coverage(pairs.where("category = 'B'"), adapters)
    return covered.select("adapter", "construct", "have", (F.col("have") > 0).alias("covered"))


def pass_rate(validated: DataFrame, by: list[str]) -> DataFrame:
    return validated.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.col("passed").cast("double")).alias("pass_rate")
    )


def tier_pass_rate(validated: DataFrame) -> DataFrame:
    """Pass rate per language tier against the required rate."""
    rated = with_tier(validated).groupBy("tier", "required_rate").agg(
        F.count("*").alias("n"), F.avg(F.col("passed").cast("double")).alias("pass_rate")
    )
    return rated.withColumn("meets", F.col("pass_rate") >= F.col("required_rate"))


def escalation_rate(compiled: DataFrame, escalated: str = "escalated") -> DataFrame:
    """Share of escalated rows per tier against its limit."""
    rated = with_tier(compiled).groupBy("tier", "escalation_limit").agg(
        F.count("*").alias("n"), F.avg(F.col(escalated).cast("double")).alias("escalation_rate")
    )
    return rated.withColumn("within", F.col("escalation_rate") < F.col("escalation_limit"))


def failing_checks(validated: DataFrame, names: list[str] = fixed.CHECK_NAMES) -> DataFrame:
    """Failures per check name, for the names validate() ran: counts in one pass, no explode."""
    counts = [F.count_if(~F.element_at(F.col("checks"), n).passed).alias(name) for n, name in enumerate(names, 1)]
    return validated.agg(*counts).unpivot([], list(names), "name", "failures")


def run_progress(rows: DataFrame, good: Column, ts: str = "ts", by: list[str] = ()) -> DataFrame:
    """good, failed, done and rows per minute between the first and the last row."""
    seconds = F.col("_last") - F.col("_first")
    micros = F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)
    return (
        rows.groupBy(*by)
        .agg(
            F.count_if(good).alias("good"),
            F.count_if(~good).alias("failed"),
            F.count("*").alias("done"),
            F.min(micros).alias("_first"),
            F.max(micros).alias("_last"),
        )
        .withColumn("per_minute", F.when(seconds > 0, F.col("done") / seconds * 60).otherwise(0.0))
        .drop("_first", "_last")
    )


def call_estimate(needs: DataFrame, need: str = "need") -> DataFrame:
    """Generation calls for all missing pairs under the fixed category mix, truncated."""
    per_pair = sum(fixed.CALLS_PER_CATEGORY[c] * share for c, share in fixed.CATEGORY_SHARES)
    return needs.agg(F.coalesce(F.sum(need), F.lit(0)).alias("total_needed")).withColumn(
        "calls", F.floor(F.col("total_needed") * per_pair)
    )


def phase_totals(catalog: DataFrame, cost: str | None = None) -> DataFrame:
    """Pairs per profile, phase and in total; subtotal rows have null profile, the total null phase."""
    aggs = [F.sum("pairs").alias("pairs")] + ([F.sum(cost).alias(cost)] if cost else [])
    return catalog.rollup("phase", "profile").agg(*aggs)


def corpus_status(pairs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Generated against target pairs per adapter."""
    have = pairs.groupBy("adapter").agg(F.count("*").alias("generated"))
    rows = catalog.join(have, F.col("profile") == F.col("adapter"), "left")
    generated = F.coalesce("generated", F.lit(0).cast("bigint"))
    return rows.select(
        "profile", "phase", generated.alias("generated"), F.col("pairs").alias("target"),
        (generated >= F.col("pairs")).alias("complete"),
    )


def phase_status(status: DataFrame) -> DataFrame:
    """Complete adapters of each phase as 'n / total'."""
    counted = status.groupBy("phase").agg(F.count_if("complete").alias("_done"), F.count("*").alias("_all"))
    return counted.select("phase", F.concat_ws(" / ", "_done", "_all").alias("progress"))


def length_profile(pairs: DataFrame, text: str = "text", max_tokens: int = fixed.MAX_TOKENS, tokenizer: str | None = None) -> DataFrame:
    """Length distribution per adapter; the percentile is an approximation with bounded memory.

    ``tokenizer`` as in rendering.length_gate.
    """
    tokens = T.token_estimate(F.col(text)) if tokenizer is None else token_count(F.col(text), tokenizer)
    sized_rows = pairs.select(
        "adapter", F.length(text).cast("bigint").alias("chars"), tokens.cast("bigint").alias("tokens")
    )
    return sized_rows.groupBy("adapter").agg(
        F.count("*").alias("n"),
        F.min("chars").alias("min_chars"),
        F.avg("chars").alias("avg_chars"),
        F.max("chars").alias("max_chars"),
        F.percentile_approx("tokens", 0.5, 10_000).alias("median_tokens"),
        F.max("tokens").alias("max_tokens"),
        F.count_if(F.col("tokens") > max_tokens).alias("over_limit"),
    )


def adapter_readiness(
    pairs: DataFrame, rates: DataFrame, catalog: DataFrame, min_pairs: int = fixed.NEW_TARGET_PAIRS,
    min_held_out: int = fixed.VALIDATION_PAIRS,
) -> DataFrame:
    """One row per adapter with a flag per readiness rule: pairs, constructs, threshold.

    ``rates``: adapter, n and pass_rate on held-out pairs.
    """
    counts = pairs.groupBy("adapter").agg(F.count("*").alias("pairs"))
    covered = (
        construct_coverage(pairs).groupBy("adapter").agg(F.min(F.col("have") > 0).alias("all_constructs"))
    )
    limits = catalog.select(F.col("profile").alias("adapter"), "threshold")
    return (
        limits.join(counts, "adapter", "left")
        .join(covered, "adapter", "left")
        .join(rates.select("adapter", F.col("n").alias("held_out"), "pass_rate"), "adapter", "left")
        .select(
            "adapter",
            (F.coalesce("pairs", F.lit(0)) >= min_pairs).alias("enough_pairs"),
            F.coalesce("all_constructs", F.lit(False)).alias("all_constructs"),
            (F.coalesce("held_out", F.lit(0)) >= min_held_out).alias("enough_held_out"),
            F.coalesce(F.col("pass_rate") >= F.col("threshold"), F.lit(False)).alias("meets_threshold"),
        )
        .withColumn(
            "ready",
            F.col("enough_pairs") & F.col("all_constructs") & F.col("enough_held_out") & F.col("meets_threshold"),
        )
    )


def delta_ready(delta_pairs: DataFrame, min_pairs: int = fixed.DELTA_PAIRS) -> DataFrame:
    """After a construct change: enough new pairs per affected adapter?"""
    counts = delta_pairs.groupBy("adapter").agg(F.count("*").alias("pairs"))
    return counts.withColumn("enough", F.col("pairs") >= min_pairs)


def resume_shortfall(targets: DataFrame, existing: DataFrame, by: list[str]) -> DataFrame:
    """Rows still needed per split: max(0, target − existing)."""
    have = existing.groupBy(*by).agg(F.count("*").alias("have"))
    joined = targets.join(have, by, "left").withColumn("have", F.coalesce("have", F.lit(0).cast("bigint")))
    return joined.withColumn("need", F.greatest(F.lit(0).cast("bigint"), F.col("target") - F.col("have")))


def merge_append(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new, allowMissingColumns=True)


def assemble_outputs(compiled: DataFrame, file: str = "module_id", pos: str = "pos", code: str = "code") -> DataFrame:
    """Output pieces (file, pos, text): block outputs, each followed by a blank line.

    Read in the order of ``pos`` they are the file's text. A file stays in pieces whatever its size,
    so no task gathers one; sources.files.write_pieces() writes them out in order.
    """
    return compiled.select(file, pos, F.concat(F.coalesce(code, F.lit("")), F.lit("\n\n")).alias("text"))
