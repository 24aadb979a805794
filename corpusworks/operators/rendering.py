"""Training pairs and escalation texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusworks import fixed
from corpusworks.functions import text as T
from corpusworks.functions.tokens import token_count


def pair_metadata(category: str) -> Column:
    return F.struct(
        F.lit(category).alias("category"), F.col("adapter"), F.col("construct"), F.col("idx").cast("int").alias("idx")
    )


def render_pair_a(df: DataFrame) -> DataFrame:
    """block, completion, adapter, construct, idx → system, prompt, completion, metadata."""
    return df.select(
        T.system_prompt(F.col("adapter"), "compiler").alias("system"),
        F.col("block").alias("prompt"),
        T.strip_fences(F.col("completion")).alias("completion"),
        pair_metadata("A").alias("metadata"),
    )


def render_pair_b(df: DataFrame) -> DataFrame:
    """Adds base_code and patch in front: the prompt is the old code followed by the patch."""
    return df.select(
        T.system_prompt(F.col("adapter"), "patch").alias("system"),
        F.concat_ws("\n\n", T.strip_fences(F.col("base_code")), F.col("patch")).alias("prompt"),
        T.strip_fences(F.col("completion")).alias("completion"),
        pair_metadata("B").alias("metadata"),
    )


def render_pair_c(df: DataFrame) -> DataFrame:
    """block, broken_code and flaw make the prompt; the completion is the corrected code."""
    prompt = F.concat(
        F.col("block"), F.lit(fixed.ATTEMPT_HEADING), F.col("broken_code"), F.lit(fixed.CHECK_HEADING), F.col("flaw")
    )
    return df.select(
        T.system_prompt(F.col("adapter"), "escalation").alias("system"),
        prompt.alias("prompt"),
        T.strip_fences(F.col("completion")).alias("completion"),
        pair_metadata("C").alias("metadata"),
    )


def render_correction(df: DataFrame, at: Column) -> DataFrame:
    """Correction pair of an escalated block: failed is an array of (name, message, detail).

    ``at`` is the correction's time, passed as data so that results repeat.
    """
    failed = F.col("failed")
    summary = F.array_join(F.transform(failed, lambda c: F.concat(c["name"], F.lit(": "), c["message"])), "; ")
    prompt = F.concat(
        T.strip(F.col("intl_block")), F.lit(fixed.ATTEMPT_HEADING), T.strip(F.col("compiled_code")),
        F.lit(fixed.CHECKS_HEADING), summary,
    )
    return df.select(
        F.format_string(fixed.CORRECTION_PROMPT, F.col("language"), F.col("adapter")).alias("system"),
        prompt.alias("prompt"),
        F.col("corrected").alias("completion"),
        F.struct(
            F.lit("C").alias("category"),
            F.col("adapter"),
            F.col("block_id"),
            F.col("block_name"),
            F.transform(failed, lambda c: c["name"]).alias("failing_checks"),
            F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"),
        ).alias("metadata"),
    )


def escalation_text(failed: Column, retry_count: Column) -> Column:
    """The structured package sent on when the retry budget is used up."""
    lines = F.array_join(
        F.transform(
            failed,
            lambda c: F.concat(F.lit("  ["), c["name"], F.lit("] "), c["message"], F.lit(" — "), c["detail"]),
        ),
        "\n",
    )
    listed = F.when(T.strip(lines) == "", "(none listed)").otherwise(T.strip(lines))
    return F.format_string(
        fixed.PACKAGE_FORMAT, F.col("adapter"), F.col("language"), F.col("block_id"), retry_count.cast("string"),
        T.strip(F.col("intl_block")), T.strip(F.col("compiled_code")), listed,
    )


def render_escalation(df: DataFrame) -> DataFrame:
    """Add ``package_text``; needs adapter, language, block_id, retry_count, intl_block,
    compiled_code and failed."""
    return df.withColumn("package_text", escalation_text(F.col("failed"), F.col("retry_count")))


def render_request(df: DataFrame) -> DataFrame:
    """Add ``request_text``, the short form of the package."""
    lines = F.array_join(
        F.transform(
            "failed",
            lambda c: F.concat(
                F.lit("- "), c["name"], F.lit(": "), c["message"],
                F.when(c["detail"] != "", F.concat(F.lit(" ("), c["detail"], F.lit(")"))).otherwise(""),
            ),
        ),
        "\n",
    )
    return df.withColumn(
        "request_text", F.format_string(fixed.REQUEST_FORMAT, F.col("intl_block"), F.col("compiled_code"), lines)
    )


def with_training_text(pairs: DataFrame, eos: str) -> DataFrame:
    return pairs.withColumn("text", T.training_text(F.col("system"), F.col("prompt"), F.col("completion"), eos))


def length_gate(pairs: DataFrame, text: str = "text", max_tokens: int = fixed.MAX_TOKENS, tokenizer: str | None = None) -> DataFrame:
    """Add ``tokens`` and ``fits``; filter on fits to drop, or keep it as a flag.

    ``tokenizer`` is the path of a tokenizer file (see functions.tokens); without one white-space counts stand in.
    """
    tokens = T.token_estimate(F.col(text)) if tokenizer is None else token_count(F.col(text), tokenizer)
    return pairs.withColumn("tokens", tokens).withColumn("fits", F.col("tokens") <= max_tokens)


def project_fields(df: DataFrame, add: dict[str, Column] | None = None, drop: list[str] = ()) -> DataFrame:
    return df.withColumns(add or {}).drop(*drop)
