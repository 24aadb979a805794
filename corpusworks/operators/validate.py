"""Validation of compiled rows and the gates built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusworks import fixed
from corpusworks.functions import checks as C
from corpusworks.functions import text as T
from corpusworks.functions.conditions import condition


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters read but do not compute again.

    They are generated, one row for one row, so a filter on them stays above while a filter on the
    input's own columns still reaches the scan.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def validate(df: DataFrame, names: list[str] = fixed.CHECK_NAMES) -> DataFrame:
    """Run the checks on every row and add ``checks`` and ``passed``; ``names`` selects some of them.

    Input columns: block_id, profile, compiled_code, preconditions, postconditions, mutates,
    emits, observable, return_type. No shuffle, so it works on streams too. Missing code or
    profile counts as empty. Rows of profiles with a language parser are checked on a branch of
    their own: the filter on the profile reaches the scan, and only they pass through Python.
    """
    if fixed.CHECK_NAMES[0] not in names:
        return _validated(df, names)
    parsed = C.uses_python_parser(F.col("profile"))
    others = ~parsed | F.col("profile").isNull()
    return _validated(df.where(others), names).unionByName(_validated(df.where(parsed), names, True))


def _validated(df: DataFrame, names: list[str], parsed: bool = False) -> DataFrame:
    code, profile = F.coalesce("compiled_code", F.lit("")), F.coalesce("profile", F.lit(""))
    # Used several times below, so they get their own projection.
    staged = df.withColumn("_folded", C.case_folded(code))
    if fixed.CHECK_NAMES[0] in names and not parsed:
        staged = staged.withColumn("_marks", C.brackets_of(F.when(C.uses_brackets(profile), code)))
    conditions = [c for name, c in zip(fixed.CHECK_NAMES[2:4], ("preconditions", "postconditions"), strict=True) if name in names]
    if conditions:
        staged = staged.withColumn("_known", C.known_names(code, *map(F.col, conditions)))
    folded, known = F.col("_folded"), F.col("_known")
    available = dict(
        zip(
            fixed.CHECK_NAMES,
            [
                lambda: C.check_parsed(code) if parsed else C.check_rules(code, profile, F.col("_marks"), folded),
                lambda: C.check_sentinel(code, F.col("block_id")),
                lambda: C.check_preconditions(code, F.col("preconditions"), known),
                lambda: C.check_postconditions(code, F.col("postconditions"), known),
                lambda: C.check_side_effects(
                    code, F.col("mutates"), F.coalesce(F.col("observable"), F.lit(False)), F.col("emits"), folded
                ),
                lambda: C.check_return_type(code, F.col("return_type")),
                lambda: C.check_placeholders(code, folded),
            ],
        )
    )
    chosen = [available[name]() for name in fixed.CHECK_NAMES if name in names]
    checked = computed_once(staged, checks=F.array(*chosen)).drop("_marks", "_folded", "_known")
    return checked.withColumn("passed", F.forall("checks", lambda c: c.passed))


def with_summary(validated: DataFrame) -> DataFrame:
    return validated.withColumn("summary", C.validation_summary(F.col("checks")))


def failed_checks(checks: Column) -> Column:
    return F.filter(checks, lambda c: ~c.passed)


def escalation_package(validated: DataFrame) -> DataFrame:
    """Add ``package``: null for passed rows, else the block, its code and the failed checks."""
    failed = F.transform(
        failed_checks(F.col("checks")), lambda c: F.struct(c["name"], c["message"], c["detail"])
    )
    package = F.struct("block_id", "intl_block", "compiled_code", failed.alias("failed_checks"))
    return validated.withColumn("package", F.when(~F.col("passed"), package))


def judged_pairs(pairs: DataFrame, *conditions: Column) -> DataFrame:
    """Add ``reason``: ok, or why a pair fails the block and completion gates or a further condition."""
    reasons = [C.block_reason(F.col("prompt")), C.completion_reason(F.col("completion"))]
    for n, condition in enumerate(conditions, 1):
        reasons.append(F.when(~F.coalesce(condition, F.lit(False)), f"condition {n} not met").otherwise("ok"))
    first = F.coalesce(*[F.nullif(reason, F.lit("ok")) for reason in reasons], F.lit("ok"))
    return computed_once(pairs, reason=first)


def quality_gate(pairs: DataFrame, *conditions: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) pairs by judged_pairs(), which serves better where both sides go on together."""
    judged = judged_pairs(pairs, *conditions)
    return judged.where("reason = 'ok'").drop("reason"), judged.where("reason <> 'ok'")


def low_confidence(blocks: DataFrame, threshold: float = fixed.LOW_CONFIDENCE) -> DataFrame:
    return blocks.where(F.col("confidence") < threshold)


def expect(df: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined) rows; quarantined rows carry the ids of the rules they break.

    A rule that evaluates to null counts as broken.
    """
    broken = [F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    judged = df.withColumn("broken_rules", F.array_compact(F.array(*broken)))
    kept = judged.where(F.size("broken_rules") == 0).drop("broken_rules")
    return kept, judged.where(F.size("broken_rules") > 0)


def expect_conditions(rows: DataFrame, rules: DataFrame, by: str, most: int = 2000) -> DataFrame:
    """Add ``broken`` and ``unread`` to rows: the conditions of a row's ``by`` value that do not hold, and those
    that are no conditions over the columns of ``rows``.

    ``rules``: by, condition (text of the block language, as block_fields() finds them). Each distinct condition is
    translated once, ``most`` of them at the most; its result is computed only for rows whose ``by`` asks for it.
    A condition that evaluates to null is broken. Rows without rules have two empty lists.
    """
    rules = rules.where(F.col(by).isNotNull() & F.col("condition").isNotNull()).select(by, "condition").distinct()
    texts = sorted(r[0] for r in rules.select("condition").distinct().limit(most + 1).collect())
    if len(texts) > most:
        raise ValueError(f"more than {most} distinct conditions")
    columns = {text: condition(text, rows) for text in texts}
    asked = rules.groupBy(by).agg(F.array_sort(F.collect_set("condition")).alias("_asked"))  # bounded by ``most``
    joined = rows.join(asked, by, "left").withColumn("_asked", F.coalesce("_asked", F.array().cast("array<string>")))
    broken = [
        F.when(F.array_contains("_asked", text) & ~F.coalesce(c, F.lit(False)), F.lit(text)) for text, c in columns.items() if c is not None
    ]
    unread = [text for text, c in columns.items() if c is None]
    none = F.array().cast("array<string>")
    return joined.withColumns(
        {
            "broken": F.array_compact(F.array(*broken)) if broken else none,
            "unread": F.array_intersect("_asked", F.array(*map(F.lit, unread))) if unread else none,
        }
    ).select(*[rows[c] for c in rows.columns if c != by], by, "broken", "unread").select(*rows.columns, "broken", "unread")


def type_to_ddl(declared: str) -> str:
    """Spark type of a declared type: T, T(n), T[], T? and Map<K,V>."""
    name = declared.strip().removesuffix("?")
    if name.endswith("[]"):
        return f"array<{type_to_ddl(name[:-2])}>"
    if name.startswith("Map<"):
        key, value = name[4:-1].split(",", 1)
        return f"map<{type_to_ddl(key)},{type_to_ddl(value)}>"
    return fixed.TYPE_DDL.get(name.split("(")[0], "string")


def validate_against(df: DataFrame, fields: list[dict], constraints: list[str] = ()) -> DataFrame:
    """Add ``violations``: for each declared field not-null, castable and length rules, then the
    constraints. ``fields`` holds name, type and not_null per field, as type_fields() gives them."""
    rules = []
    for field in fields:
        name, declared = field["name"], field["type"]
        value = F.col(name)
        if field.get("not_null") and not declared.endswith("?"):
            rules.append(F.when(value.isNull(), F.lit(f"{name}: null")))
        cast_to = type_to_ddl(declared)
        if cast_to != "string":
            rules.append(F.when(value.isNotNull() & value.try_cast(cast_to).isNull(), F.lit(f"{name}: not {declared}")))
        if declared.startswith("UUID"):
            rules.append(F.when(~value.rlike(fixed.UUID_PATTERN), F.lit(f"{name}: not {declared}")))
        if declared.startswith("String("):
            limit = int(declared[7:].split(")")[0])
            rules.append(F.when(F.length(value) > limit, F.lit(f"{name}: longer than {limit}")))
    for constraint in constraints:
        rules.append(F.when(~F.coalesce(F.expr(constraint), F.lit(True)), F.lit(f"constraint: {constraint}")))
    return df.withColumn("violations", F.array_compact(F.array(*rules)))


def fail_if(df: DataFrame, condition: Column, error: str, message: str, strict: bool = False) -> DataFrame:
    """Add ``failure`` (error, message) to rows meeting the condition; strict mode stops the job."""
    if strict:
        return df.withColumn(
            "failure", F.when(F.coalesce(condition, F.lit(False)), F.raise_error(F.lit(f"{error}: {message}")))
        )
    failure = F.struct(F.lit(error).alias("error"), F.lit(message).alias("message"))
    return df.withColumn("failure", F.when(F.coalesce(condition, F.lit(False)), failure))


def duplicate_ids(blocks: DataFrame, key: str = "id") -> DataFrame:
    """Ids that are not globally unique. Partial counts run before the shuffle."""
    return blocks.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def required_fields(blocks: DataFrame) -> DataFrame:
    """Add ``missing_fields`` to the rows of block_fields()."""
    is_function = F.col("kind") == "FUNCTION"
    missing = F.array(
        F.when(F.col("intent").isNull(), F.lit("INTENT")),
        F.when(is_function & (F.size("preconditions") == 0), F.lit("PRECONDITION")),
        F.when(is_function & (F.size("postconditions") == 0), F.lit("POSTCONDITION")),
    )
    return blocks.withColumn("missing_fields", F.array_compact(missing))
