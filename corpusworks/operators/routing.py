"""Profile catalog and the joins that attach it to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusworks import fixed


def default_catalog(spark: SparkSession, repo: str = "") -> DataFrame:
    """The catalog of fixed values as a table: profile, phase, threshold, pairs, adapter_id, base_model.

    A literal table has a known size, as files have: joins below carry no hints, and the planner
    broadcasts a catalog as long as that size is within its threshold.
    """
    values = ", ".join(f"('{p}', {phase}, {threshold}D, {pairs}L)" for p, phase, threshold, pairs in fixed.PROFILES)
    rows = spark.sql(f"select * from values {values} as catalog(profile, phase, threshold, pairs)")
    return with_adapter_ids(rows, F.lit(repo), F.lit(fixed.BASE_MODEL))


def with_adapter_ids(rows: DataFrame, repo: Column, base_model: Column) -> DataFrame:
    path = F.concat(repo, F.lit("/tree/main/"), F.col("profile"))
    adapter_id = F.when(F.coalesce(repo, F.lit("")) == "", F.col("profile")).otherwise(path)
    return rows.withColumns({"adapter_id": adapter_id, "base_model": base_model})


def route(df: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(routed, rejected): rows with the catalog entry of their profile, and rows without one.

    Matching is case-sensitive. The message of a rejected row names the known profiles.
    """
    known = catalog.agg(
        F.concat_ws(", ", F.sort_array(F.collect_list("profile"))).alias("_known"), F.count("*").alias("_count")
    )
    routed = df.join(catalog, "profile")
    empty = F.coalesce(F.col("profile"), F.lit("")) == ""
    message = F.when(empty, "profile must not be empty").otherwise(
        F.format_string(
            "Unknown profile '%s'. Known profiles (%d): %s", F.col("profile"), F.col("_count"), F.col("_known")
        )
    )
    rejected = df.join(catalog.select("profile"), "profile", "left_anti").join(F.broadcast(known))
    return routed, rejected.withColumn("error", message).drop("_known", "_count")


def known_profile(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows whose profile the catalog does not know."""
    return df.join(catalog.select("profile"), "profile", "left_anti")


def unused_profiles(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog profiles that no row uses (set difference)."""
    return catalog.select("profile").exceptAll(df.select("profile").distinct())


def phases_complete(catalog: DataFrame, phases: DataFrame) -> DataFrame:
    """Profiles found on one side only: in the catalog, or in the phase lists. Empty when complete."""
    listed = phases.select("profile").distinct()
    left = catalog.select("profile").exceptAll(listed).withColumn("only_in", F.lit("catalog"))
    right = listed.exceptAll(catalog.select("profile")).withColumn("only_in", F.lit("phases"))
    return left.unionByName(right)


def list_profiles(catalog: DataFrame, phase: int | None = None) -> DataFrame:
    chosen = catalog if phase is None else catalog.where(F.col("phase") == phase)
    return chosen.select("profile").orderBy("profile")


def adapters_by_phase(catalog: DataFrame) -> DataFrame:
    """One row per phase, its profiles sorted and described; the catalog is small by nature."""
    percent = F.floor(F.col("threshold") * 100).cast("int")
    entry = F.struct("profile", F.col("pairs"), percent.alias("threshold_percent"))
    return catalog.groupBy("phase").agg(F.sort_array(F.collect_list(entry)).alias("profiles")).orderBy("phase")


def is_trained(df: DataFrame, catalog: DataFrame) -> DataFrame:
    flags = catalog.select("profile", (F.col("pairs") > 0).alias("trained"))
    return df.join(flags, "profile", "left").withColumn("trained", F.coalesce("trained", F.lit(False)))


def tier_value(profile: Column, field: int) -> Column:
    """Value of a language tier by the profile's language: 0 tier, 2 retries, 3 pass rate, 4 escalation limit."""
    language = F.substring_index(profile, "_", 1)
    value = None
    for row in fixed.TIERS:
        hit = language.isin(row[1])
        value = F.when(hit, row[field]) if value is None else value.when(hit, row[field])
    return value


def with_tier(df: DataFrame, profile: str = "profile") -> DataFrame:
    """Add tier, retry_budget, required_rate and escalation_limit (null for other languages)."""
    col = F.col(profile)
    return df.withColumns(
        {
            "tier": tier_value(col, 0),
            "retry_budget": tier_value(col, 2),
            "required_rate": tier_value(col, 3),
            "escalation_limit": tier_value(col, 4),
        }
    )


def retry_budget(df: DataFrame, attempts: str = "attempt", profile: str = "profile") -> DataFrame:
    """Add the budget and whether it is used up: ``attempts`` counts the retries made so far, and as many
    retries as the budget are made before a failure goes up."""
    out = df.withColumn("retry_budget", tier_value(F.col(profile), 2))
    return out.withColumn("exhausted", F.col(attempts) >= F.col("retry_budget"))


def against_threshold(rates: DataFrame, catalog: DataFrame, rate: str = "pass_rate") -> DataFrame:
    """Add the catalog threshold and whether the rate meets it."""
    limits = catalog.select("profile", "threshold")
    return rates.join(limits, "profile", "left").withColumn("meets", F.col(rate) >= F.col("threshold"))
