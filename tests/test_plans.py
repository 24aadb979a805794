"""Shape of physical plans."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusworks.operators import corpus as G
from corpusworks.operators import sampling as W
from corpusworks.operators import validate as V
from corpusworks.plans.check_queries import RULES
from corpusworks.plans.inputs import compiled, table, view

QUERIES = entry.queries()
# Run streams or write files on the way; their batch parts are covered by the others.
NO_PLAN = {
    "observe", "emit_subscribe", "progress_windows", "corrections_stream", "retry_budget_state", "cache_state", "validate_stream", "dirty_feed",
    "stream_filter", "dependents", "dependents_stop_at_dirty", "mark_dirty", "propagate_dirty", "affected_by", "index_modules",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - NO_PLAN))
def test_no_cross_products(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text
    # Nested loops only attach one-row facts: the build side is a global aggregate.
    for match in re.finditer(r"BroadcastNestedLoopJoin", text):
        assert "HashAggregate(keys=[]" in text or "Scan OneRowRelation" in text or "LocalTableScan" in text


def test_rules_stay_in_the_jvm(spark, sf):
    text = plan(V.validate(compiled(spark, sf), RULES))
    assert "ArrowEvalPython" not in text and text.count("Exchange") <= 1  # the deal-out of a small scan


def test_scan_reads_needed_columns_only(spark, sf):
    text = plan(QUERIES["recent"](spark, sf))
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts" in text
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>", text)
    text = plan(G.duplicate_prompts(table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), F.col("text").alias("prompt"))))
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", text)


def test_duplicates_shuffle_keys_not_texts(spark, sf):
    df = view(spark, sf, "pairs").select("idx", "prompt", "adapter")
    text = plan(G.duplicate_prompts(df))
    shuffled = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffled and not any("prompt#" in line or "text#" in line for line in shuffled)
    assert "partial_count" in text


def test_texts_do_not_travel(spark, sf):
    """Without broadcasts, no exchange below the last join on the row key carries a text."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), F.col("text").alias("prompt"))
    other = docs.where("idx > 100")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (G.leakage(docs, other, "idx"), G.without_leakage(docs, other, "idx"), W.first_occurrence(docs)):
            exchanges = [e for e in re.findall(r"Exchange hashpartitioning\(([^)]*)\)[^\n]*\n[^\n]*Project \[([^\n]*)\]", plan(df))]
            assert exchanges
            for keys, columns in exchanges:
                assert not re.search(r"(?:^|, )(?:prompt|text)#|AS prompt#", columns) or keys.startswith("idx#")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_top_k_limits_before_the_shuffle(spark, sf):
    df = view(spark, sf, "pairs").select("adapter", "idx")
    text = plan(W.top_k_per_group(df, ["adapter"], ["idx"], 5))
    assert text.count("WindowGroupLimit") == 2


def stored(spark, sf, tmp_path):
    path = str(tmp_path / "compiled")
    compiled(spark, sf).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # whole filter lists in plans
    spark.conf.set("spark.sql.debug.maxToStringFields", "200")
    return spark.read.parquet(path)


def test_filters_pass_the_checks(spark, sf, tmp_path):
    """Filters on input columns reach the scan, filters on results stay above the checks."""
    df = stored(spark, sf, tmp_path)
    text = plan(V.validate(df).where("profile = 'go_gin' and not passed"))
    assert text.count("EqualTo(profile,go_gin)") == text.count("FileScan")
    gate = df.select("doc_id", "profile", F.col("intl_block").alias("prompt"), F.col("compiled_code").alias("completion"))
    accepted, _ = V.quality_gate(gate)
    text = plan(accepted.where("profile = 'go_gin'"))
    assert "EqualTo(profile,go_gin)" in text
    assert text.index("Filter") < text.index("Generate inline")


def test_parser_sees_its_own_rows_only(spark, sf, tmp_path):
    text = plan(V.validate(stored(spark, sf, tmp_path)))
    before, after = text.split("ArrowEvalPython", 1)
    assert "StringStartsWith(profile,python)" in after.split("Scan", 1)[1]
    assert before.count("Generate inline") == 2  # one evaluation of the checks on each branch


def test_names_are_looked_up_without_patterns(spark, sf, tmp_path):
    """No pattern is built per row and name; the text's words are taken apart once for all conditions."""
    text = plan(V.validate(stored(spark, sf, tmp_path)))
    assert text.count(r"([\p{L}\p{N}_]+)") == 2  # once per branch, in a projection of its own
