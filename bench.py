"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import glob
import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusworks.plans import all_queries  # noqa: E402
from corpusworks.plans.inputs import view  # noqa: E402
from corpusworks.session import local_session  # noqa: E402

HEADLINES = [
    # validator throughput
    "validate", "adapter_pass_rate", "check_syntax", "validate_rules", "quality_gate", "bracket_balance",
    # text work
    "strip_fences", "strip_sentinels", "sentinel_regions", "block_fields", "construct_usage", "line_patches",
    # duplicates, split, quotas
    "duplicate_prompts", "first_occurrence", "split_train_val", "leakage_after_split", "construct_schedule", "construct_coverage",
    # index and propagation
    "dependents", "index_modules", "changed_blocks", "build_plan",
    # routing
    "route",
    # statements over the order tables and the event log
    "cache_lookup", "aggregate_join", "all_or_nothing", "upsert", "paginate", "trending", "string_agg",
    # streams
    "validate_stream", "retry_budget_state",
]

#: The given tables are single files of one row group, which one core reads alone. A corpus of any size lies in many
#: files; the bench lays the tables out so, whatever their size, before the clock starts.
FILES = 16


def laid_out(spark, sf_dir: str) -> str:
    """A copy of the tables in FILES files each."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        spark.read.parquet(path).repartition(FILES).write.parquet(f"{folder}/{os.path.basename(path)}")
    return folder


WARM_UP = ["validate", "strip_fences", "aggregate_join"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, given = all_queries(), sf_dir
    sf_dir = laid_out(spark, given)
    for name in WARM_UP:  # class loading, compilation and Python workers start before the clock runs
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINES:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    modules = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    lines = view(spark, sf_dir, "sources").selectExpr("sum(size(split(source, '\n'))) as n").first()["n"]
    scale = re.search(r"sf([0-9.]+)", given)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
                "warm_up": WARM_UP,
                "files_per_table": FILES,
                "validated_rows_per_second": round(documents / seconds["validate"], 1),
                "routed_rows_per_second": round(modules / seconds["route"], 1),
                "source_lines_per_second": round(lines / seconds["block_fields"], 1),
            }
        ),
        flush=True,
    )


if __name__ == "__main__":
    main()
