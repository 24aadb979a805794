"""Conditions of the block language against the same in DuckDB, and functions and aggregates registered by name."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusworks.functions import scalars as S
from corpusworks.functions.conditions import condition, sql_of
from corpusworks.functions.tokens import encoder, token_count
from corpusworks.operators import constructs as D
from corpusworks.operators import rendering as R
from corpusworks.operators import validate as V

# condition, the same in DuckDB
CASES = [
    ("a == 1", "a = 1"),
    ("a != 1", "a <> 1"),
    ("a >= 2 AND b < 3", "a >= 2 and b < 3"),
    ("a == 1 OR b == 2 AND c == \"x\"", "a = 1 or (b = 2 and c = 'x')"),
    ("(a == 1 OR b == 2) AND c == \"x\"", "(a = 1 or b = 2) and c = 'x'"),
    ("NOT a == 1 AND b == 2", "(not (a = 1)) and b = 2"),
    ("NOT (a == 1 AND b == 2)", "not (a = 1 and b = 2)"),
    ("NOT NOT a > 1", "a > 1"),
    ("NOT a == 1 OR NOT b == 2", "(not (a = 1)) or (not (b = 2))"),
    ("a IS NULL", "a is null"),
    ("a IS NOT NULL", "a is not null"),
    ("a IS NULL OR a > 2", "a is null or a > 2"),
    ("NOT a IS NULL AND b IS NOT NULL", "a is not null and b is not null"),
    ("a IS 2", "a = 2"),
    ("a IS NOT 2", "a <> 2"),
    ("c IS \"x\"", "c = 'x'"),
    ("flag IS TRUE", "flag is true"),
    ("flag == TRUE OR a < 0", "flag = true or a < 0"),
    ("a + b * 2 > 7", "a + (b * 2) > 7"),
    ("(a + b) * 2 > 7", "(a + b) * 2 > 7"),
    ("a - b - 1 == 0", "(a - b) - 1 = 0"),
    ("a * 2 / 4 >= 1", "(a * 2) / 4 >= 1"),
    ("c.length > 1", "length(c) > 1"),
    ("tags.length == 2 AND c.length == 1", "len(tags) = 2 and length(c) = 1"),
    ("rec.d.length == 2 OR rec.n > 3", "length(rec.d) = 2 or rec.n > 3"),
    ("rec.n + 1 <= a", "rec.n + 1 <= a"),
    ("c == \"a == b.length 5m\"", "c = 'a == b.length 5m'"),
    ("c != \"it's\"", "c <> 'it''s'"),
    ("c == \"say \\\"x\\\"\"", "c = 'say \"x\"'"),
    ("at > ts - 24h", '"at" > ts - interval 24 hour'),
    ("at + 90s >= ts + 1m AND NOT at < ts - 7d", '"at" + interval 90 second >= ts + interval 1 minute and not "at" < ts - interval 7 day'),
    ("ts < NOW()", "ts < now()"),
    ("a == 1 OR b == 2 AND NOT c IS NULL OR flag == FALSE", "a = 1 or (b = 2 and c is not null) or flag = false"),
]


def table(spark):
    draw, rows = random.Random(4), []
    words = [None, "x", "xy", "", "a == b.length 5m", "it's", 'say "x"']
    for i in range(300):
        at = f"2024-01-0{draw.randint(1, 9)} 0{draw.randint(0, 9)}:00:00"
        ts = f"2024-01-0{draw.randint(1, 9)} 0{draw.randint(0, 9)}:00:3{draw.randint(0, 9)}"
        rows.append((i, draw.choice([None, 0, 1, 2, 3]), draw.choice([None, 1, 2, 3]), draw.choice(words), draw.choice([True, False, None]), draw.sample("pqrs", draw.randint(0, 3)), ("de"[: draw.randint(0, 2)], draw.randint(0, 5)), at, ts))
    df = spark.createDataFrame(rows, "i int, a int, b int, c string, flag boolean, tags array<string>, rec struct<d string, n int>, at string, ts string")
    return df.withColumns({k: F.col(k).cast("timestamp_ntz") for k in ("at", "ts")})


def test_conditions_equal_sql(spark):
    df = table(spark)
    ours = df.select("i", *[condition(text, df).alias(f"r{k}") for k, (text, _) in enumerate(CASES)]).orderBy("i").collect()
    con = duckdb.connect()
    con.register("t", df.toArrow())
    theirs = con.execute("select i, " + ", ".join(f"({sql})" for _, sql in CASES) + " from t order by i").fetchall()
    for mine, other in zip(ours, theirs, strict=True):
        assert tuple(mine) == tuple(other), [c for c, x, y in zip(CASES, mine[1:], other[1:], strict=True) if x != y]


@pytest.mark.parametrize("text", ["the user must exist", "", "a ==", "unknown > 1", "a + 1", "a; drop table t", "tags.length >", "a > 1 b"])
def test_prose_is_no_condition(spark, text):
    assert condition(text, table(spark)) is None


def test_text_in_quotes_stays():
    assert sql_of('c == "x == 5m IS 3" AND a IS 3') == "c = 'x == 5m IS 3' AND a = 3"


def test_conditions_of_rows(spark):
    rows = spark.createDataFrame([("A", 1, "u"), ("A", 9, None), ("B", 1, "v"), ("C", 1, "w"), (None, 1, "w")], "kind string, a int, c string")
    rules = spark.createDataFrame(
        [("A", "a < 5"), ("A", "c IS NOT NULL"), ("B", "c == \"w\""), ("B", "prose here"), ("A", "a < 5"), (None, "a < 0"), ("B", None)], "kind string, condition string"
    )
    judged = V.expect_conditions(rows, rules, "kind")
    assert judged.columns == [*rows.columns, "broken", "unread"]
    got = {(r.kind, r.a): (r.broken, r.unread) for r in judged.collect()}
    assert got == {("A", 1): ([], []), ("A", 9): (["a < 5", "c IS NOT NULL"], []), ("B", 1): (['c == "w"'], ["prose here"]), ("C", 1): ([], []), (None, 1): ([], [])}
    with pytest.raises(ValueError):
        V.expect_conditions(rows, rules, "kind", most=2)


def test_mergeable_aggregate(spark):
    """A trimmed mean from a histogram of fixed size: one key with a third of the rows, null keys and null values."""
    bins, width = 50, 2.0

    def partial(v):
        at = np.clip((v // width).astype(int), 0, bins - 1)
        return np.concatenate([np.bincount(at, minlength=bins), np.bincount(at, weights=v, minlength=bins)])

    def finish(s):
        n, total = s[:bins], s[bins:]
        if not n.sum():
            return None
        lo, hi = n.sum() * 0.1, n.sum() * 0.9
        ends = np.cumsum(n)
        kept = np.clip(np.minimum(ends, hi) - np.maximum(ends - n, lo), 0, None)
        return float((kept * total / np.maximum(n, 1)).sum() / kept.sum())

    S.register_mergeable("trimmed_mean", S.Mergeable(partial, lambda a, b: a + b, finish))
    draw = random.Random(3)
    rows = [("hot" if k % 3 == 0 else draw.choice(["a", "b", None]), k % 2, None if draw.random() < 0.1 else draw.uniform(0, 100)) for k in range(9000)]
    df = spark.createDataFrame([*rows, ("only", 0, None)], "k string, m int, v double").repartition(7)
    got = {(r.k, r.m): r.mean for r in D.aggregate_merging(df, ["k", "m"], "TRIMMED_MEAN", "v", "mean").collect()}
    for key in {(k, m) for k, m, _ in rows}:
        want = finish(partial(np.array([v for k, m, v in rows if (k, m) == key and v is not None])))
        assert abs(got.pop(key) - want) < 1e-9
    assert got == {("only", 0): None}
    assert D.aggregate_merging(df.limit(0), ["k"], "TRIMMED_MEAN", "v", "mean").count() == 0


def test_merging_aggregate_with_tasks_without_rows(spark):
    """Tasks that read no rows, and tasks whose rows are all filtered out, give no states and do not fail."""
    S.register_mergeable("total", S.Mergeable(lambda v: np.array([v.sum()]), lambda a, b: a + b, lambda s: float(s[0])))
    df = spark.range(40, numPartitions=20).where("id < 3 or id = 39").selectExpr("cast(id % 2 as string) as k", "cast(id as double) as v")
    for by, want in ((["k"], {("0",): 2.0, ("1",): 40.0}), ([], {(): 42.0})):
        got = {tuple(r[c] for c in by): r.s for r in D.aggregate_merging(df, by, "TOTAL", "v", "s").collect()}
        assert got == want


def test_vectorised_function_runs_once_behind_the_filter(spark, tmp_path):
    S.register_vectorised("shout", lambda a: pa.compute.utf8_upper(a), "string")
    spark.range(1000).select("id", F.concat(F.lit("n"), "id").alias("name")).write.parquet(str(tmp_path / "t"))
    out = D.transform(spark.read.parquet(str(tmp_path / "t")).where("id < 10"), "name", "shout", "loud")
    assert sorted(r.loud for r in out.collect()) == [f"N{i}" for i in range(10)]
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython") == 1 and "LessThan(id,10)" in text.split("ArrowEvalPython")[1]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, sf, name):
    path = f"/opt/tokenizers/{name}"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.select("doc_id", "text", token_count(F.col("text"), path).alias("n")).collect()
    assert [r.n for r in rows] == encoder(path)([r.text or "" for r in rows])
    assert len(rows) > 100


def test_two_forms_of_a_vocabulary_agree(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    assert encoder("/opt/tokenizers/byte_bpe_50k.json")(texts) == encoder("/opt/tokenizers/byte_bpe_50k.tiktoken")(texts)


def test_length_gate_by_tokens(spark):
    pairs = spark.createDataFrame([(1, "word " * 10), (2, "word " * 3000), (3, None), (4, "")], "idx int, text string")
    got = {r.idx: (r.tokens, r.fits) for r in R.length_gate(pairs, tokenizer="/opt/tokenizers/byte_bpe_50k.tiktoken").collect()}
    assert got[1][1] and not got[2][1] and got[2][0] > 2048 and got[3] == got[4] == (0, True)
