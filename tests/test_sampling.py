"""Splits, schedules and numbering, with a third of all rows in one group."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from corpusworks import fixed
from corpusworks.operators import corpus as G
from corpusworks.operators import sampling as W
from corpusworks.operators.numbering import dense_positions


@pytest.fixture(scope="module")
def pairs(spark):
    """3,000 pairs; a third have one and the same prompt, which differs only in blanks."""
    rows = spark.range(3000).select(
        F.col("id").alias("idx"), F.when(F.col("id") % 2 == 0, "python_flask").otherwise("go_gin").alias("adapter"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit(" hot  prompt"), F.repeat(F.lit(" "), (F.col("id") % 5).cast("int"))))
        .otherwise(F.concat(F.lit("prompt "), (F.col("id") % 700).cast("string"))).alias("prompt"),
    )
    return rows.repartition(7)


def test_split_is_a_partition_without_leakage(spark, pairs):
    split = W.split_train_val(pairs, 50, seed=1)
    rows = split.collect()
    assert sorted(r.idx for r in rows) == list(range(3000))
    sizes = collections.Counter((r.adapter, r.split) for r in rows)
    for adapter in ("python_flask", "go_gin"):
        assert 50 <= sizes[adapter, "validation"] < 600
    report = {r.adapter: r for r in W.split_sizes(split, 50).collect()}
    assert all(report[a].overshoot == sizes[a, "validation"] - 50 and report[a].train == sizes[a, "train"] for a in report)
    train, valid = split.where("split = 'train'"), split.where("split = 'validation'")
    assert G.leaked_keys(train, valid, ["adapter"]).count() == 0


def test_split_does_not_depend_on_row_order(pairs):
    a = W.split_train_val(pairs, 50, seed=1).where("split = 'validation'").select("idx")
    b = W.split_train_val(pairs.orderBy(F.desc("idx")).coalesce(1), 50, seed=1).where("split = 'validation'").select("idx")
    assert sorted(a.collect()) == sorted(b.collect())


def test_duplicates(pairs):
    groups = {r.copies for r in G.duplicate_prompts(pairs).collect()}
    assert 1000 in groups
    firsts = W.first_occurrence(pairs).collect()
    assert len(firsts) == len({" ".join(r.prompt.split()) for r in pairs.collect()})
    assert min(r.idx for r in firsts if "hot" in r.prompt) == 0


def test_leakage_pair(spark):
    train = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "idx int, prompt string")
    valid = spark.createDataFrame([(1, " a  b "), (2, "d"), (3, None)], "idx int, prompt string")
    assert [r.prompt for r in G.leakage(train, valid, "idx").collect()] == [" a  b "]
    assert [r.idx for r in G.without_leakage(train, valid, "idx").orderBy("idx").collect()] == [2, 3]


@pytest.mark.parametrize("need", [10, 500, 1013, 1100, 2500])
def test_schedule(spark, need):
    needs = spark.createDataFrame([("x", need), ("y", 0)], "adapter string, need bigint")
    rows = W.construct_schedule(needs, seed=4).collect()
    assert sorted(r.slot for r in rows) == list(range(1, need + 1)) and {r.adapter for r in rows} == {"x"}
    counts = collections.Counter(r.construct for r in rows)
    high = min(100, need // 22)
    if need >= 19 * 50 + 3 * high:
        assert all(counts[c] >= (high if c in fixed.HIGH_FREQUENCY else 50) for c in fixed.CONSTRUCTS)


def test_positions_with_hot_group_and_nulls(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).otherwise((F.col("id") % 4).cast("string")).alias("k"), (F.col("id") * 7919 % 5000).alias("v")
    ).repartition(9)
    got = {(r.k, r.v): r.pos for r in dense_positions(df, ["v"], by=["k"]).collect()}
    groups = collections.defaultdict(list)
    for k, v in got:
        groups[k].append(v)
    assert sum(map(len, groups.values())) == 5000
    for k, values in groups.items():
        assert [got[k, v] for v in sorted(values)] == list(range(1, len(values) + 1))


def test_positions_descending(spark):
    df = spark.range(1000)
    rows = dense_positions(df, [F.desc("id")]).collect()
    assert all(r.pos == 1000 - r.id for r in rows)


def test_batches_and_ids(spark):
    df = spark.range(8)
    rows = sorted(W.micro_batches(df, "id").collect())
    assert [(r.batch, r.place) for r in rows] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1)]
    assert {r.checkpoint for r in W.checkpoint_numbers(spark.range(101), "id").collect()} == {0, 1, 2}
    existing = spark.createDataFrame([("f0007",), ("p0099",), ("f12000",)], "id string")
    new = W.next_ids(existing, df.withColumnRenamed("id", "n"), "n").collect()
    assert sorted(r.id for r in new)[0] == "f12001" and len({r.id for r in new}) == 8
    first = W.next_ids(existing.where("false"), df.withColumnRenamed("id", "n"), "n").collect()
    assert min(r.id for r in first) == "f0001"


def test_category_shares(spark):
    from corpusworks.functions.draws import assign_category

    n = 20000
    counts = {r.c: r["count"] for r in spark.range(n).select(assign_category(F.col("id"), 1).alias("c")).groupBy("c").count().collect()}
    for category, share in fixed.CATEGORY_SHARES:
        assert abs(counts[category] / n - share) < 0.02


def test_missing_prompts_are_no_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a "), (3, None), (4, None)], "idx int, prompt string")
    assert sorted(r.idx for r in W.first_occurrence(df).collect()) == [1, 3, 4]
    assert [r.copies for r in G.duplicate_prompts(df).collect()] == [2]


def test_split_takes_prompts_in_drawn_order_alone(spark):
    """Prompts of 30, 40 and 90 copies: the first drawn one that reaches the wanted rows ends the choice."""
    df = spark.createDataFrame([(i, "a", p) for p, n in (("x", 40), ("y", 90), ("z", 30)) for i in range(n)], "i int, adapter string, prompt string")
    sizes = {"x": 40, "y": 90, "z": 30}
    key = W.draw(F.lower(F.hex(W.T.text_key(F.col("p")))), 3)
    drawn = [r.p for r in spark.createDataFrame([(p,) for p in sizes], "p string").orderBy(key).collect()]
    for n_val in (20, 65, 100):
        want, total = set(), 0
        for p in drawn:
            if total < n_val:
                want.add(p)
                total += sizes[p]
        rows = W.split_train_val(df, n_val, seed=3).collect()
        assert {r.prompt for r in rows if r.split == "validation"} == want and len(rows) == 160
    single = W.split_train_val(df.where("prompt = 'y'"), 20, seed=3).collect()
    assert {r.split for r in single} == {"validation"} and len(single) == 90


def test_split_is_exact_where_some_prompts_fit(spark):
    """Random copy counts: exactly n_val rows wherever a subset has them, whole prompts, in drawn order; else as drawn."""
    draw, rows = random.Random(8), []
    for g in range(40):
        sizes = [draw.choice([3, 4, 6, 9, 20, 35] if g % 2 else [7, 14, 21, 50]) for _ in range(draw.randint(1, 24))]
        rows += [(f"g{g}", f"p{i}") for i, n in enumerate(sizes) for _ in range(n)]
    df = spark.createDataFrame(rows, "adapter string, prompt string").repartition(4)
    n_val = 30
    split = [(r.adapter, r.prompt, r.split) for r in W.split_train_val(df, n_val, seed=2).collect()]
    assert len(split) == len(rows) and len({x[:2] for x in split}) == len(set(split))  # no prompt on both sides
    exact = 0
    for g in {r[0] for r in rows}:
        sizes = collections.Counter(p for a, p in rows if a == g)
        held = sum(1 for a, _, side in split if a == g and side == "validation")
        sums = {0}
        for n in sizes.values():
            sums |= {s + n for s in sums}
        if n_val in sums:
            exact += 1
            assert held == n_val
        else:
            assert held >= min(n_val, sum(sizes.values()))
    assert 5 < exact < 38
