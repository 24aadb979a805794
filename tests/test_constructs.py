"""Statement semantics that SQL alone does not settle: nulls, hot keys, deep pages."""

import bisect
import datetime
import random

import pytest
from pyspark.sql import functions as F

from corpusworks.functions import scalars as S
from corpusworks.operators import constructs as D

T0 = datetime.datetime(2024, 1, 1)


def test_not_in_nulls(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    keys = spark.createDataFrame([(1,)], "x int")
    with_null = keys.unionByName(spark.createDataFrame([(None,)], "x int"))
    values = lambda out: sorted((r.x for r in out.collect()), key=str)
    assert values(D.not_in(df, keys, "x")) == [2, None]
    assert values(D.not_in(df, with_null, "x")) == [2, None]
    assert values(D.not_in(df, keys, "x", sql_nulls=True)) == [2]
    assert values(D.not_in(df, with_null, "x", sql_nulls=True)) == []
    assert values(D.not_in(df, keys.where("false"), "x", sql_nulls=True)) == [1, 2, None]
    assert values(D.semi_in(df, with_null, "x")) == [1]


def test_update_and_delete_with_null_condition(spark):
    df = spark.createDataFrame([(1, 1), (2, None)], "id int, x int")
    assert [r.x for r in D.persist_update(df, {"x": F.lit(0)}, "x = 1").orderBy("id").collect()] == [0, None]
    assert [r.id for r in D.persist_delete(df, "x = 1").collect()] == [2]
    kept, archived = D.archive_move(df, "x = 1")
    assert [r.id for r in kept.collect()] == [2] and [r.id for r in archived.collect()] == [1]


def test_all_or_nothing_with_null_transaction(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", True), (None, True), (None, None), ("c", True)], "t string, ok boolean")
    assert sorted(r.t for r in D.all_or_nothing(df, "t", "ok").collect()) == ["b", "c"]


def test_pages(spark):
    df = spark.range(95).repartition(4)
    assert [r.id for r in D.paginate(df, ["id"], 3, 10).collect()] == list(range(20, 30))
    assert [r.id for r in D.paginate(df, ["id"], 10, 10).collect()] == list(range(90, 95))
    assert D.paginate(df, ["id"], 11, 10).count() == 0


def test_pages_equal_a_full_sort(spark):
    """Every page in several orders, with nulls, ties on the first column and rows equal in all columns."""
    draw = random.Random(2)
    rows = [(draw.choice([None, 1.5, 1.5, float(draw.randint(0, 9))]), draw.choice([None, *"abcdefg"]), n) for n in range(3000)] + [(2.0, "same", -1)] * 300
    df = spark.createDataFrame(rows, "x double, y string, n int").repartition(5)
    orders = [
        ([F.desc("x"), "y", "n"], lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or "", r[2])),
        ([F.col("y").desc_nulls_first(), F.asc_nulls_last("x"), F.desc("n")], lambda r: (r[1] is not None, [-ord(c) for c in (r[1] or "").ljust(5)], r[0] is None, r[0] or 0, -r[2])),
    ]
    for order, by in orders:
        want = sorted(rows, key=by)
        for page, size in ((1, 7), (3, 100), (20, 70), (33, 100), (34, 100), (1, 4000)):
            got = [tuple(r) for r in D.paginate(df, order, page, size, take=200).collect()]
            assert got == want[(page - 1) * size : page * size], (order, page, size)
    few = D.page_envelope(df.where("n >= 0"), ["n"], 2, 3).collect()
    assert [(r.n, r.total_count, r.page) for r in few] == [(3, 3000, 2), (4, 3000, 2), (5, 3000, 2)]
    with pytest.raises(ValueError):
        D.paginate(df, [F.col("x") + 1], 1, 1)


def test_pages_write_and_shuffle_no_rows(spark, monkeypatch):
    from corpusworks.operators import constructs, numbering

    def no_write(*a):
        raise AssertionError("a page needs no written rows")

    monkeypatch.setattr(constructs, "materialise", no_write)
    monkeypatch.setattr(numbering, "materialise", no_write)
    df = spark.range(100_000).select("id", F.repeat(F.lit("x"), 50).alias("long"))
    page = D.paginate(df, ["id"], 1000, 50, take=2000)
    assert [r.id for r in page.collect()] == list(range(49_950, 50_000))
    text = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in text and "Exchange" not in text and "id#" in text


def test_cache_lookup_spreads_a_busy_hour(spark):
    """A third of all rows are one key's in one hour, many at one instant: brute force, and no window holds them all."""
    draw, rows = random.Random(6), []
    for n in range(9000):
        busy = n % 3 == 0
        at = T0 + datetime.timedelta(seconds=draw.choice([77, draw.randrange(3600)]) if busy else draw.randrange(200_000))
        rows.append(("busy" if busy else draw.choice("abc"), at, draw.random() < 0.3, float(n)))
    s = spark.createDataFrame([(k, t, v) for k, t, is_set, v in rows if is_set], "key string, ts timestamp_ntz, value double")
    g = spark.createDataFrame([(k, t, int(v)) for k, t, is_set, v in rows if not is_set] + [(None, T0, -1)], "key string, ts timestamp_ntz, n int").repartition(5)
    got = {r.n: r.value for r in D.cache_lookup(g, s, ttl="10 minutes").collect()}
    by_key = {k: sorted((t, v) for q, t, is_set, v in rows if is_set and q == k) for k in ("busy", *"abc")}
    for k, t, is_set, v in rows:
        if not is_set:
            at = bisect.bisect_right(by_key[k], (t, float("inf"))) - 1
            last = by_key[k][at] if at >= 0 else None
            assert got[int(v)] == (last[1] if last and t < last[0] + datetime.timedelta(minutes=10) else None)
    assert got[-1] is None and len(got) == g.count()


def test_cache_lookup_brute_force(spark):
    """A hot key with half of all rows; sets and gets at equal times; values over slice edges."""
    rng = random.Random(5)
    minute = lambda: T0 + datetime.timedelta(minutes=rng.randrange(0, 1500))
    key = lambda: rng.choice(["hot", "hot", "a", "b"])
    sets = list({(k, t): (k, t, float(i)) for i in range(150) for k, t in [(key(), minute())]}.values())
    gets = [(i, key(), minute()) for i in range(400)]
    s = spark.createDataFrame(sets, "key string, ts timestamp_ntz, value double")
    g = spark.createDataFrame(gets, "n int, key string, ts timestamp_ntz").repartition(5)
    got = {r.n: r.value for r in D.cache_lookup(g, s, ttl="45 minutes").collect()}
    assert len(got) == 400
    for n, k, t in gets:
        before = [(st, v) for sk, st, v in sets if sk == k and st <= t]
        want = max(before)[1] if before and t < max(before)[0] + datetime.timedelta(minutes=45) else None
        assert got[n] == want


def test_string_agg_has_one_form_for_all_sizes(spark):
    df = spark.range(50_000).select(F.when(F.col("id") < 3, "few").otherwise("many").alias("k"), "id").repartition(6)
    for k, ids in (("few", range(3)), ("many", range(3, 50_000))):
        rows = sorted(D.string_agg(df, ["k"], "id", ["id"], ",").where(F.col("k") == k).collect(), key=lambda r: r.pos)
        assert [r.pos for r in rows] == list(range(1, len(ids) + 1))
        assert "".join(r.piece for r in rows) == ",".join(map(str, ids))


def test_fallback_and_lookup(spark):
    primary = spark.createDataFrame([(1, 10), (2, None)], "k int, v int")
    backup = spark.createDataFrame([(1, 99), (2, 20), (3, 30)], "k int, v int")
    rows = {r.k: (r.v, r.source) for r in D.fallback(primary, backup, "k", "v is not null").collect()}
    assert rows == {1: (10, "primary"), 2: (20, "backup"), 3: (30, "backup")}
    looked = D.scalar_lookup(spark.createDataFrame([(2,), (9,)], "k int"), backup, "k", "v", 0)
    assert {r.k: r.v for r in looked.collect()} == {2: 20, 9: 0}


def test_loop_keeps_rows_without_items(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [])], "id int, xs array<int>")
    assert sorted((r.id, r.x) for r in D.loop(df, "xs", "x").collect() if r.x) == [(1, 1), (1, 2)]
    assert D.loop(df, "xs", "x").count() == 3


def test_durations(spark):
    df = spark.createDataFrame([("24h",), ("30s",), ("5m",), ("7d",), ("x",), ("5w",)], "d string")
    assert [r.s for r in df.select(S.duration_seconds(F.col("d")).alias("s")).collect()] == [86400, 30, 300, 604800, None, None]
    assert [r.i for r in df.select(S.duration(F.col("d")).alias("i")).collect()][:2] == [datetime.timedelta(days=1), datetime.timedelta(seconds=30)]


def test_domain_and_clamp(spark):
    df = spark.createDataFrame([("Bob@Mail.Example.ORG",), ("https://A.example/x?y",)], "a string")
    assert [r.d for r in df.select(S.extract_domain(F.col("a")).alias("d")).collect()] == ["mail.example.org", "a.example"]


def test_audit_and_observe(spark):
    df = spark.range(3)
    audit = spark.createDataFrame([], "action string, row_key string, at timestamp_ntz")
    rows = D.audit_append(df, audit, "DELETE", "id", F.expr("timestamp_ntz'2024-01-01'")).collect()
    assert sorted(r.row_key for r in rows) == ["0", "1", "2"]
    watched, seen = D.observe(df, n=F.count(F.lit(1)))
    watched.collect()
    assert seen.get == {"n": 3}
