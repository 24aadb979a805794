"""Index cases: upsert, dirty flags, propagation, roll-up."""

import pytest
from pyspark.sql import functions as F

from corpusworks.operators import index as I

def now():
    return F.expr("timestamp_ntz'2024-01-01'")


MODULES = "id string, name string, target string, profile string, namespace string, version string, requires array<string>"
BLOCKS = "id string, module_id string, name string, kind string, body string"


@pytest.fixture(scope="module")
def parsed(spark):
    modules = spark.createDataFrame(
        [("m001", "auth", "a.py", "python_fastapi", "app", "1", ["m002"]), ("m002", "users", "u.py", "python_fastapi", "app", "1", []),
         ("m003", "orders", "o.py", "python_fastapi", "app", "1", ["m001"])], MODULES)
    blocks = spark.createDataFrame(
        [("f001", "m001", "login", "function", "a"), ("f002", "m001", "logout", "function", "b"),
         ("f003", "m002", "get_user", "function", "c"), ("f004", "m003", "create_order", "function", "d")], BLOCKS)
    return modules, blocks


@pytest.fixture(scope="module")
def empty(spark):
    modules = spark.createDataFrame([], "id string, name string, target string, profile string, namespace string, version string, dirty boolean, compiled_at timestamp_ntz, indexed_at timestamp_ntz")
    blocks = spark.createDataFrame([], BLOCKS + ", body_hash string, dirty boolean, compiled_at timestamp_ntz, output_code string, output_hash string, indexed_at timestamp_ntz")
    return I.Index(modules, blocks, spark.createDataFrame([], "from_module string, to_module string"))


@pytest.fixture(scope="module")
def full(empty, parsed):
    return I.index_modules(empty, *parsed, now())


def dirty(df):
    return sorted(r.id for r in df.where("dirty").collect())


def clean(index):
    return I.Index(index.modules.withColumn("dirty", F.lit(False)), index.blocks.withColumn("dirty", F.lit(False)), index.deps)


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id string")


def test_first_index(full):
    assert dirty(full.modules) == ["m001", "m002", "m003"]
    assert dirty(full.blocks) == ["f001", "f002", "f003", "f004"]
    assert I.index_stats(full).collect()[0].asDict() == {"modules": 3, "blocks": 4, "dirty_blocks": 4}
    assert sorted(map(tuple, full.deps.collect())) == [("m001", "m002"), ("m003", "m001")]


def test_reindex_is_idempotent(full, parsed):
    again = I.index_modules(full, *parsed, now())
    assert again.modules.count() == 3 and sorted(r.id for r in again.blocks.collect()) == ["f001", "f002", "f003", "f004"]


def test_reindex_of_clean_unchanged_source_stays_clean(full, parsed):
    again = I.index_modules(clean(full), *parsed, now())
    assert dirty(again.modules) == [] and dirty(again.blocks) == []
    forced = I.index_modules(clean(full), *parsed, now(), force=True)
    assert dirty(forced.modules) == ["m001", "m002", "m003"]


def test_changed_body_dirties_dependents(full, parsed):
    modules, blocks = parsed
    changed = blocks.withColumn("body", F.when(F.col("id") == "f001", "new").otherwise(F.col("body")))
    after = I.index_modules(clean(full), modules, changed, now())
    assert dirty(after.modules) == ["m001", "m003"]
    assert dirty(after.blocks) == ["f001", "f004"]


def results(spark, *blocks):
    return spark.createDataFrame([(b, "code", True) for b in blocks], "block_id string, code string, passed boolean")


def test_compile_one_then_all(spark, full):
    one = I.record_compiled(full, results(spark, "f001"), now())
    assert dirty(one.blocks) == ["f002", "f003", "f004"] and "m001" in dirty(one.modules)
    both = I.record_compiled(one, results(spark, "f002"), now())
    assert dirty(both.modules) == ["m002", "m003"]
    stored = both.blocks.where("id = 'f001'").collect()[0]
    assert stored.output_code == "code" and len(stored.output_hash) == 64 and stored.compiled_at is not None


def test_failed_results_are_not_recorded(spark, full):
    bad = results(spark, "f003").withColumn("passed", F.lit(False))
    assert dirty(I.record_compiled(full, bad, now()).blocks) == ["f001", "f002", "f003", "f004"]
    assert "f003" not in dirty(I.record_compiled(full, bad, now(), only_passed=False).blocks)


def test_mark_dirty(spark, full):
    after = I.mark_dirty(clean(full), ids(spark, "m001"))
    assert dirty(after.modules) == ["m001", "m003"] and dirty(after.blocks) == ["f001", "f002", "f004"]


def test_module_without_blocks_keeps_flag(spark, full):
    lonely = full.modules.unionByName(full.modules.limit(1).withColumn("id", F.lit("m009")))
    assert "m009" in dirty(I.module_rollup(lonely, full.blocks.withColumn("dirty", F.lit(False))))


@pytest.fixture(scope="module")
def graph(spark):
    edges = [("b", "a"), ("c", "b"), ("d", "c"), ("a", "d"), ("e", "c"), ("x", "a"), ("f", "e"), ("s", "s")]
    modules = spark.createDataFrame([(m, m == "b") for m in "abcdefs"], "id string, dirty boolean")
    return spark.createDataFrame(edges, "from_module string, to_module string"), modules


def test_cycle_unknown_and_dirty_path(spark, graph):
    deps, modules = graph
    reached = {r.id: r.distance for r in I.dependents(deps, modules, ids(spark, "a")).collect()}
    assert reached == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 3, "f": 4}
    stopped = {r.id for r in I.dependents(deps, modules, ids(spark, "a"), stop_at_dirty=True).collect()}
    assert stopped == {"a"}
    assert {r.id for r in I.dependents(deps, modules, ids(spark, "s")).collect()} == {"s"}
    assert I.dependents(deps, modules, ids(spark).where("false")).count() == 0


def test_closure_is_a_fixed_point(spark, graph):
    deps, modules = graph
    once = I.dependents(deps, modules, ids(spark, "c")).select("id")
    twice = I.dependents(deps, modules, once).select("id")
    assert sorted(once.collect()) == sorted(twice.collect())


def test_affected_by(spark, graph, full):
    rows = {r.seed: (r.modules, r.blocks) for r in I.affected_by(full, ids(spark, "m002", "m003")).collect()}
    assert rows == {"m002": (3, 4), "m003": (1, 1)}


def test_required_types(spark, full):
    types = spark.createDataFrame([("m002", "t001", "User", "a user"), ("m001", "t002", "Token", None)], "module_id string, id string, name string, description string")
    rows = sorted(map(tuple, I.required_types(full.deps, types, full.modules).collect()))
    assert rows == [("m001", "TYPE User [id=t001]  # a user"), ("m002", "(none)"), ("m003", "TYPE Token [id=t002]  # ")]


def bucketed(spark, tmp_path, name):
    """A chain m0 <- m1 <- … <- m99 of which each tenth link is missing, with three blocks per module."""
    from corpusworks.sources.files import BucketedTable

    ids = spark.range(100).select(F.concat(F.lit("m"), "id").alias("id"), F.lit(False).alias("dirty"), F.col("id").alias("n"))
    modules = BucketedTable(str(tmp_path / f"{name}-modules"), "id", 32)
    blocks = BucketedTable(str(tmp_path / f"{name}-blocks"), "module_id", 32)
    modules.write(ids, 0)
    blocks.write(ids.select(F.explode(F.array(*map(F.lit, "abc"))).alias("b"), F.col("id").alias("module_id"), "dirty").select(F.concat("module_id", "b").alias("id"), "module_id", "dirty"), 0)
    deps = spark.range(1, 100).where("id % 10 <> 0").select(F.concat(F.lit("m"), "id").alias("from_module"), F.concat(F.lit("m"), F.col("id") - 1).alias("to_module"))
    return modules, blocks, deps


def test_a_batch_writes_the_buckets_it_touches(spark, tmp_path):
    modules, blocks, deps = bucketed(spark, tmp_path, "a")
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "id string")
    written = I.mark_dirty_buckets(modules, blocks, deps, ids("m9"), 0)  # nothing requires m9
    folders = lambda table, v: sorted(p.name for p in (tmp_path / table).glob(f"v={v:08d}/_bucket=*"))
    assert len(written) == 1 and folders("a-modules", 1) == folders("a-blocks", 1) == [f"_bucket={written[0]}"]
    I.mark_dirty_buckets(modules, blocks, deps, ids("m17", "m17", "unknown"), 1)  # m18 and m19 require it
    assert len(folders("a-modules", 2)) <= 4
    dirty = lambda table, column, v=None: {r[0] for r in table.read(spark, v).where("dirty").select(column).collect()}
    assert dirty(modules, "id", 1) == {"m9"} and dirty(modules, "id") == {"m9", "m17", "m18", "m19"} == dirty(blocks, "module_id")
    assert modules.read(spark).count() == 100 and blocks.read(spark).count() == 300
    before = {v: sorted(map(tuple, blocks.read(spark, v).collect())) for v in (0, 1, 2)}
    I.mark_dirty_buckets(modules, blocks, deps, ids("m17", "unknown"), 1)  # the batch again
    assert before == {v: sorted(map(tuple, blocks.read(spark, v).collect())) for v in (0, 1, 2)}
    I.mark_dirty_buckets(modules, blocks, deps, ids(), 2)  # an empty batch is a version too
    assert sorted(map(tuple, blocks.read(spark).collect())) == before[2]
    fresh = blocks.compact(spark, 3, str(tmp_path / "compacted"))
    assert sorted(map(tuple, fresh.read(spark).collect())) == before[2]


def test_buckets_equal_the_plain_form(spark, tmp_path):
    modules, blocks, deps = bucketed(spark, tmp_path, "b")
    index = I.Index(modules.read(spark, 0), blocks.read(spark, 0), deps)
    seeds = spark.createDataFrame([("m3",), ("m40",), ("m77",)], "id string")
    I.mark_dirty_buckets(modules, blocks, deps, seeds, 0)
    plain = I.mark_dirty(index, seeds)
    for table, df in ((modules, plain.modules), (blocks, plain.blocks)):
        assert sorted(map(tuple, table.read(spark).collect())) == sorted(map(tuple, df.select(*table.read(spark).columns).collect()))


def test_affected_by_equals_plain_closure_on_cyclic_graphs(spark):
    """Rings, rings joined by bridges, chains and unknown modules; every module is a seed."""
    import random

    draw = random.Random(12)
    names = [f"m{i:03d}" for i in range(60)]
    edges = {(names[i], names[(i + 1) % 12]) for i in range(12)} | {(names[20 + i], names[20 + (i + 1) % 5]) for i in range(5)}
    edges |= {(names[i], names[i + 1]) for i in range(30, 45)} | {(draw.choice(names), draw.choice(names)) for _ in range(25)}
    edges |= {("gone", names[3]), (names[50], "gone"), (names[51], names[51])}
    blocks = [(f"{n}-{k}", n) for n in names for k in range(draw.randint(0, 3))]
    index = I.Index(
        spark.createDataFrame([(n, False) for n in names], "id string, dirty boolean"),
        spark.createDataFrame(blocks, "id string, module_id string"),
        spark.createDataFrame(sorted(edges), "from_module string, to_module string"),
    )
    seeds = spark.createDataFrame([(n,) for n in [*names, "gone", "nowhere", names[0]]], "id string")
    got = {r.seed: (r.modules, r.blocks) for r in I.affected_by(index, seeds).collect()}
    want = {}
    for seed in {*names, "gone", "nowhere"}:
        seen, todo = {seed}, [seed]
        while todo:
            now = todo.pop()
            for a, b in edges:
                if b == now and a in names and a not in seen:
                    seen.add(a)
                    todo.append(a)
        want[seed] = (len(seen), sum(m in seen for _, m in blocks))
    assert got == want
    ring = [(names[(i + 1) % 12], names[i]) for i in range(12)]
    groups = I.cyclic_groups(spark.createDataFrame(ring, "src string, dst string")).collect()
    assert {(r.id, r.part) for r in groups} == {(names[i], names[11]) for i in range(12)}


def test_a_round_reads_what_was_seen_once(spark, monkeypatch):
    """Distances stay the shortest on a graph with ways of several lengths and a cycle, and seen rows are joined once per round."""
    names = [f"m{i:02d}" for i in range(30)]
    edges = {(names[i + 1], names[i]) for i in range(29)} | {(names[i + 3], names[i]) for i in range(0, 27, 3)} | {(names[2], names[20]), (names[0], names[29])}
    deps = spark.createDataFrame(sorted(edges), "from_module string, to_module string")
    modules = spark.createDataFrame([(n, False) for n in names], "id string, dirty boolean")
    want, front, d = {names[0]: 0}, {names[0]}, 0
    while front:
        d += 1
        front = {a for a, b in edges if b in front and a not in want}
        want |= dict.fromkeys(front, d)
    joins, plain = [], type(deps).join
    monkeypatch.setattr(type(deps), "join", lambda self, other, on=None, how=None: joins.append(how) or plain(self, other, on, how))
    got = I.dependents(deps, modules, spark.createDataFrame([(names[0],)], "id string"))
    rounds = -(-max(want.values()) // I.STEPS) + 1
    assert joins.count("left_anti") <= rounds
    assert sorted((r.id, r.distance) for r in got.collect()) == sorted(want.items())
