"""The build index as tables: upserts, change detection, dirty propagation and reports.

Tables are DataFrames; every operator returns new ones. Writing them back is the caller's step
(sources.tables), because a path may not be overwritten while it is read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corpusworks.operators.constructs import upsert
from corpusworks.session import materialise, scratch_path
from corpusworks.sources.files import BucketedTable


@dataclass(frozen=True)
class Index:
    """modules(id, dirty, …), blocks(id, module_id, dirty, …), deps(from_module, to_module).

    ``changed`` holds the ids of the modules whose blocks the latest batch added or changed.
    """

    modules: DataFrame
    blocks: DataFrame
    deps: DataFrame
    changed: DataFrame | None = None


def body_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def changed_blocks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change): added, changed, removed or same, by body hash. Bodies are not shuffled."""
    left = old.select("id", body_hash(F.col("body")).alias("_old"))
    right = new.select("id", body_hash(F.col("body")).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(F.col("_old") != F.col("_new"), "changed")
        .otherwise("same")
    )
    return left.join(right, "id", "full_outer").select("id", change.alias("change"))


def replace_deps(deps: DataFrame, parsed: DataFrame) -> DataFrame:
    """Edges of the parsed modules (id, requires) replace all earlier ones of these modules."""
    kept = deps.join(parsed.select(F.col("id").alias("from_module")), "from_module", "left_anti")
    fresh = parsed.select(F.col("id").alias("from_module"), F.explode("requires").alias("to_module")).distinct()
    return kept.unionByName(fresh)


def index_modules(index: Index, modules: DataFrame, blocks: DataFrame, now: Column, force: bool = False) -> Index:
    """Upsert parsed modules (with ``requires``) and blocks (with ``body``) as one batch.

    Blocks whose body hash did not change keep their output and flag unless ``force`` is set;
    modules with a changed block, and all their dependents, become dirty. Runs jobs when called:
    the rows to be stored are written once, as the tables are built from them several times.
    """
    change = changed_blocks(index.blocks, blocks)
    touched = change.where("change in ('added', 'changed')").select("id")
    fresh = blocks if force else blocks.join(touched, "id", "left_semi")
    fresh = fresh.withColumns({"dirty": F.lit(True), "body_hash": body_hash(F.col("body")), "indexed_at": now})
    fresh = materialise(_same_columns(fresh, index.blocks), "blocks")
    new_blocks = upsert(index.blocks, fresh, "id")
    seeds = materialise(fresh.select(F.col("module_id").alias("id")).distinct(), "stale")
    stale = seeds.withColumn("_stale", F.lit(True))
    previous = index.modules.select("id", F.col("dirty").alias("_was"))
    rows = modules.join(stale, "id", "left").join(previous, "id", "left")
    # A module seen for the first time is dirty, otherwise its own blocks decide.
    dirty = F.lit(force) | F.coalesce("_stale", "_was", F.lit(True)) | F.coalesce("_was", F.lit(True))
    rows = materialise(rows.withColumns({"dirty": dirty, "indexed_at": now}).drop("_stale", "_was"), "modules")
    new_modules = upsert(index.modules, _same_columns(rows, index.modules), "id")
    new_deps = replace_deps(index.deps, rows)
    return _flag_dependents(Index(new_modules, new_blocks, new_deps, seeds), seeds)


def _same_columns(rows: DataFrame, like: DataFrame) -> DataFrame:
    have = set(rows.columns)
    return rows.select(
        *[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema]
    )


# Steps taken per written round: fewer jobs on deep graphs, at most this many steps to repeat
# when an executor is lost.
STEPS = 4


def dependents(
    deps: DataFrame, modules: DataFrame, seeds: DataFrame, stop_at_dirty: bool = False, per: list[str] = ()
) -> DataFrame:
    """All modules that transitively require a seed, seeds included, with their distance in steps.

    ``per`` names extra seed columns that keep separate closures apart. A round takes STEPS steps
    from the latest modules along the edges, leaves out what earlier rounds saw, which is read once
    for all steps, and writes the rest to the shared folder: lineage stays short, lost executors cost one
    round, and the planner sees the true size of the frontier, so it broadcasts small ones and shuffles large ones. Unknown
    modules are skipped; cycles end because no round expands what an earlier one saw. With
    stop_at_dirty, modules that are dirty already are neither reported nor passed through.
    """
    spark = deps.sparkSession
    reachable = modules.where(~F.col("dirty")) if stop_at_dirty else modules
    edges = deps.join(reachable.select(F.col("id").alias("from_module")), "from_module", "left_semi")
    edges = materialise(edges.select("from_module", "to_module"), "edges")
    keys = [*per, "id"]
    schema = StructType([*seeds.select(*keys).schema.fields, StructField("distance", IntegerType())])
    folder = scratch_path(spark, "closure")
    found, distance = seeds.select(*keys).distinct().withColumn("distance", F.lit(0)), 0
    paths: list[str] = []
    while True:
        paths.append(f"{folder}/round={len(paths)}")
        seen = Observation()
        found.observe(seen, F.count_if(F.col("distance") == distance).alias("n")).write.parquet(paths[-1])
        visited = spark.read.schema(schema).parquet(*paths)
        if seen.get["n"] == 0:
            return visited
        layer = spark.read.schema(schema).parquet(paths[-1]).where(F.col("distance") == distance).select(*keys)
        steps = []
        for _ in range(STEPS):
            distance += 1
            layer = edges.join(layer.withColumnRenamed("id", "to_module"), "to_module")
            layer = layer.select(*per, F.col("from_module").alias("id")).distinct()
            steps.append(layer.withColumn("distance", F.lit(distance)))
        together = steps[0]
        for step in steps[1:]:
            together = together.unionByName(step)
        nearest = together.groupBy(*keys).agg(F.min("distance").alias("distance"))
        found = nearest.join(visited.select(*keys), keys, "left_anti")


def _flag(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Set dirty on the rows whose key is in ids (distinct, one column ``id``)."""
    marks = ids.select(F.col("id").alias("_hit"))
    joined = df.join(marks, F.col(key) == F.col("_hit"), "left")
    return joined.withColumn("dirty", F.col("dirty") | F.col("_hit").isNotNull()).drop("_hit")


def _flag_dependents(index: Index, seeds: DataFrame, stop_at_dirty: bool = False) -> Index:
    reached = dependents(index.deps, index.modules, seeds, stop_at_dirty).select("id")
    downstream = reached.join(seeds.select("id"), "id", "left_anti")
    modules = _flag(_flag(index.modules, seeds.select("id").distinct(), "id"), downstream, "id")
    return replace(index, modules=modules, blocks=_flag(index.blocks, downstream, "module_id"))


def propagate_dirty(index: Index, seeds: DataFrame, stop_at_dirty: bool = False) -> Index:
    """Flag everything that transitively requires the seeds; the seeds' own blocks stay as they are."""
    return _flag_dependents(index, seeds.select("id").distinct(), stop_at_dirty)


def mark_dirty(index: Index, ids: DataFrame, stop_at_dirty: bool = False) -> Index:
    """Flag the modules and all their blocks, then propagate."""
    ids = ids.select("id").distinct()
    flagged = replace(index, blocks=_flag(index.blocks, ids, "module_id"))
    return _flag_dependents(flagged, ids, stop_at_dirty)


def mark_dirty_buckets(
    modules: BucketedTable, blocks: BucketedTable, deps: DataFrame, ids: DataFrame, version: int, stop_at_dirty: bool = False
) -> list[int]:
    """mark_dirty on bucketed tables: reads ``version``, writes the next one, and in it only the buckets with a
    module that is flagged. ``blocks`` is cut by module_id into as many buckets as ``modules``.

    Returns the buckets written, which is all the driver gets. Run again for the same version it writes the same.
    """
    spark = deps.sparkSession
    if modules.buckets != blocks.buckets:
        raise ValueError("both tables must have as many buckets")
    seeds = ids.select("id").distinct()
    reached = dependents(deps, modules.read(spark, version), seeds, stop_at_dirty).select("id").unionByName(seeds)
    flagged = materialise(reached.distinct(), "flagged")
    written = sorted(r[0] for r in flagged.select(modules.bucket_of(F.col("id"))).distinct().collect())
    for table, key in ((blocks, "module_id"), (modules, "id")):
        table.write(_flag(table.read(spark, version, only=written), flagged, key), version + 1, retry=True)
    return written


def patch_marks_target(blocks: DataFrame, patches: DataFrame) -> DataFrame:
    """A patch flags only its target block."""
    return _flag(blocks, patches.select("id").distinct(), "id")


def module_rollup(modules: DataFrame, blocks: DataFrame) -> DataFrame:
    """A module is dirty as long as one of its blocks is; without blocks its flag stays."""
    states = blocks.groupBy("module_id").agg(F.max("dirty").alias("_any"))
    joined = modules.join(states, F.col("id") == F.col("module_id"), "left")
    return joined.withColumn("dirty", F.coalesce("_any", "dirty")).drop("_any", "module_id")


def record_compiled(index: Index, results: DataFrame, now: Column, only_passed: bool = True) -> Index:
    """Store outputs (block_id, code, passed), clear block flags, then roll up the touched modules."""
    accepted = results.where("passed") if only_passed else results
    accepted = accepted.select(F.col("block_id").alias("id"), F.col("code").alias("_code"))
    blocks = index.blocks.join(accepted, "id", "left")
    done = F.col("_code").isNotNull()
    for column, value in (
        ("dirty", F.lit(False)),
        ("compiled_at", now),
        ("output_code", F.col("_code")),
        ("output_hash", F.sha2(F.col("_code"), 256)),
    ):
        if column in blocks.columns:
            blocks = blocks.withColumn(column, F.when(done, value).otherwise(F.col(column)))
    blocks = blocks.drop("_code")
    touched = index.blocks.join(accepted, "id", "left_semi").select("module_id").distinct()
    states = blocks.join(touched, "module_id", "left_semi").groupBy("module_id").agg(F.max("dirty").alias("_any"))
    modules = index.modules.join(states, F.col("id") == F.col("module_id"), "left")
    clean = F.col("_any").isNotNull() & ~F.col("_any")
    modules = modules.withColumn("dirty", F.when(clean, F.lit(False)).otherwise(F.col("dirty")))
    if "compiled_at" in modules.columns:
        modules = modules.withColumn("compiled_at", F.when(clean, now).otherwise(F.col("compiled_at")))
    return replace(index, modules=modules.drop("_any", "module_id"), blocks=blocks)


def dirty_nodes(index: Index) -> DataFrame:
    """Dirty blocks with their module's profile, ordered by module and block."""
    profiles = index.modules.select(F.col("id").alias("module_id"), "profile")
    dirty = index.blocks.where("dirty").select(F.col("id").alias("block_id"), "module_id", "name", "kind")
    return dirty.join(profiles, "module_id").orderBy("module_id", "block_id")


def build_plan(index: Index, catalog: DataFrame) -> DataFrame:
    """The work list: dirty blocks with the adapter their profile routes to."""
    adapters = catalog.select("profile", "phase", "adapter_id")
    return dirty_nodes(index).join(adapters, "profile", "left").orderBy("module_id", "block_id")


def _mark_of(df: DataFrame, *columns: str) -> tuple:
    """Count and checksum of rows, which change when the rows do."""
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64(*columns))).first())


def _on_cycles(edges: DataFrame) -> DataFrame:
    """The edges left when modules that nothing requires or that require nothing are taken away again and again."""
    left = None
    while True:
        n = edges.count()
        if n in (0, left):
            return edges
        left = n
        sides = edges.select(F.col("src").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        both = sides.groupBy("id").agg(F.max("out").alias("out"), F.max("in").alias("in")).where("out = 1 and in = 1").select("id")
        kept = edges.join(both.withColumnRenamed("id", "src"), "src", "left_semi").join(both.withColumnRenamed("id", "dst"), "dst", "left_semi")
        edges = materialise(kept.select("src", "dst"), "trimmed")


def cyclic_groups(edges: DataFrame) -> DataFrame:
    """id, part for the nodes of (src, dst) that lie on cycles; part is the largest id of a group of nodes that all
    reach each other.

    Nodes off all cycles are trimmed. Then each node takes the largest id that reaches it; those that reach the node
    of that id on edges of the same id are its group. Groups are taken out and the rest goes on. Each round is
    written, so lineage stays short.
    """
    edges, found = materialise(edges.where("src <> dst").select("src", "dst").distinct(), "edges"), None
    while True:
        edges = _on_cycles(edges)
        if not edges.limit(1).count():
            return found if found is not None else edges.select(F.col("src").alias("id"), F.col("dst").alias("part"))
        colours = materialise(edges.select(F.col("src").alias("id")).distinct().withColumn("part", F.col("id")), "colours")
        mark = None
        while mark != (mark := _mark_of(colours, "id", "part")):
            for _ in range(2):  # a step reads the last one twice, so more of them in one plan cost more than they save
                passed = edges.join(colours.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "part")
                colours = colours.unionByName(passed).groupBy("id").agg(F.max("part").alias("part"))
            colours = materialise(colours, "colours")
        of = lambda end, name: colours.select(F.col("id").alias(end), F.col("part").alias(name))  # noqa: E731, B023
        same = materialise(edges.join(of("src", "part"), "src").join(of("dst", "_to"), "dst").where("part = _to").select("src", "dst", "part"), "same")
        group = materialise(colours.where("id = part"), "group")
        size = None
        while size != (size := group.count()):
            for _ in range(2):
                back = same.join(group.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), "part")
                group = group.unionByName(back).distinct()
            group = materialise(group, "group")
        found = group if found is None else found.unionByName(group)
        taken = group.select("id")
        rest = edges.join(taken.withColumnRenamed("id", "src"), "src", "left_anti").join(taken.withColumnRenamed("id", "dst"), "dst", "left_anti")
        edges = materialise(rest.select("src", "dst"), "edges")


def affected_by(index: Index, seeds: DataFrame) -> DataFrame:
    """Per seed module: how many modules and blocks a change would rebuild.

    Modules that reach each other are affected together, so they are condensed to one node first (only in the part
    of the graph that the seeds reach). Closures run over the condensed graph, one per condensed seed: their rows are
    bounded by pairs of groups, however many modules a group has and however many of them are seeds.
    """
    seeds = materialise(seeds.select("id").distinct(), "seeds")
    reached = materialise(dependents(index.deps, index.modules, seeds).select("id"), "reached")
    inside = index.deps.join(reached.withColumnRenamed("id", "from_module"), "from_module", "left_semi")
    inside = inside.join(reached.withColumnRenamed("id", "to_module"), "to_module", "left_semi")
    groups = cyclic_groups(inside.select(F.col("to_module").alias("src"), F.col("from_module").alias("dst")))
    parts = reached.join(groups, "id", "left").select("id", F.coalesce("part", "id").alias("part"))
    parts = materialise(parts, "parts")
    # closures carry numbers, which are shorter than ids and hashed faster
    numbers = materialise(parts.select("part").distinct().withColumn("no", F.monotonically_increasing_id()), "numbers")
    parts = materialise(parts.join(numbers, "part").select("id", F.col("no").alias("part")), "parts")
    of = lambda end, name: parts.select(F.col("id").alias(end), F.col("part").alias(name))
    known = index.modules.select(F.col("id").alias("from_module"))
    edges = inside.join(known, "from_module", "left_semi").join(of("from_module", "_from"), "from_module").join(of("to_module", "_to"), "to_module")
    edges = edges.where("_from <> _to").select(F.col("_from").alias("from_module"), F.col("_to").alias("to_module")).distinct()
    blocks = index.blocks.join(of("module_id", "part"), "module_id").groupBy("part").agg(F.count("*").alias("_blocks"))
    sizes = materialise(parts.groupBy("part").agg(F.count("*").alias("_modules")).join(blocks, "part", "left"), "sizes")
    wanted = seeds.join(parts, "id").select("id", "part")
    start = wanted.select(F.col("part").alias("seed"), F.col("part").alias("id")).distinct()
    reach = dependents(edges, sizes.select(F.col("part").alias("id")), start, per=["seed"]).select("seed", F.col("id").alias("part"))
    totals = reach.join(sizes, "part").groupBy("seed").agg(F.sum("_modules").alias("modules"), F.coalesce(F.sum("_blocks"), F.lit(0)).alias("blocks"))
    return wanted.join(totals.withColumnRenamed("seed", "part"), "part").select(F.col("id").alias("seed"), "modules", "blocks")


def index_stats(index: Index) -> DataFrame:
    """One row: modules, blocks, dirty_blocks."""
    modules = index.modules.agg(F.count("*").alias("modules"))
    blocks = index.blocks.agg(F.count("*").alias("blocks"), F.count_if("dirty").alias("dirty_blocks"))
    return modules.join(F.broadcast(blocks))  # one row each


def module_status(index: Index) -> DataFrame:
    """Each module with its flag mark and number of dirty blocks."""
    dirty = index.blocks.where("dirty").groupBy("module_id").agg(F.count("*").alias("dirty_blocks"))
    rows = index.modules.join(dirty, F.col("id") == F.col("module_id"), "left")
    return rows.select(
        F.when(F.col("dirty"), "⚡").otherwise("✓").alias("mark"), "id", "name", "profile", "target",
        F.coalesce("dirty_blocks", F.lit(0).cast("bigint")).alias("dirty_blocks"),
    ).orderBy("id")


def dependency_degree(deps: DataFrame) -> DataFrame:
    return deps.groupBy("to_module").agg(F.count("*").alias("dependents"))


def dangling_requires(modules: DataFrame, deps: DataFrame) -> DataFrame:
    """Edges that point at modules the index does not hold."""
    return deps.join(modules.select(F.col("id").alias("to_module")), "to_module", "left_anti")


def required_types(deps: DataFrame, types: DataFrame, modules: DataFrame) -> DataFrame:
    """Type lines each module may use: one row per declared type of a required module, and one
    '(none)' row for modules without any. ``types``: module_id, id, name, description."""
    line = F.concat(
        F.lit("TYPE "), F.col("name"), F.lit(" [id="), F.col("id"), F.lit("]  # "), F.coalesce("description", F.lit(""))
    )
    lines = types.select(F.col("module_id").alias("to_module"), line.alias("type_line"))
    found = deps.join(lines, "to_module").select(F.col("from_module").alias("module_id"), "type_line")
    rows = modules.select(F.col("id").alias("module_id")).join(found, "module_id", "left")
    return rows.withColumn("type_line", F.coalesce("type_line", F.lit("(none)")))
