"""The build index over modules derived from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusworks.operators import extract as X
from corpusworks.operators import index as I
from corpusworks.operators import routing as J
from corpusworks.operators import sampling as W
from corpusworks.plans.check_queries import CATALOG_SQL
from corpusworks.plans.inputs import table, view
from corpusworks.plans.registry import register
from corpusworks.plans.text_queries import BLOCK_CTE
from corpusworks.session import scratch_path
from corpusworks.sources import files

VIEWS = ["modules", "deps", "blocks"]

# Changed modules: those of one brand.
SEEDS = "seeds as (select m.id from modules m where namespace = 'app.Brand#7')"


def closure(name: str = "reached", edges: str = "deps", start: str = "seeds") -> str:
    """Everything that transitively requires a start module and is indexed."""
    return f"""{name} as (select id from {start} union
        select d.from_module from {edges} d join {name} r on d.to_module = r.id where d.from_module in (select id from modules))"""


def base(spark, sf, dirty: bool | None = None) -> I.Index:
    """The index; ``dirty`` sets all flags first."""
    modules, blocks, deps = (view(spark, sf, name) for name in ("modules", "blocks", "deps"))
    if dirty is not None:
        modules, blocks = modules.withColumn("dirty", F.lit(dirty)), blocks.withColumn("dirty", F.lit(dirty))
    return I.Index(modules, blocks, deps)


def seeds(index: I.Index) -> DataFrame:
    return index.modules.where("namespace = 'app.Brand#7'").select("id")


@register("dependents", f"with recursive {SEEDS}, {closure()} select id from reached", VIEWS)
def dependents(spark, sf) -> DataFrame:
    index = base(spark, sf)
    return I.dependents(index.deps, index.modules, seeds(index)).select("id")


STOP = f"""with recursive {SEEDS}, live as (select d.* from deps d join modules m on m.id = d.from_module where not m.dirty), {closure('reached', 'live')}"""


@register("dependents_stop_at_dirty", f"{STOP} select id from reached", VIEWS)
def dependents_stop_at_dirty(spark, sf) -> DataFrame:
    index = base(spark, sf)
    return I.dependents(index.deps, index.modules, seeds(index), stop_at_dirty=True).select("id")


@register(
    "mark_dirty",
    f"with recursive {SEEDS}, {closure()} select m.id, count(b.id) as blocks, m.id in (select id from reached) as dirty from modules m left join blocks b on b.module_id = m.id group by m.id",
    VIEWS,
)
def mark_dirty(spark, sf) -> DataFrame:
    """From an all-clean index: which modules, and how many blocks, are flagged in the end."""
    index = base(spark, sf, dirty=False)
    after = I.mark_dirty(index, seeds(index))
    flags = after.blocks.groupBy(F.col("module_id").alias("id")).agg(F.count("*").alias("blocks"), F.min("dirty").alias("all"), F.max("dirty").alias("any"))
    rows = after.modules.select("id", "dirty").join(flags, "id")
    # A module and all its blocks share one flag here; anything else would leave the row out.
    return rows.where("dirty = all and dirty = any").select("id", "blocks", "dirty")


@register(
    "propagate_dirty",
    f"""with recursive {SEEDS}, {closure()} select b.id, b.dirty or (module_id in (select id from reached) and module_id not in (select id from seeds)) as dirty from blocks b""",
    VIEWS,
)
def propagate_dirty(spark, sf) -> DataFrame:
    index = base(spark, sf)
    return I.propagate_dirty(index, seeds(index)).blocks.select("id", "dirty")


@register("patch_marks_target", "select b.id, dirty or id in (select 'f' || substr(m.id, 2) from modules m where version = '1.7.0') as dirty from blocks b", VIEWS)
def patch_marks_target(spark, sf) -> DataFrame:
    index = base(spark, sf)
    patches = index.modules.where("version = '1.7.0'").select(F.concat(F.lit("f"), F.substring("id", 2, 20)).alias("id"))
    return I.patch_marks_target(index.blocks, patches).select("id", "dirty")


@register("affected_by", f"""with recursive {SEEDS}, walk as (select id as seed, id from seeds union
    select w.seed, d.from_module from deps d join walk w on d.to_module = w.id where d.from_module in (select id from modules))
    select seed, count(distinct walk.id) as modules, count(b.id) as blocks from walk left join blocks b on b.module_id = walk.id group by 1""", VIEWS)
def affected_by(spark, sf) -> DataFrame:
    index = base(spark, sf)
    return I.affected_by(index, seeds(index))


NEW_BODY = "case when namespace = 'app.Brand#3' then b.body || '!' else b.body end"


def reparsed(index: I.Index) -> tuple[DataFrame, DataFrame]:
    """Modules and blocks parsed again: one brand has new bodies, one type has no blocks any more,
    and every dirty module has one block more."""
    spaces = index.modules.select(F.col("id").alias("module_id"), "namespace", "target", F.col("dirty").alias("_d"))
    joined = index.blocks.join(spaces, "module_id")
    body = F.when(F.col("namespace") == "app.Brand#3", F.concat("body", F.lit("!"))).otherwise(F.col("body"))
    kept = joined.where("target not like 'src/economy/%'").withColumn("body", body)
    extra = index.modules.where("dirty").select(
        F.concat(F.lit("x"), "id").alias("id"), F.col("id").alias("module_id"), F.lit("extra").alias("name"), F.lit("function").alias("kind"),
        F.lit("EXTRA").alias("body"),
    )
    blocks = kept.select("id", "module_id", "name", "kind", "body").unionByName(extra)
    requires = F.when(F.col("namespace") == "app.Brand#3", F.array(F.lit("m0001"), F.lit("m0002"), F.lit("m0001"))).otherwise(F.array(F.lit("m0000")))
    modules = index.modules.where("namespace in ('app.Brand#3', 'app.Brand#4')").withColumn("requires", requires)
    return modules, blocks


CHANGES = f"""
    parsed as (select b.id, {NEW_BODY} as body from blocks b join modules m on m.id = b.module_id where target not like 'src/economy/%'
               union all select 'x' || id, 'EXTRA' from modules where dirty),
    changes as (select coalesce(b.id, p.id) as id, case when b.id is null then 'added' when p.id is null then 'removed' when b.body <> p.body then 'changed' else 'same' end as change
                from blocks b full outer join parsed p on p.id = b.id)
"""


@register("changed_blocks", f"with {CHANGES} select id, change from changes", VIEWS)
def changed_blocks(spark, sf) -> DataFrame:
    index = base(spark, sf)
    return I.changed_blocks(index.blocks, reparsed(index)[1])


REPLACED = """
    fresh as (select id as from_module, unnest(case when namespace = 'app.Brand#3' then ['m0001', 'm0002'] else ['m0000'] end) as to_module from modules where namespace in ('app.Brand#3', 'app.Brand#4')),
    edges as (select * from deps where from_module not in (select from_module from fresh) union all select * from fresh)
"""


@register("replace_deps", f"with {REPLACED} select * from edges", VIEWS)
def replace_deps(spark, sf) -> DataFrame:
    index = base(spark, sf)
    return I.replace_deps(index.deps, reparsed(index)[0]).select("from_module", "to_module")


@register(
    "index_modules",
    f"""with recursive {CHANGES}, {REPLACED}, stale as (
          select distinct coalesce(b.module_id, substr(c.id, 2)) as id from changes c left join blocks b on b.id = c.id where change in ('added', 'changed')),
        {closure('reached', 'edges', 'stale')}
        select m.id, m.dirty or m.id in (select id from reached) as dirty, m.id in (select id from stale) as changed from modules m""",
    VIEWS,
)
def index_modules(spark, sf) -> DataFrame:
    """Index a batch of parsed modules: flags after the upsert and the propagation."""
    index = base(spark, sf)
    modules, blocks = reparsed(index)
    after = I.index_modules(index, modules, blocks, F.expr("timestamp_ntz'2024-01-31'"))
    flagged = after.modules.select("id", "dirty").join(after.changed.withColumn("changed", F.lit(True)), "id", "left")
    return flagged.withColumn("changed", F.coalesce("changed", F.lit(False)))


@register("module_rollup", "select m.id, coalesce(bool_or(b.dirty), m.dirty) as dirty from modules m left join blocks b on b.module_id = m.id group by m.id, m.dirty", VIEWS)
def module_rollup(spark, sf) -> DataFrame:
    index = base(spark, sf)
    return I.module_rollup(index.modules, index.blocks).select("id", "dirty")


@register(
    "record_compiled",
    """with done as (select id from blocks where kind <> 'type' or not dirty), left_over as (select module_id, bool_or(dirty and id not in (select id from done)) as d from blocks group by 1)
       select b.id, b.dirty and b.id not in (select id from done) as dirty, m.dirty and (l.d or m.id not in (select module_id from blocks where id in (select id from done))) as module_dirty,
         case when b.id in (select id from done) then sha256('out ' || b.id) end as output_hash
       from blocks b join modules m on m.id = b.module_id join left_over l on l.module_id = m.id""",
    VIEWS,
)
def record_compiled(spark, sf) -> DataFrame:
    """Outputs of all blocks come in; those of dirty types failed validation and stay dirty."""
    index = base(spark, sf)
    stored = index.blocks.withColumns({"output_code": F.lit(None).cast("string"), "output_hash": F.lit(None).cast("string")})
    results = index.blocks.select(
        F.col("id").alias("block_id"), F.concat(F.lit("out "), "id").alias("code"), F.expr("kind <> 'type' or not dirty").alias("passed")
    )
    after = I.record_compiled(I.Index(index.modules, stored, index.deps), results, F.expr("timestamp_ntz'2024-01-31'"))
    flags = after.modules.select(F.col("id").alias("module_id"), F.col("dirty").alias("module_dirty"))
    return after.blocks.join(flags, "module_id").select("id", "dirty", "module_dirty", "output_hash")


@register("dirty_nodes", "select b.id as block_id, module_id, b.name, kind, profile from blocks b join modules m on m.id = module_id where b.dirty", VIEWS)
def dirty_nodes(spark, sf) -> DataFrame:
    return I.dirty_nodes(base(spark, sf))


@register(
    "build_plan",
    f"select b.id as block_id, module_id, b.name, kind, m.profile, coalesce(phase, -1) as phase, case when phase is not null then m.profile end as adapter_id from blocks b join modules m on m.id = module_id left join {CATALOG_SQL} on cat.profile = m.profile where b.dirty",
    VIEWS,
)
def build_plan(spark, sf) -> DataFrame:
    return I.build_plan(base(spark, sf), J.default_catalog(spark)).withColumn("phase", F.coalesce("phase", F.lit(-1)))


@register("index_stats", "select (select count(*) from modules) as modules, count(*) as blocks, count(*) filter (where dirty) as dirty_blocks from blocks", VIEWS)
def index_stats(spark, sf) -> DataFrame:
    return I.index_stats(base(spark, sf))


@register(
    "module_status",
    "select case when m.dirty then '⚡' else '✓' end as mark, m.id, m.name, profile, target, count(b.id) filter (where b.dirty) as dirty_blocks from modules m left join blocks b on b.module_id = m.id group by all",
    VIEWS,
)
def module_status(spark, sf) -> DataFrame:
    return I.module_status(base(spark, sf))


@register("dependency_degree", "select to_module, count(*) as dependents from deps group by 1", VIEWS)
def dependency_degree(spark, sf) -> DataFrame:
    return I.dependency_degree(view(spark, sf, "deps"))


@register("dangling_requires", "select from_module, to_module from deps where to_module not in (select id from modules)", VIEWS)
def dangling_requires(spark, sf) -> DataFrame:
    return I.dangling_requires(view(spark, sf, "modules"), view(spark, sf, "deps")).select("from_module", "to_module")


@register(
    "required_types",
    """with t as (select d.from_module as module_id, 'TYPE ' || b.name || ' [id=' || b.id || ']  # ' || b.kind as type_line from deps d join blocks b on b.module_id = d.to_module and b.kind = 'type')
       select m.id as module_id, coalesce(type_line, '(none)') as type_line from modules m left join t on t.module_id = m.id""",
    VIEWS,
)
def required_types(spark, sf) -> DataFrame:
    index = base(spark, sf)
    types = index.blocks.where("kind = 'type'").select("module_id", "id", "name", F.col("kind").alias("description"))
    return I.required_types(index.deps, types, index.modules)


@register("modules_ordered", "select id, row_number() over (order by id) as place from modules", VIEWS)
def modules_ordered(spark, sf) -> DataFrame:
    """Modules in id order, with the place each one has."""
    from corpusworks.operators.numbering import dense_positions

    return dense_positions(W.modules_ordered(view(spark, sf, "modules")).select("id"), ["id"], name="place")


@register("blocks_of_module", "select id, module_id, name, kind from blocks where module_id = 'm0042'", VIEWS)
def blocks_of_module(spark, sf) -> DataFrame:
    return W.blocks_of_module(view(spark, sf, "blocks"), "m0042").select("id", "module_id", "name", "kind")


@register("lookup_block", "select id, module_id, body from blocks where id = 'f0123'", VIEWS)
def lookup_block(spark, sf) -> DataFrame:
    return W.lookup(view(spark, sf, "blocks"), "f0123").select("id", "module_id", "body")


@register(
    "index_from_sources",
    f"""with {BLOCK_CTE} select p_size, h.kind, count(*) as blocks, count(distinct h.id) as ids from heads h join part using (p_partkey) group by 1, 2""",
    ["sources"],
)
def index_from_sources(spark, sf) -> DataFrame:
    """Write source files, up to 100 modules each, read them whole and extract the block rows."""
    path = scratch_path(spark, "sources")
    sizes = table(spark, sf, "part").select("p_partkey", "p_size")
    texts = view(spark, sf, "sources").join(sizes, "p_partkey").select(F.col("source").alias("value"), "p_size")
    texts.repartition("p_size").write.option("maxRecordsPerFile", 100).partitionBy("p_size").text(path)
    heads = X.block_headers(files.read_sources(spark, f"{path}/*/*.txt"))
    size = F.regexp_extract("path", r"p_size=(\d+)/", 1).cast("int")
    return heads.groupBy(size.alias("p_size"), "kind").agg(F.count("*").alias("blocks"), F.countDistinct("id").alias("ids"))


@register("versioned_tables", "select id, dirty and version <> '1.7.0' as dirty from modules", VIEWS)
def versioned_tables(spark, sf) -> DataFrame:
    """Write a table, write its next version from a read of the latest one, read that."""
    root = scratch_path(spark, "modules")
    files.write_version(view(spark, sf, "modules"), root, 1)
    current = files.read_version(spark, root)
    cleaned = current.withColumn("dirty", F.col("dirty") & (F.col("version") != "1.7.0"))
    files.write_version(cleaned, root, files.latest_version(spark, root) + 1)
    return files.read_version(spark, root).select("id", "dirty")


@register(
    "read_catalogs",
    """select 'p' || c_nationkey::varchar as profile, c_nationkey % 5 as phase, count(*) as pairs, 'repo/tree/main/p' || c_nationkey::varchar as adapter_id,
       case when c_nationkey % 5 = 0 then 0.9 else 0.5 end::double as threshold, 'phase ' || (c_nationkey % 5)::varchar as description from customer group by c_nationkey""",
)
def read_catalogs(spark, sf) -> DataFrame:
    """A catalog file made from customer counts per nation, read as profiles and phases."""
    from corpusworks.sources import catalogs

    path = scratch_path(spark, "catalog")
    phase = (F.col("c_nationkey") % 5).cast("int")
    counts = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("pairs"))
    name = F.concat(F.lit("p"), F.col("c_nationkey").cast("string"))
    threshold = F.when(phase != 0, F.lit(0.5))
    # One row per nation: the catalog is as small as the nation table.
    rows = counts.select(name.alias("profile"), phase.alias("phase"), threshold.alias("threshold"), "pairs")
    entries = rows.agg(F.map_from_entries(F.collect_list(F.struct("profile", F.struct("phase", "threshold", "pairs")))).alias("adapters"))
    listed = rows.groupBy("phase").agg(F.collect_list("profile").alias("adapters")).agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.col("phase").cast("string"), F.struct("adapters", F.concat(F.lit("phase "), F.col("phase").cast("string")).alias("description"))))
        ).alias("phases")
    )
    entries.join(listed).withColumn("adapter_repo", F.lit("repo")).coalesce(1).write.json(path)
    profiles = catalogs.read_adapter_catalog(spark, path)
    phases = catalogs.read_phase_catalog(spark, path).select("profile", "description", F.col("phase").alias("listed"))
    joined = profiles.join(phases, "profile").where("phase = listed")
    return joined.select("profile", "phase", "pairs", "adapter_id", "threshold", "description")
