"""Rows out of source texts: modules, blocks, fields, regions, manifests and line patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusworks import fixed
from corpusworks.functions import text as T
from corpusworks.functions.checks import block_reason

NAME = "[a-zA-Z_][a-zA-Z0-9_]*"
TAG = rf"\[[ \t]*(?:id|target)[ \t]*=[ \t]*({NAME})[ \t]*\]"
KIND = r"(FUNCTION|PIPELINE|TYPE|PATCH)"
HEADER = rf"^[ \t]*{KIND}(?:[ \t]+(?:FUNCTION|PIPELINE))?[ \t]+({NAME})[ \t]*{TAG}"
# From a header line to the first END line that names a block kind.
BLOCK = rf"(?dms)(^[ \t]*{KIND}(?:[ \t]+(?:FUNCTION|PIPELINE))?[ \t]+{NAME}[ \t]*\[.*?^[ \t]*END[ \t]+{KIND}\b[^\n]*$)"


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def module_fields(sources: DataFrame, text: str = "source") -> DataFrame:
    """Add module_id, name, target, profile, namespace, requires and version of each file."""
    src = F.col(text)
    requires = _first(src, r"(?dm)^[ \t]*REQUIRES[ \t]+([^\n]*?)[ \t]*$")
    return sources.withColumns(
        {
            "module_id": _first(src, rf"(?dm)^[ \t]*MODULE[ \t]+{NAME}[ \t]*{TAG}"),
            "name": _first(src, rf"(?dm)^[ \t]*MODULE[ \t]+({NAME})"),
            "target": _first(src, r'(?dm)^[ \t]*TARGET[ \t]+"([^"\n]*)"'),
            "profile": _first(src, rf"(?dm)^[ \t]*PROFILE[ \t]+({NAME})"),
            "namespace": _first(src, r'(?dm)^[ \t]*NAMESPACE[ \t]+"([^"\n]*)"'),
            "requires": F.coalesce(F.split(requires, r"[ \t]+"), F.array().cast("array<string>")),
            "version": _first(src, r'(?dm)^[ \t]*VERSION[ \t]+"([^"\n]*)"'),
        }
    )


def blocks_of(sources: DataFrame, text: str = "source") -> DataFrame:
    """One row per block, in file order: pos, kind, name, id and the block text with its END line.

    Other columns of the source row are kept; the source text itself is not multiplied.
    """
    kept = [c for c in sources.columns if c != text]
    rows = sources.select(*kept, F.posexplode(_all(F.col(text), BLOCK)).alias("pos", "block"))
    return block_header(rows)


def block_header(rows: DataFrame) -> DataFrame:
    block = F.col("block")
    return rows.withColumns(
        {
            "kind": F.regexp_extract(block, HEADER, 1),
            "name": F.regexp_extract(block, HEADER, 2),
            "id": F.regexp_extract(block, HEADER, 3),
        }
    )


def block_headers(sources: DataFrame, text: str = "source") -> DataFrame:
    """Kind, name and id of each block header line, without reading block bodies."""
    kept = [c for c in sources.columns if c != text]
    lines = _all(F.col(text), rf"(?dm)({HEADER})")
    rows = sources.select(*kept, F.posexplode(lines).alias("pos", "block"))
    return block_header(rows).drop("block")


def block_fields(blocks: DataFrame) -> DataFrame:
    """Add the declared fields of each block; confidence defaults to 1."""
    block = F.col("block")

    def named(word: str) -> Column:
        return _all(block, rf"(?dm)^[ \t]*{word}[ \t]+({NAME})[ \t]*$")

    def expressions(word: str) -> Column:
        return _all(block, rf"(?dm)^[ \t]*{word}[ \t]+([^\n]*?)[ \t]*$")

    return blocks.withColumns(
        {
            "intent": _first(block, r'(?dm)^[ \t]*INTENT[ \t]+"([^"]*)"'),
            "preconditions": expressions("PRECONDITION"),
            "postconditions": expressions("POSTCONDITION"),
            "reads": named("READS"),
            "mutates": named("MUTATES"),
            "emits": named("EMITS"),
            "observable": block.rlike(r"(?dm)^[ \t]*OBSERVABLE[ \t]*$"),
            "confidence": F.coalesce(
                _first(block, r"(?dm)^[ \t]*CONFIDENCE[ \t]+([0-9]+(?:\.[0-9]+)?)[ \t]*$").cast("double"), F.lit(1.0)
            ),
            "timeout": _first(block, r"(?dm)^[ \t]*TIMEOUT[ \t]+([0-9]+[smhd])[ \t]*$"),
        }
    )


def type_fields(blocks: DataFrame) -> DataFrame:
    """One row per line of a TYPE block: field name, type, not_null and default, or a constraint."""
    line = F.col("line")
    field = rf"^(?:FIELD[ \t]+)?({NAME})[ \t]*:[ \t]*({NAME}(?:\([0-9.]+\)|\[[ \t]*\]|\?|[ \t]*<[^>]*>)?)"
    lines = F.transform(F.split("block", "\n"), lambda part: F.trim(F.translate(part, "\t", " ")))
    rows = (
        blocks.where(F.col("kind") == "TYPE")
        .select(*[c for c in blocks.columns if c not in ("block", "pos")], F.posexplode(lines).alias("line_no", "line"))
    )
    return (
        rows.withColumns(
            {
                "field": _first(line, field),
                "type": _first(line, field, 2),
                "not_null": line.rlike(r"\bNOT[ \t]+NULL\b"),
                "default_value": _first(line, r"\bDEFAULT[ \t]+(.*)$"),
                "constraint": _first(line, r"^CONSTRAINT[ \t]+(.*)$"),
            }
        )
        .where(F.col("field").isNotNull() | F.col("constraint").isNotNull())
        .drop("line")
    )


def construct_usage(blocks: DataFrame) -> DataFrame:
    """One row per block and statement form used in it, with the number of uses.

    A plain search for the form's first word comes before its pattern: most blocks use few forms.
    """

    def uses(name: str, pattern: str) -> Column:
        word = "=" if name == "ASSIGN" else name.split(" ")[0]
        return F.when(F.col("block").contains(word), F.regexp_count(F.col("block"), F.lit(pattern))).otherwise(0)

    counted = F.array(
        *[F.struct(F.lit(name).alias("construct"), uses(name, pattern).alias("uses")) for name, pattern in fixed.STATEMENTS]
    )
    kept = [c for c in blocks.columns if c != "block"]
    # The outer form keeps the planner from adding a filter that would count everything twice.
    rows = blocks.select(*kept, F.inline_outer(counted))
    return rows.where(F.col("uses") > 0)


def split_batches(answers: DataFrame, text: str) -> DataFrame:
    """One row per valid block of a batched answer, numbered by its place in the answer."""
    kept = [c for c in answers.columns if c != text]
    rows = answers.select(*kept, F.posexplode(T.split_batch(F.col(text))).alias("pos", "block"))
    return rows.where(block_reason(F.col("block")) == "ok")


def sentinel_regions(files: DataFrame, code: str = "compiled_code") -> DataFrame:
    """One row per marked region: id, name, body, begin_line and end_line (counted from 1).

    A region runs from a BEGIN line to the next marker line when that is the END of the same id.
    Only marker lines take part in the pairing, so the work is linear in the file.
    """
    tag = rf"(?iu)INTL:(BEGIN|END){T.SPACE}+\[id=([^\]]*)\][ \t]*([^═\n]*)"
    lines = T.split_lines(F.col(code))

    def marker(found: Column) -> Column:
        name = F.regexp_replace(F.regexp_extract(found.line, tag, 3), r"(?:-->|\*/)\s*$", "")
        return F.struct(
            found.n.alias("n"),
            F.upper(F.regexp_extract(found.line, tag, 1)).alias("kind"),
            F.regexp_extract(found.line, tag, 2).alias("id"),
            T.strip(name).alias("name"),
        )

    numbered = F.transform("_lines", lambda line, n: F.struct(n.alias("n"), line.alias("line")))
    markers = F.transform(F.filter(numbered, lambda x: x.line.rlike(tag)), marker)
    kept = [c for c in files.columns if c != code]
    staged = files.withColumn("_lines", lines).withColumn("_markers", markers)

    def paired(m: Column, k: Column) -> Column:
        return F.struct(m.alias("begin"), F.get(F.col("_markers"), k + 1).alias("end"))

    regions = F.filter(
        F.transform("_markers", paired),
        lambda p: (p.begin.kind == "BEGIN") & (p.end.kind == "END") & (p.begin.id == p.end.id),
    )
    rows = F.transform(
        regions,
        lambda p: F.struct(
            p.begin.id.alias("id"),
            p.begin["name"].alias("name"),
            F.array_join(F.slice("_lines", p.begin.n + 2, p.end.n - p.begin.n - 1), "\n").alias("body"),
            (p.begin.n + 1).alias("begin_line"),
            (p.end.n + 1).alias("end_line"),
        ),
    )
    return staged.select(*kept, F.inline(rows))


MANIFEST = (
    "project string, description string, modules array<struct<id:string,name:string,target:string,profile:string,"
    "namespace:string,requires:array<string>,description:string,"
    "functions:array<struct<id:string,name:string,description:string>>,"
    "pipelines:array<struct<id:string,name:string,description:string>>,"
    "types:array<struct<id:string,name:string,description:string>>>>,"
    "shared_types array<struct<id:string,name:string,description:string>>, dependency_graph map<string,array<string>>"
)


def read_manifests(manifests: DataFrame, text: str = "manifest") -> DataFrame:
    """Parse manifest texts, fences removed; accepts only those that pass manifest_reason()."""
    from corpusworks.functions.checks import manifest_reason

    clean = T.strip_fences_all(F.col(text), lang="(?:json)?")
    kept = [c for c in manifests.columns if c != text]
    staged = manifests.withColumn("_clean", clean)
    return staged.where(manifest_reason(F.col("_clean")) == "ok").select(
        *kept, F.from_json("_clean", MANIFEST).alias("m")
    )


def manifest_modules(parsed: DataFrame) -> DataFrame:
    kept = [c for c in parsed.columns if c != "m"]
    return parsed.select(*kept, F.col("m.project").alias("project"), F.explode("m.modules").alias("module")).select(
        *kept, "project", "module.id", "module.name", "module.target", "module.profile", "module.namespace",
        "module.requires",
    )


def manifest_members(parsed: DataFrame) -> DataFrame:
    """One row per declared function, pipeline and type, with its module and kind."""
    kept = [c for c in parsed.columns if c != "m"]

    def tagged(kind: str, members: Column) -> Column:
        return F.transform(
            F.coalesce(members, F.array().cast("array<struct<id:string,name:string,description:string>>")),
            lambda x: F.struct(F.lit(kind).alias("kind"), x.id.alias("id"), x["name"].alias("name"),
                               x.description.alias("description")),
        )

    modules = parsed.select(*kept, F.explode("m.modules").alias("x"))
    members = F.concat(
        tagged("function", F.col("x.functions")), tagged("pipeline", F.col("x.pipelines")), tagged("type", F.col("x.types"))
    )
    return modules.select(*kept, F.col("x.id").alias("module_id"), F.inline(members))


def manifest_edges(parsed: DataFrame) -> DataFrame:
    kept = [c for c in parsed.columns if c != "m"]
    edges = parsed.select(*kept, F.explode("m.dependency_graph").alias("from_module", "targets"))
    return edges.select(*kept, "from_module", F.explode("targets").alias("to_module"))


def apply_line_patches(docs: DataFrame, patches: DataFrame, key: str, text: str) -> DataFrame:
    """Apply line patches to texts: adds ``patched`` and ``applied`` (patches whose anchor exists).

    ``patches``: key, seq, action (insert, replace, remove), position (after, before, at), anchor,
    body. The anchor is the first line that contains it, counted in the unpatched text; patches of
    one anchor apply in seq order. Patches are gathered per document, which holds only the patches
    written for that document; texts without patches pass through the left join untouched.
    """
    ops = patches.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("seq", "action", "position", "anchor", "body"))).alias("_ops")
    )
    # Hints and the lines are separate projections, so that the text is split once.
    staged = docs.join(ops, key, "left").withColumn("_lines", F.split(text, "\n"))

    def located(op: Column) -> Column:
        first = F.array_position(F.transform("_lines", lambda line: line.contains(op.anchor)), True)
        return op.withField("at", first)

    staged = staged.withColumn(
        "_ops", F.filter(F.transform("_ops", located), lambda op: op.at > 0)
    )

    def bodies(n: Column, which) -> Column:
        return F.transform(F.filter("_ops", lambda op: (op.at == n + 1) & which(op)), lambda op: op.body)

    def rebuilt(line: Column, n: Column) -> Column:
        before = bodies(n, lambda op: (op.action == "insert") & (op.position == "before"))
        after = bodies(n, lambda op: (op.action == "insert") & (op.position != "before"))
        replaced = bodies(n, lambda op: op.action == "replace")
        gone = F.exists("_ops", lambda op: (op.at == n + 1) & (op.action == "remove"))
        kept = (
            F.when(F.size(replaced) > 0, F.slice(replaced, -1, 1))
            .when(gone, F.array().cast("array<string>"))
            .otherwise(F.array(line))
        )
        return F.concat(before, kept, after)

    patched = F.array_join(F.flatten(F.transform("_lines", rebuilt)), "\n")
    touched = F.coalesce(F.size("_ops"), F.lit(0))
    return (
        staged.withColumn("applied", F.when(F.col("_ops").isNull(), 0).otherwise(touched))
        .withColumn("patched", F.when(F.col("applied") > 0, patched).otherwise(F.col(text)))
        .drop("_ops", "_lines")
    )


def patched_preconditions(blocks: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Preconditions after INSERT/REMOVE PRECONDITION patches: rows (key, precondition).

    ``changes``: key, action (insert or remove), precondition.
    """
    removed = changes.where("action = 'remove'").select(key, "precondition")
    added = changes.where("action = 'insert'").select(key, "precondition")
    current = blocks.select(key, F.explode("preconditions").alias("precondition"))
    return current.unionByName(added).distinct().join(removed, [key, "precondition"], "left_anti")
