"""Corpus tables derived from the given tables.

The given tables hold prose and orders, not code. Each view below is one SELECT over whole
tables and whole texts in a dialect both engines share, so a check can start from the same
rows. Flaws are planted by the remainder of a key; no row is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusworks import fixed

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

PROFILE_LIST = ",".join(row[0] for row in fixed.PROFILES)
CONSTRUCT_LIST = ",".join(fixed.CONSTRUCTS)


def _numbered(letter: str, key: str) -> str:
    return (
        f"case when {key} < 10000 then '{letter}' || lpad(cast({key} as string), 4, '0') "
        f"else '{letter}' || cast({key} as string) end"
    )


def _nth(list_text: str, position: str) -> str:
    return f"split_part('{list_text}', ',', cast(1 + {position} as int))"


VIEWS: dict[str, str] = {}

# One compiled block per document. The whole text rides along as a comment (Python) or as is.
VIEWS["compiled"] = f"""
with numbered as (
  select doc_id, lang, source, text, n_chars,
         {_numbered('f', 'doc_id')} as block_id,
         'task_' || cast(doc_id as string) as name,
         {_nth(PROFILE_LIST, '(doc_id % 24)')} as profile
  from documents
), styled as (
  select *,
         case when profile like 'sql%' then '-- ' when profile like 'html%' then '<!-- '
              when profile like 'css%' then '/* ' else '# ' end as opener,
         case when profile like 'html%' then ' -->' when profile like 'css%' then ' */' else '' end as closer,
         case when doc_id % 11 = 0 then block_id || 'x' else block_id end as marked_id,
         case when doc_id % 5 = 0 then '' else 'logger.info(value)' end as log_call,
         case when doc_id % 29 = 0 then 'keep(value)' else 'db.execute(value)' end as write_call,
         case when doc_id % 23 = 0 then 'Record(value)' else 'return Record(value)' end as result
  from numbered
), bodies as (
  select *,
         case when profile like 'python%' then
                '# ' || replace(text, chr(10), chr(10) || '# ') || chr(10)
                || 'def ' || name || '(value):' || chr(10)
                || '    ' || log_call || chr(10) || '    ' || write_call || chr(10) || '    ' || result
              when profile like 'sql%' and doc_id % 3 = 0 then
                text || chr(10) || 'select value from ' || name || '; -- ' || log_call || ' ' || write_call || ' ' || result
              when profile like 'html%' then
                '<p>' || text || '</p>' || chr(10) || log_call || ' ' || write_call || ' ' || result
              when profile like 'css%' then
                text || chr(10) || '.' || name || ' {{ color: red }}' || log_call || write_call || result
              else text || chr(10) || 'function ' || name || '(value) {{ ' || log_call || '; ' || write_call || '; ' || result || ' }}'
         end
         || case when doc_id % 13 = 0 then chr(10) || '# TODO: later' else '' end
         || case when doc_id % 31 = 0 then chr(10) || '  pass  ' else '' end
         || case when doc_id % 17 = 0 then chr(10) || '{{' else '' end
         || case when doc_id % 37 = 0 then chr(10) || ')(' else '' end as body
  from styled
), coded as (
  select *,
         opener || '═══ INTL:BEGIN [id=' || marked_id || '] ' || name || ' ═══' || closer || chr(10)
         || body || chr(10)
         || case when doc_id % 7 = 0 then ''
                 else opener || '═══ INTL:END   [id=' || marked_id || '] ' || name || ' ═══' || closer end as compiled_code
  from bodies
)
select doc_id, block_id, name, profile, lang, source, text, n_chars, body, compiled_code,
       case when doc_id % 16 = 5 then 'BLOCK ' else 'FUNCTION ' end || name || ' [id=' || block_id || ']' || chr(10)
       || case when doc_id % 14 = 3 then '' else '  INTENT "' || text || '"' || chr(10) end
       || '  PRECONDITION value IS NOT NULL' || chr(10)
       || case when doc_id % 15 = 4 then '' else 'END FUNCTION ' || name || ' [id=' || block_id || ']' end as intl_block,
       case when doc_id % 19 = 0 then '  ```python' || chr(10) || compiled_code || chr(10) || '```  ' else compiled_code end as raw_code,
       case when doc_id % 4 = 0 then null
            when doc_id % 6 = 1 then 'missing_' || cast(doc_id as string) || ' > 0;value IS NOT NULL'
            when doc_id % 10 = 3 then '1 > 0'
            else 'value IS NOT NULL;Record.length >= 1' end as pre_text,
       case when doc_id % 3 = 0 then null
            when doc_id % 8 = 1 then 'absent_' || cast(doc_id as string) || ' IS NOT NULL'
            when doc_id % 9 = 2 then '1 > 0'
            else 'Record IS NOT NULL;value > 0' end as post_text,
       case when doc_id % 2 = 0 then 'records_table' else null end as mutates_text,
       case when doc_id % 9 = 0 then 'record_done' else null end as emits_text,
       doc_id % 3 <> 0 as observable,
       case when doc_id % 5 = 1 then 'Record' when doc_id % 5 = 2 then 'Missing' when doc_id % 5 = 3 then '' else null end as return_type,
       doc_id % 5 as attempt
from coded
"""

# Training pairs: every document is a prompt (true exact copies included), copies share the adapter.
VIEWS["pairs"] = f"""
select c.doc_id as idx, c.block_id, {_nth(PROFILE_LIST, '(c.n_chars % 24)')} as adapter,
       {_nth(CONSTRUCT_LIST, '(c.doc_id * 7 % 22)')} as construct,
       case when c.doc_id % 10 < 6 then 'A' when c.doc_id % 10 < 9 then 'B' else 'C' end as category,
       'You compile for ' || c.profile as system, c.text as prompt, c.compiled_code as completion
from ({VIEWS['compiled']}) c
"""

# A module per part; each requires the module at half its number, every fifth one also a neighbour,
# every eleventh one the first module, and two small cycles exist.
VIEWS["modules"] = f"""
select {_numbered('m', 'p_partkey')} as id, 'mod_' || replace(p_name, ' ', '_') as name,
       'src/' || lower(p_type) || '/' || cast(p_partkey as string) || '.py' as target,
       {_nth(PROFILE_LIST + ',unknown_target', '(p_partkey % 25)')} as profile,
       'app.' || p_brand as namespace, '1.' || cast(p_size as string) || '.0' as version,
       p_partkey % 3 = 0 as dirty, p_partkey as module_no
from part
"""

VIEWS["deps"] = f"""
with edges as (
  select p_partkey as f, cast(floor(p_partkey / 2) as bigint) as t from part where p_partkey > 0
  union all
  select p_partkey, p_partkey - 7 from part where p_partkey % 5 = 0 and p_partkey > 7
  union all
  select p_partkey, p_partkey % 3 from part where p_partkey % 3 = 0 and p_partkey > 0
  union all
  select p_partkey - 1, p_partkey from part where p_partkey in (41, 77)
  union all
  select p_partkey, p_partkey + 1000000 from part where p_partkey % 97 = 0
)
select distinct {_numbered('m', 'f')} as from_module, {_numbered('m', 't')} as to_module from edges
"""

# Two blocks per module.
VIEWS["blocks"] = f"""
select {_numbered('f', '(2 * p_partkey + n)')} as id, {_numbered('m', 'p_partkey')} as module_id,
       case when n = 0 then 'get_' else 'put_' end || replace(p_name, ' ', '_') as name,
       case when (p_partkey + n) % 7 = 0 then 'pipeline' when (p_partkey + n) % 5 = 0 then 'type' else 'function' end as kind,
       'BODY ' || p_name || ' ' || p_type || ' ' || cast(n as string) as body,
       (p_partkey + n) % 4 = 0 as dirty, cast(50 + p_size % 50 as double) / 100 as confidence
from (select *, 0 as n from part union all select *, 1 as n from part) p
"""

# One source file per part: a module header, a function, a pipeline, a type and a patch.
VIEWS["sources"] = f"""
select p_partkey, 'src/' || cast(p_partkey as string) || '.block' as path,
  'MODULE mod_' || replace(p_name, ' ', '_') || ' [id=' || {_numbered('m', 'p_partkey')} || ']' || chr(10)
  || 'TARGET    "src/' || cast(p_partkey as string) || '.py"' || chr(10)
  || 'PROFILE   ' || {_nth(PROFILE_LIST, '(p_partkey % 24)')} || chr(10)
  || 'NAMESPACE "app.' || p_brand || '"' || chr(10)
  || case when p_partkey > 0 then 'REQUIRES  ' || {_numbered('m', 'cast(floor(p_partkey / 2) as bigint)')} || ' m0000' || chr(10) else '' end
  || case when p_partkey % 2 = 0 then 'VERSION   "1.' || cast(p_size as string) || '.0"' || chr(10) else '' end
  || chr(10)
  || 'FUNCTION make_' || replace(p_name, ' ', '_') || ' [id=' || {_numbered('f', 'p_partkey')} || ']' || chr(10)
  || case when p_partkey % 9 = 0 then '' else '  INTENT       "make ' || p_name || '"' || chr(10) end
  || '  PRECONDITION size > ' || cast(p_size as string) || chr(10)
  || case when p_partkey % 3 = 0 then '  PRECONDITION name.length > 0' || chr(10) else '' end
  || case when p_partkey % 4 = 0 then '' else '  POSTCONDITION result IS NOT NULL' || chr(10) end
  || '  READS        parts_table' || chr(10)
  || case when p_partkey % 2 = 0 then '  MUTATES      stock_table' || chr(10) else '' end
  || case when p_partkey % 6 = 0 then '  EMITS        part_made' || chr(10) || '  OBSERVABLE' || chr(10) else '' end
  || case when p_partkey % 5 = 0 then '  CONFIDENCE   0.' || cast(50 + p_size % 50 as string) || chr(10) else '' end
  || case when p_partkey % 7 = 0 then '  TIMEOUT      ' || cast(1 + p_size % 30 as string) || 's' || chr(10) else '' end
  || chr(10)
  || '  row = QUERY parts_table WHERE size > ' || cast(p_size as string) || ' LIMIT 1' || chr(10)
  || '  IF row IS NULL THEN FAIL PartError("none")' || chr(10)
  || case when p_partkey % 2 = 0 then '  PERSIST stock_table INSERT (name: row.name)' || chr(10) else '' end
  || '  RETURN Part(name: row.name)' || chr(10)
  || 'END FUNCTION make_' || replace(p_name, ' ', '_') || ' [id=' || {_numbered('f', 'p_partkey')} || ']' || chr(10)
  || chr(10)
  || 'PIPELINE ship_' || cast(p_partkey as string) || ' [id=' || {_numbered('p', 'p_partkey')} || ']' || chr(10)
  || '  INTENT "ship ' || p_type || '"' || chr(10)
  || '  SEQUENCE' || chr(10)
  || '    total = AGGREGATE lines BY part COMPUTE SUM' || chr(10)
  || '    EMIT shipped(part: total)' || chr(10)
  || '  END SEQUENCE' || chr(10)
  || case when p_partkey % 3 = 1 then '  LOOP lines AS line DO' || chr(10) || '    CALL pack(line)' || chr(10) || '  END LOOP' || chr(10) else '' end
  || '  RETURN total' || chr(10)
  || 'END PIPELINE ship_' || cast(p_partkey as string) || ' [id=' || {_numbered('p', 'p_partkey')} || ']' || chr(10)
  || chr(10)
  || 'TYPE Part' || cast(p_partkey as string) || ' [id=' || {_numbered('t', 'p_partkey')} || ']' || chr(10)
  || '  name      : String(' || cast(20 + p_size as string) || ') NOT NULL' || chr(10)
  || '  FIELD size : Int NOT NULL DEFAULT ' || cast(p_size as string) || chr(10)
  || '  tags: String[]' || chr(10)
  || '  CONSTRAINT size > ' || cast(p_size % 5 as string) || chr(10)
  || 'END TYPE Part' || cast(p_partkey as string) || ' [id=' || {_numbered('t', 'p_partkey')} || ']' || chr(10)
  || case when p_partkey % 8 = 0 then
       chr(10) || 'PATCH FUNCTION make_' || replace(p_name, ' ', '_') || ' [id=' || {_numbered('f', 'p_partkey')} || ']' || chr(10)
       || '  INTENT "check ' || p_brand || '"' || chr(10)
       || '  INSERT PRECONDITION brand_known' || chr(10)
       || 'END PATCH FUNCTION make_' || replace(p_name, ' ', '_') || ' [id=' || {_numbered('f', 'p_partkey')} || ']' || chr(10)
     else '' end as source
from part
"""

# One project manifest (JSON) per part; some are fenced, broken or lack the modules list.
VIEWS["manifests"] = f"""
select p_partkey,
  case when p_partkey % 13 = 0 then '```json' || chr(10) else '' end
  || case when p_partkey % 17 = 0 then '{{"project": "' || p_name || '", "parts": []}}'
          when p_partkey % 19 = 0 then '{{"project": "' || p_name || '", "modules": {{}}}}'
          when p_partkey % 23 = 0 then '{{"project": ' || p_name
          else '{{"project": "' || p_name || '", "description": "' || p_type || '", "modules": [{{"id": "' || {_numbered('m', 'p_partkey')}
               || '", "name": "' || p_name || '", "target": "src/a.py", "profile": "sql_postgres", "namespace": "app.' || p_brand
               || '", "requires": ["m0000", "m0001"], "functions": [{{"id": "' || {_numbered('f', 'p_partkey')}
               || '", "name": "make", "description": "size ' || cast(p_size as string) || '"}}], "types": [{{"id": "' || {_numbered('t', 'p_partkey')}
               || '", "name": "Part", "description": "' || p_type || '"}}, {{"id": "x' || cast(p_partkey as string) || '", "name": "Extra"}}]}}]'
               || ', "dependency_graph": {{"' || {_numbered('m', 'p_partkey')} || '": ["m0000", "m0001"]}}}}'
     end
  || case when p_partkey % 13 = 0 then chr(10) || '```' else '' end as manifest
from part
"""


def with_views(query: str, *views: str) -> str:
    """A check query in front of which the named derived views are defined."""
    heads = ", ".join(f"{name} as ({VIEWS[name]})" for name in views)
    body = query.strip()
    for opening in ("with recursive ", "with "):
        if body.lower().startswith(opening):
            return f"{opening}{heads}, {body[len(opening):]}"
    return f"with {heads} {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Views that make a long text of a short row, and rows of their table for a task. Files are cut by their bytes, so
#: without this a few small tasks would build and search all texts.
LONG_TEXTS, SPREAD = ("sources", "manifests"), 8192


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt to one task for each SPREAD of them."""
    tasks = -(-rows.count() // SPREAD)
    return rows.repartition(tasks) if tasks > 1 else rows


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame. Tables are bound as arguments, so no temp view remains."""
    query = VIEWS[name].replace("{", "{{").replace("}", "}}")
    used = [t for t in TABLES if f"from {t}" in query]
    for t in used:
        query = query.replace(f"from {t}", f"from {{{t}}}")
    bound = {t: table(spark, sf_dir, t) for t in used}
    if name in LONG_TEXTS:
        bound = {t: spread(rows) for t, rows in bound.items()}
    return spark.sql(query, **bound)


def compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compiled rows with list columns, as validate() takes them."""
    from pyspark.sql import functions as F

    df = view(spark, sf_dir, "compiled")
    return df.withColumns(
        {
            "preconditions": F.split("pre_text", ";"),
            "postconditions": F.split("post_text", ";"),
            "mutates": F.split("mutates_text", ";"),
            "emits": F.split("emits_text", ";"),
        }
    )
