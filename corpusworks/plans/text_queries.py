"""Cleaning, extraction and rendering over whole documents and source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusworks import fixed
from corpusworks.functions import text as T
from corpusworks.operators import extract as X
from corpusworks.operators import rendering as R
from corpusworks.plans.inputs import compiled, table, view
from corpusworks.plans.registry import register

# DuckDB side of the shared text rules.
CHARS = "'" + T.SPACE_CHARS + "'"
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def strip_sql(col: str) -> str:
    return f"trim({col}, {CHARS})"


def fenced_sql(col: str) -> str:
    opened = f"regexp_replace({strip_sql(col)}, '^```[a-zA-Z]*\n?', '')"
    return strip_sql(f"regexp_replace({strip_sql(opened)}, '\n?```$', '')")


def digest(col: Column, *keys: str) -> list[Column]:
    """Long texts are compared by hash and length."""
    return [*[F.col(k) for k in keys], F.md5(col).alias("digest"), F.length(col).cast("bigint").alias("n")]


def digest_sql(expr: str, source: str, key: str = "doc_id") -> str:
    return f"select {key}, md5(t) as digest, length(t) as n from (select {key}, {expr} as t from {source}) x"


def extract_sql(col: str) -> str:
    """First keyword found in priority order, by position in the fence-free text."""
    t = fenced_sql(col)
    arms = " ".join(f"when strpos(t0, '{k}') > 0 then {strip_sql(f'''substr(t0, strpos(t0, '{k}'))''')}" for k in fixed.BLOCK_KEYWORDS)
    return f"(select case {arms} else t0 end from (select {t} as t0) y)"


@register("strip_fences", digest_sql(fenced_sql("raw_code"), "compiled"), ["compiled"])
def strip_fences(spark, sf) -> DataFrame:
    return view(spark, sf, "compiled").select(*digest(T.strip_fences(F.col("raw_code")), "doc_id"))


@register(
    "strip_fences_all",
    digest_sql(
        strip_sql(
            rf"regexp_replace(regexp_replace(raw_code || chr(10) || raw_code, '(?m)^```[a-z]*{WS}*', '', 'g'), '(?m)```{WS}*$', '', 'g')"
        ),
        "compiled",
    ),
    ["compiled"],
)
def strip_fences_all(spark, sf) -> DataFrame:
    twice = F.concat_ws("\n", "raw_code", "raw_code")
    return view(spark, sf, "compiled").select(*digest(T.strip_fences_all(twice), "doc_id"))


PROSE = "'Here is the block you asked for.' || chr(10) || intl_block"


@register("extract_block", digest_sql(extract_sql(PROSE), "compiled"), ["compiled"])
def extract_block(spark, sf) -> DataFrame:
    prose = F.concat(F.lit("Here is the block you asked for.\n"), "intl_block")
    return view(spark, sf, "compiled").select(*digest(T.extract_block(prose), "doc_id"))


BATCH = "intl_block || chr(10) || '---' || chr(10) || text || chr(10) || '---' || chr(10) || 'Next: ' || intl_block"


@register(
    "split_batch",
    f"""
    with chunks as (select doc_id, unnest(string_split({BATCH}, '---')) as c,
                           generate_subscripts(string_split({BATCH}, '---'), 1) as i from compiled),
    kept as (select doc_id, {strip_sql('c')} as c, row_number() over (partition by doc_id order by i) - 1 as pos
             from chunks where {strip_sql('c')} <> ''),
    cut as (select doc_id, pos, {extract_sql('c')} as t from kept)
    select doc_id, pos, md5(t) as digest from cut
    where regexp_matches(t, 'FUNCTION |PIPELINE |PATCH |MODULE ') and regexp_matches(t, 'INTENT')
      and regexp_matches(t, 'END (FUNCTION|PIPELINE|PATCH|MODULE)')
    """,
    ["compiled"],
)
def split_batch(spark, sf) -> DataFrame:
    answers = view(spark, sf, "compiled").select(
        "doc_id",
        F.concat(
            "intl_block", F.lit("\n---\n"), "text", F.lit("\n---\nNext: "), "intl_block"
        ).alias("answer"),
    )
    rows = X.split_batches(answers, "answer")
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.md5("block").alias("digest"))


def wrapped_sql(code: str) -> str:
    opener = "case when profile like 'sql%' then '-- ' when profile like 'html%' then '<!-- ' when profile like 'css%' then '/* ' else '# ' end"
    closer = "case when profile like 'html%' then ' -->' when profile like 'css%' then ' */' else '' end"
    return (
        f"{opener} || '═══ INTL:BEGIN [id=' || block_id || '] ' || name || ' ═══' || {closer} || chr(10) || rtrim({code}, {CHARS}) || chr(10) || "
        f"{opener} || '═══ INTL:END   [id=' || block_id || '] ' || name || ' ═══' || {closer}"
    )


@register("wrap_sentinels", digest_sql(wrapped_sql("text"), "compiled"), ["compiled"])
def wrap_sentinels(spark, sf) -> DataFrame:
    wrapped = T.wrap_sentinels(F.col("text"), F.col("block_id"), F.col("name"), F.col("profile"))
    return view(spark, sf, "compiled").select(*digest(wrapped, "doc_id"))


@register(
    "ensure_sentinels",
    digest_sql(
        f"case when strpos(c, 'INTL:BEGIN') > 0 then c else {wrapped_sql('c')} end",
        "(select *, case when lang = 'fr' then text else compiled_code end as c from compiled)",
    ),
    ["compiled"],
)
def ensure_sentinels(spark, sf) -> DataFrame:
    code = F.when(F.col("lang") == "fr", F.col("text")).otherwise(F.col("compiled_code"))
    done = T.ensure_sentinels(F.col("c"), F.col("block_id"), F.col("name"), F.col("profile"))
    return view(spark, sf, "compiled").withColumn("c", code).select(*digest(done, "doc_id"))


BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


@register(
    "strip_sentinels",
    rf"""
    with lines as (select doc_id, unnest(regexp_split_to_array(compiled_code, '{BREAK}')) as line,
                          generate_subscripts(regexp_split_to_array(compiled_code, '{BREAK}'), 1) as i,
                          len(regexp_split_to_array(compiled_code, '{BREAK}')) as last
                   from compiled),
    kept as (select doc_id, string_agg(line, chr(10) order by i) as t from lines
             where not regexp_matches(line, '(?i)INTL:(BEGIN|END)') and not (i = last and line = '') group by doc_id)
    select doc_id, md5(coalesce(t, '')) as digest, length(coalesce(t, '')) as n from compiled left join kept using (doc_id)
    """,
    ["compiled"],
)
def strip_sentinels(spark, sf) -> DataFrame:
    return view(spark, sf, "compiled").select(*digest(T.strip_sentinels(F.col("compiled_code")), "doc_id"))


@register(
    "sentinel_regions",
    rf"""
    with lines as (select doc_id, unnest(regexp_split_to_array(c, '{BREAK}')) as line,
                          generate_subscripts(regexp_split_to_array(c, '{BREAK}'), 1) as i
                   from (select doc_id, compiled_code || chr(10) || chr(10) || compiled_code as c from compiled)),
    marks as (select doc_id, i, upper(regexp_extract(line, '(?i)INTL:(BEGIN|END){WS}+\[id=([^\]]*)\]', 1)) as kind,
                     regexp_extract(line, '(?i)INTL:(BEGIN|END){WS}+\[id=([^\]]*)\]', 2) as id from lines
              where regexp_matches(line, '(?i)INTL:(BEGIN|END){WS}+\[id=([^\]]*)\]')),
    paired as (select *, lead(kind) over w as next_kind, lead(id) over w as next_id, lead(i) over w as next_i
               from marks window w as (partition by doc_id order by i)),
    regions as (select doc_id, id, i as begin_line, next_i as end_line from paired
                where kind = 'BEGIN' and next_kind = 'END' and id = next_id)
    select r.doc_id, r.id, 'task_' || r.doc_id::varchar as name, r.begin_line, r.end_line,
           md5(coalesce(string_agg(l.line, chr(10) order by l.i), '')) as digest
    from regions r left join lines l on l.doc_id = r.doc_id and l.i > r.begin_line and l.i < r.end_line
    group by all
    """,
    ["compiled"],
)
def sentinel_regions(spark, sf) -> DataFrame:
    files = view(spark, sf, "compiled").select(
        "doc_id", F.concat_ws("\n\n", "compiled_code", "compiled_code").alias("compiled_code")
    )
    rows = X.sentinel_regions(files)
    return rows.select(
        "doc_id", "id", "name", F.col("begin_line").cast("bigint").alias("begin_line"),
        F.col("end_line").cast("bigint").alias("end_line"), F.md5("body").alias("digest"),
    )


DISPLAY = "array_to_string(list_transform(string_split(profile, '_'), lambda p: upper(p[1]) || lower(p[2:])), ' ')"


@register(
    "adapter_display",
    f"select profile, {DISPLAY} as display, count(*) as docs from compiled group by all",
    ["compiled"],
)
def adapter_display(spark, sf) -> DataFrame:
    named = view(spark, sf, "compiled").select("profile", T.adapter_display(F.col("profile")).alias("display"))
    return named.groupBy("profile", "display").agg(F.count("*").alias("docs"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@register(
    "system_prompt",
    f"""
    select doc_id, md5(case doc_id % 4
      when 0 then replace({_quoted(fixed.COMPILER_PROMPT)}, '%1$s', {DISPLAY})
      when 1 then replace({_quoted(fixed.PATCH_PROMPT)}, '%1$s', {DISPLAY})
      when 2 then replace({_quoted(fixed.ESCALATION_PROMPT)}, '%1$s', {DISPLAY})
      else replace({_quoted(fixed.WRITER_PROMPT)}, '%s',
           case when length(text) > 6000 then substr(text, 1, 6000) || {_quoted(fixed.TRUNCATED)} else text end) end) as digest
    from compiled
    """,
    ["compiled"],
)
def system_prompt(spark, sf) -> DataFrame:
    modes = F.array(*[F.lit(m) for m in ("compiler", "patch", "escalation", "writer")])
    mode = F.element_at(modes, (F.col("doc_id") % 4 + 1).cast("int"))
    prompt = T.system_prompt(F.col("profile"), mode, F.col("text"))
    return view(spark, sf, "compiled").select("doc_id", F.md5(prompt).alias("digest"))


@register(
    "truncate_text",
    "select doc_id, length(text) > 6000 as cut, md5(case when length(text) > 6000 then substr(text, 1, 6000) || "
    + _quoted(fixed.TRUNCATED) + " else text end) as digest from documents",
)
def truncate_text(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select(
        "doc_id", (F.length("text") > fixed.SPEC_CHARS).alias("cut"), F.md5(T.truncate_text(F.col("text"))).alias("digest")
    )


@register(
    "training_text",
    digest_sql("concat(system, chr(10), prompt, chr(10), completion, '</s>')", "pairs", "idx"),
    ["pairs"],
)
def training_text(spark, sf) -> DataFrame:
    return R.with_training_text(view(spark, sf, "pairs"), "</s>").select(*digest(F.col("text"), "idx"))


TOKENS = f"case when {strip_sql('t')} = '' then 0 else len(regexp_split_to_array({strip_sql('t')}, '{WS}+')) end"


@register(
    "length_gate",
    f"""select idx, {TOKENS} as tokens, {TOKENS} <= 2048 as fits
        from (select idx, concat(system, chr(10), prompt, chr(10), completion, '</s>') as t from pairs) x""",
    ["pairs"],
)
def length_gate(spark, sf) -> DataFrame:
    gated = R.length_gate(R.with_training_text(view(spark, sf, "pairs"), "</s>"))
    return gated.select("idx", F.col("tokens").cast("bigint").alias("tokens"), "fits")


#: A public vocabulary on every machine; a cluster names a shared file.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@register("token_lengths", None, ["pairs"])
def token_lengths(spark, sf) -> DataFrame:
    """Tokens of the training texts by a byte-pair vocabulary, which SQL cannot count; tests compare with the encoder."""
    gated = R.length_gate(R.with_training_text(view(spark, sf, "pairs"), "</s>"), tokenizer=TOKENIZER)
    return gated.select("idx", "tokens", "fits")


# --- rendering ------------------------------------------------------------------------------------
def _rendered(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("metadata.idx").cast("bigint").alias("idx"), F.col("metadata.category").alias("category"),
        F.col("metadata.adapter").alias("adapter"), F.md5("system").alias("system_digest"),
        F.md5("prompt").alias("prompt_digest"), F.md5("completion").alias("completion_digest"),
    )


def _blocks(spark, sf) -> DataFrame:
    docs = view(spark, sf, "compiled")
    flaws = F.array(*[F.lit(x) for x in fixed.FLAWS])
    return docs.select(
        F.col("intl_block").alias("block"), F.col("raw_code").alias("completion"), F.col("raw_code").alias("base_code"),
        F.col("body").alias("broken_code"), F.concat(F.lit("PATCH "), "intl_block").alias("patch"),
        F.element_at(flaws, (F.col("doc_id") % 5 + 1).cast("int")).alias("flaw"),
        F.col("profile").alias("adapter"), F.lit("QUERY").alias("construct"), F.col("doc_id").alias("idx"),
    )


def _render_sql(category: str, system: str, prompt: str) -> str:
    return f"""select doc_id as idx, '{category}' as category, profile as adapter,
      md5(replace({_quoted(system)}, '%1$s', {DISPLAY})) as system_digest, md5({prompt}) as prompt_digest,
      md5({fenced_sql('raw_code')}) as completion_digest from compiled"""


@register("render_pair_a", _render_sql("A", fixed.COMPILER_PROMPT, "intl_block"), ["compiled"])
def render_pair_a(spark, sf) -> DataFrame:
    return _rendered(R.render_pair_a(_blocks(spark, sf)))


@register(
    "render_pair_b",
    _render_sql("B", fixed.PATCH_PROMPT, fenced_sql("raw_code") + " || chr(10) || chr(10) || 'PATCH ' || intl_block"),
    ["compiled"],
)
def render_pair_b(spark, sf) -> DataFrame:
    return _rendered(R.render_pair_b(_blocks(spark, sf)))


FLAW_LIST = "[" + ", ".join(_quoted(x) for x in fixed.FLAWS) + "]"


@register(
    "render_pair_c",
    _render_sql(
        "C", fixed.ESCALATION_PROMPT,
        "concat(intl_block, chr(10), chr(10), '# PREVIOUS ATTEMPT (failed):', chr(10), body, chr(10), chr(10), "
        f"'# FAILING CHECK: ', ({FLAW_LIST})[doc_id % 5 + 1])",
    ),
    ["compiled"],
)
def render_pair_c(spark, sf) -> DataFrame:
    return _rendered(R.render_pair_c(_blocks(spark, sf)))


def failed_rows(spark, sf) -> DataFrame:
    """Compiled rows with a list of failed checks made from their keys."""
    docs = view(spark, sf, "compiled")
    check = lambda name, message, detail: F.struct(
        F.lit(name).alias("name"), F.lit(message).alias("message"), F.lit(detail).alias("detail")
    )
    failed = F.array_compact(
        F.array(
            F.when(F.col("doc_id") % 7 == 0, check("T2-Sentinel", "no end", "expected an end")),
            F.when(F.col("doc_id") % 13 == 0, check("T7-NoPlaceholders", "TODO found", "")),
        )
    )
    return docs.select(
        "doc_id", "block_id", F.col("name").alias("block_name"), F.col("profile").alias("adapter"),
        F.substring_index("profile", "_", 1).alias("language"), "intl_block", "compiled_code",
        F.col("text").alias("corrected"), F.col("attempt").alias("retry_count"), failed.alias("failed"),
    )


@register(
    "render_correction",
    f"""
    with f as (select *, split_part(profile, '_', 1) as language,
        list_filter([case when doc_id % 7 = 0 then 'T2-Sentinel: no end' end, case when doc_id % 13 = 0 then 'T7-NoPlaceholders: TODO found' end], lambda x: x is not null) as lines
      from compiled)
    select doc_id, md5(replace(replace({_quoted(fixed.CORRECTION_PROMPT)}, '%1$s', language), '%2$s', profile)) as system_digest,
      md5(concat({strip_sql('intl_block')}, chr(10), chr(10), '# PREVIOUS ATTEMPT (failed):', chr(10), {strip_sql('compiled_code')}, chr(10), chr(10),
          '# FAILING CHECKS: ', array_to_string(lines, '; '))) as prompt_digest,
      len(lines) as failing, '2024-02-01T00:00:00.000000+00:00' as at
    from f
    """,
    ["compiled"],
)
def render_correction(spark, sf) -> DataFrame:
    rows = failed_rows(spark, sf)
    pairs = R.render_correction(rows, F.expr("timestamp_ntz'2024-02-01 00:00:00'"))
    number = F.regexp_extract("metadata.block_id", r"f0*(\d+)$", 1).cast("bigint")
    return pairs.select(
        number.alias("doc_id"), F.md5("system").alias("system_digest"), F.md5("prompt").alias("prompt_digest"),
        F.size("metadata.failing_checks").cast("bigint").alias("failing"), F.col("metadata.timestamp").alias("at"),
    )


@register(
    "render_escalation",
    f"""
    with f as (select *, split_part(profile, '_', 1) as language,
        concat_ws(chr(10), case when doc_id % 7 = 0 then '  [T2-Sentinel] no end — expected an end' end,
                  case when doc_id % 13 = 0 then '  [T7-NoPlaceholders] TODO found — ' end) as lines from compiled)
    select doc_id, md5('=== ESCALATION PACKAGE ===' || chr(10) || chr(10) || 'ADAPTER:      ' || profile || chr(10)
      || 'LANGUAGE:     ' || language || chr(10) || 'BLOCK ID:     ' || block_id || chr(10) || 'RETRY COUNT:  ' || attempt::varchar
      || chr(10) || chr(10) || '--- ORIGINAL INTL BLOCK (authoritative specification) ---' || chr(10) || {strip_sql('intl_block')}
      || chr(10) || chr(10) || '--- FAILED COMPILED OUTPUT ---' || chr(10) || {strip_sql('compiled_code')} || chr(10) || chr(10)
      || '--- FAILING VALIDATION CHECKS ---' || chr(10) || case when {strip_sql('lines')} = '' then '(none listed)' else {strip_sql('lines')} end
      || chr(10) || '==========================' || chr(10)) as digest
    from f
    """,
    ["compiled"],
)
def render_escalation(spark, sf) -> DataFrame:
    return R.render_escalation(failed_rows(spark, sf)).select("doc_id", F.md5("package_text").alias("digest"))


@register(
    "render_request",
    f"""
    with f as (select *, concat_ws(chr(10), case when doc_id % 7 = 0 then '- T2-Sentinel: no end (expected an end)' end,
                  case when doc_id % 13 = 0 then '- T7-NoPlaceholders: TODO found' end) as lines from compiled)
    select doc_id, md5(concat({_quoted(fixed.REQUEST_FORMAT.split('%s')[0])}, intl_block, {_quoted(fixed.REQUEST_FORMAT.split('%s')[1])},
      compiled_code, {_quoted(fixed.REQUEST_FORMAT.split('%s')[2])}, lines, {_quoted(fixed.REQUEST_FORMAT.split('%s')[3])})) as digest
    from f
    """,
    ["compiled"],
)
def render_request(spark, sf) -> DataFrame:
    return R.render_request(failed_rows(spark, sf)).select("doc_id", F.md5("request_text").alias("digest"))


@register(
    "project_fields",
    "select l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) * (1 + l_tax) as charge, "
    "strftime(l_shipdate, '%Y-%m-%d') as ship_day from lineitem",
)
def project_fields(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    dropped = [
        "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ]
    return R.project_fields(lines, {"charge": charge, "ship_day": F.date_format("l_shipdate", "yyyy-MM-dd")}, dropped)


# --- source files -----------------------------------------------------------------------------------
ID = "[a-zA-Z_][a-zA-Z0-9_]*"


@register(
    "module_fields",
    rf"""
    with l as (select p_partkey, unnest(string_split(source, chr(10))) as line from sources)
    select p_partkey,
      max(case when line like 'MODULE %' then regexp_extract(line, '\[id=({ID})\]', 1) end) as module_id,
      max(case when line like 'MODULE %' then split_part(line, ' ', 2) end) as name,
      max(case when line like 'TARGET %' then split_part(line, '"', 2) end) as target,
      max(case when line like 'PROFILE %' then trim(substr(line, 8)) end) as profile,
      max(case when line like 'NAMESPACE %' then split_part(line, '"', 2) end) as namespace,
      coalesce(max(case when line like 'REQUIRES %' then trim(substr(line, 9)) end), '') as requires,
      max(case when line like 'VERSION %' then split_part(line, '"', 2) end) as version
    from l group by p_partkey
    """,
    ["sources"],
)
def module_fields(spark, sf) -> DataFrame:
    rows = X.module_fields(view(spark, sf, "sources"))
    return rows.select(
        "p_partkey", "module_id", "name", "target", "profile", "namespace",
        F.array_join("requires", " ").alias("requires"), "version",
    )


# Block rows by line scan: a header line opens a block, the next END of a block kind closes it.
BLOCK_CTE = rf"""
    l as (select p_partkey, unnest(string_split(source, chr(10))) as line, generate_subscripts(string_split(source, chr(10)), 1) as i from sources),
    heads as (select p_partkey, i, split_part(trim(line), ' ', 1) as kind,
                     regexp_extract(line, '({ID}) \[id=', 1) as name, regexp_extract(line, '\[id=({ID})\]', 1) as id,
                     row_number() over (partition by p_partkey order by i) - 1 as pos
              from l where regexp_matches(line, '^(FUNCTION|PIPELINE|TYPE|PATCH) ')),
    ends as (select h.*, (select min(e.i) from l e where e.p_partkey = h.p_partkey and e.i > h.i
                          and regexp_matches(e.line, '^END (FUNCTION|PIPELINE|TYPE|PATCH) ')) as last from heads h),
    bl as (select e.p_partkey, e.pos, e.kind, e.name, e.id, l.i - e.i as n, l.line from ends e join l on l.p_partkey = e.p_partkey and l.i between e.i and e.last)
"""


@register(
    "block_headers",
    f"with {BLOCK_CTE} select p_partkey, pos, kind, name, id from heads",
    ["sources"],
)
def block_headers(spark, sf) -> DataFrame:
    rows = X.block_headers(view(spark, sf, "sources").select("p_partkey", "source"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@register(
    "blocks_of_source",
    f"with {BLOCK_CTE} select p_partkey, pos, kind, id, md5(string_agg(line, chr(10) order by n)) as digest from bl group by all",
    ["sources"],
)
def blocks_of_source(spark, sf) -> DataFrame:
    rows = X.blocks_of(view(spark, sf, "sources").select("p_partkey", "source"))
    return rows.select("p_partkey", F.col("pos").cast("bigint").alias("pos"), "kind", "id", F.md5("block").alias("digest"))


def _list_sql(word: str, cut: int) -> str:
    return f"coalesce(string_agg(trim(substr(trim(line), {cut})), '; ' order by n) filter (where trim(line) like '{word} %'), '')"


BLOCK_FIELDS = f"""
    with {BLOCK_CTE}
    select p_partkey, pos, kind, id,
      max(split_part(line, '"', 2)) filter (where trim(line) like 'INTENT %') as intent,
      {_list_sql('PRECONDITION', 13)} as preconditions, {_list_sql('POSTCONDITION', 14)} as postconditions,
      {_list_sql('READS', 6)} as reads, {_list_sql('MUTATES', 8)} as mutates, {_list_sql('EMITS', 6)} as emits,
      coalesce(bool_or(trim(line) = 'OBSERVABLE'), false) as observable,
      coalesce(max(try_cast(trim(substr(trim(line), 11)) as double)) filter (where trim(line) like 'CONFIDENCE %'), 1.0) as confidence,
      max(trim(substr(trim(line), 8))) filter (where trim(line) like 'TIMEOUT %') as timeout
    from bl group by p_partkey, pos, kind, id
"""


def field_rows(spark, sf) -> DataFrame:
    return X.block_fields(X.blocks_of(view(spark, sf, "sources").select("p_partkey", "source")))


@register("block_fields", BLOCK_FIELDS, ["sources"])
def block_fields(spark, sf) -> DataFrame:
    joined = lambda c: F.array_join(c, "; ").alias(c)
    return field_rows(spark, sf).select(
        "p_partkey", F.col("pos").cast("bigint").alias("pos"), "kind", "id", "intent", joined("preconditions"),
        joined("postconditions"), joined("reads"), joined("mutates"), joined("emits"), "observable", "confidence", "timeout",
    )


@register(
    "type_fields",
    rf"""
    with {BLOCK_CTE}, t as (select p_partkey, id, n as line_no, regexp_replace(trim(line), '^FIELD ', '') as f from bl where kind = 'TYPE')
    select p_partkey, id, line_no,
      case when f not like 'CONSTRAINT %' then trim(split_part(f, ':', 1)) end as field,
      case when f not like 'CONSTRAINT %' then split_part(trim(substr(f, strpos(f, ':') + 1)), ' ', 1) end as type,
      f like '% NOT NULL%' as not_null,
      case when strpos(f, ' DEFAULT ') > 0 then substr(f, strpos(f, ' DEFAULT ') + 9) end as default_value,
      case when f like 'CONSTRAINT %' then substr(f, 12) end as "constraint"
    from t where f like '%:%' or f like 'CONSTRAINT %'
    """,
    ["sources"],
)
def type_fields(spark, sf) -> DataFrame:
    rows = X.type_fields(X.blocks_of(view(spark, sf, "sources").select("p_partkey", "source")))
    return rows.select(
        "p_partkey", "id", F.col("line_no").cast("bigint").alias("line_no"), "field", "type", "not_null", "default_value", "constraint",
    )


def _uses(name: str, like: str) -> str:
    return f"select p_partkey, pos, '{name}' as construct from bl where {like}"


@register(
    "construct_usage",
    f"""
    with {BLOCK_CTE}, u as (
      {_uses('QUERY', "line like '% = QUERY %'")} union all {_uses('PERSIST INSERT', "line like '%PERSIST % INSERT %'")}
      union all {_uses('CALL', "line like '%CALL %'")} union all {_uses('IF', "trim(line) like 'IF %'")}
      union all {_uses('FAIL', "line like '%FAIL %(%'")} union all {_uses('RETURN', "line like '%RETURN %'")}
      union all {_uses('SEQUENCE', "trim(line) = 'SEQUENCE'")} union all {_uses('LOOP', "trim(line) like 'LOOP %'")}
      union all {_uses('EMIT', "trim(line) like 'EMIT %(%'")} union all {_uses('AGGREGATE', "line like '% = AGGREGATE %'")})
    select p_partkey, pos, construct, count(*) as uses from u group by all
    """,
    ["sources"],
)
def construct_usage(spark, sf) -> DataFrame:
    rows = X.construct_usage(X.blocks_of(view(spark, sf, "sources").select("p_partkey", "source")))
    return rows.select("p_partkey", F.col("pos").cast("bigint").alias("pos"), "construct", F.col("uses").cast("bigint").alias("uses"))


# --- manifests ---------------------------------------------------------------------------------------
CLEAN = "trim(replace(replace(manifest, '```json' || chr(10), ''), chr(10) || '```', ''))"
GOOD = f"(select p_partkey, {CLEAN} as j from manifests where json_valid({CLEAN}) and json_type({CLEAN}, '$.modules') = 'ARRAY')"


@register(
    "manifest_modules",
    f"""
    with m as (select p_partkey, json_extract_string(j, '$.project') as project, unnest(json_extract(j, '$.modules[*]')) as x from {GOOD} g)
    select p_partkey, project, x->>'$.id' as id, x->>'$.name' as name, x->>'$.profile' as profile, x->>'$.namespace' as namespace,
      array_to_string(list_transform(json_extract(x, '$.requires[*]'), lambda r: r->>'$'), ' ') as requires from m
    """,
    ["manifests"],
)
def manifest_modules(spark, sf) -> DataFrame:
    rows = X.manifest_modules(X.read_manifests(view(spark, sf, "manifests")))
    return rows.select("p_partkey", "project", "id", "name", "profile", "namespace", F.array_join("requires", " ").alias("requires"))


@register(
    "manifest_members",
    f"""
    with m as (select p_partkey, unnest(json_extract(j, '$.modules[*]')) as x from {GOOD} g),
    f as (select p_partkey, x->>'$.id' as module_id, 'function' as kind, unnest(json_extract(x, '$.functions[*]')) as y from m
          union all select p_partkey, x->>'$.id', 'type', unnest(json_extract(x, '$.types[*]')) from m)
    select p_partkey, module_id, kind, y->>'$.id' as id, y->>'$.name' as name, y->>'$.description' as description from f
    """,
    ["manifests"],
)
def manifest_members(spark, sf) -> DataFrame:
    return X.manifest_members(X.read_manifests(view(spark, sf, "manifests")))


@register(
    "manifest_edges",
    f"""
    with k as (select p_partkey, json_extract(j, '$.dependency_graph') as d, unnest(json_keys(j, '$.dependency_graph')) as from_module from {GOOD} g)
    select p_partkey, from_module, unnest(cast(json_extract(d, '$.' || from_module) as varchar[])) as to_module from k
    """,
    ["manifests"],
)
def manifest_edges(spark, sf) -> DataFrame:
    return X.manifest_edges(X.read_manifests(view(spark, sf, "manifests")))


# --- patches -------------------------------------------------------------------------------------------
# Patches per labelled document: two kinds, anchored at text that many documents hold.
PATCHES = """
    select doc_id, cast(1 as int) as seq, case when quality = 1 then 'insert' else 'replace' end as action,
      case when toxic = 1 then 'before' when quality = 1 then 'after' else 'at' end as position, 'on' as anchor, 'patched line ' || cast(doc_id as string) as body from labels
    union all
    select doc_id, cast(2 as int), case when quality = 1 then 'remove' else 'insert' end, case when quality = 1 then 'at' else 'after' end,
      'e ', 'second line' from labels
"""


@register(
    "line_patches",
    f"""
    with p as ({PATCHES}),
    l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
    hits as (select p.*, (select min(i) from l where l.doc_id = p.doc_id and contains(l.line, p.anchor)) as spot from p),
    live as (select * from hits where spot is not null),
    pieces as (
      select doc_id, spot as i, 0 as part, seq, body as line from live where action = 'insert' and position = 'before'
      union all select doc_id, spot, 2, seq, body from live where action = 'insert' and position <> 'before'
      union all select doc_id, spot, 1, seq, body from live where action = 'replace'
      union all select l.doc_id, l.i, 1, 0, l.line from l where not exists (select 1 from live where live.doc_id = l.doc_id and live.spot = l.i and action in ('replace', 'remove')))
    select doc_id, md5(coalesce(any_value(t), '')) as digest, count(live.seq) as applied
    from documents left join (select doc_id, string_agg(line, chr(10) order by i, part, seq) as t from pieces group by doc_id) x using (doc_id)
    left join live using (doc_id) group by doc_id
    """,
)
def line_patches(spark, sf) -> DataFrame:
    patches = spark.sql(PATCHES.replace("from labels", "from {labels}"), labels=table(spark, sf, "labels"))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = X.apply_line_patches(docs, patches, "doc_id", "text")
    return rows.select("doc_id", F.md5("patched").alias("digest"), F.col("applied").cast("bigint").alias("applied"))


@register(
    "patched_preconditions",
    f"""
    with {BLOCK_CTE},
    pre as (select id, trim(substr(trim(line), 13)) as precondition from bl where kind = 'FUNCTION' and trim(line) like 'PRECONDITION %'),
    added as (select id, 'brand_known' as precondition from bl where kind = 'PATCH' and trim(line) = 'INSERT PRECONDITION brand_known')
    select distinct id, precondition from (select * from pre union all select * from added) x
    where not (precondition = 'name.length > 0' and id in (select id from added))
    """,
    ["sources"],
)
def patched_preconditions(spark, sf) -> DataFrame:
    rows = field_rows(spark, sf)
    patches = rows.where("kind = 'PATCH'")
    named = F.regexp_extract("block", r"(?m)^\s*INSERT PRECONDITION (\w+)\s*$", 1)
    inserted = patches.select("id", F.lit("insert").alias("action"), named.alias("precondition")).where("precondition <> ''")
    removed = patches.select("id", F.lit("remove").alias("action"), F.lit("name.length > 0").alias("precondition"))
    return X.patched_preconditions(rows.where("kind = 'FUNCTION'"), inserted.unionByName(removed))
