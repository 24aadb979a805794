"""Gates, rule checks and the reports built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusworks import fixed
from corpusworks.functions import checks as C
from corpusworks.functions import text as T
from corpusworks.operators import corpus as G
from corpusworks.operators import routing as J
from corpusworks.operators import validate as V
from corpusworks.plans.inputs import compiled, table, view
from corpusworks.plans.registry import register
from corpusworks.plans.text_queries import CLEAN, WS, X, field_rows, strip_sql

RULES = fixed.CHECK_NAMES[1:]
W = r"[\p{L}\p{N}_]"


def word_sql(words: str, flags: str = "", col: str = "compiled_code") -> str:
    return rf"regexp_matches({col}, '{flags}(^|[^\p{{L}}\p{{N}}_])({words})($|[^\p{{L}}\p{{N}}_])')"


def rules_checked(spark, sf) -> DataFrame:
    """The six checks that need no language parser."""
    return V.validate(compiled(spark, sf), RULES)


def _unmapped(col: str, stop: list[str], empty_fails: bool) -> str:
    """Rows (doc_id, n, missing): conditions and how many name nothing found in the code, by
    exploding names and testing them against the set of words."""
    stops = ", ".join(f"'{w}'" for w in stop)
    keep = "not coalesce(ok, false)" if empty_fails else "not coalesce(ok, true)"
    return rf"""
      select p.doc_id, count(*) as n, count(*) filter (where {keep}) as missing
      from (select doc_id, unnest(string_split({col}, ';')) as cond from compiled where {col} is not null) p
      left join (
        select x.doc_id, x.cond, bool_or(list_contains(w.words, x.name)) as ok
        from (select distinct doc_id, cond, unnest(regexp_extract_all(cond, '[a-zA-Z_]{W}*')) as name
              from (select doc_id, unnest(string_split({col}, ';')) as cond from compiled where {col} is not null) y) x
        join words w using (doc_id) where x.name not in ({stops}) group by all) f
      on f.doc_id = p.doc_id and f.cond = p.cond group by p.doc_id"""


RETURNS = word_sql("return|RETURN|Result|response")
WRITES = (
    f"({word_sql('INSERT|UPDATE|DELETE', '(?i)')} or "
    rf"regexp_matches(compiled_code, '(?i)(\.(save|create|update|delete|add|put|post|execute)|session\.commit|db\.commit)($|[^\p{{L}}\p{{N}}_])'))"
)
LOGS = (
    f"({word_sql('log|logger', '(?i)')} or regexp_matches(compiled_code, '(?i)(logging\\.|console\\.log|log\\.|@observable|@log)') or "
    rf"regexp_matches(compiled_code, '(?i)\.(info|debug|warning)($|[^\p{{L}}\p{{N}}_])'))"
)
EMITS = word_sql("emit|publish|dispatch|send", "(?i)")
LABELS = f"""concat_ws(', ',
    case when {word_sql('TODO', '(?i)')} then 'TODO' end, case when {word_sql('FIXME', '(?i)')} then 'FIXME' end,
    case when regexp_matches(compiled_code, '(?im)^{WS}*pass{WS}*$') then 'bare pass' end,
    case when regexp_matches(compiled_code, '(?i)(^|[^\\p{{L}}\\p{{N}}_])unimplemented!\\(\\)') then 'unimplemented!()' end,
    case when {word_sql('NotImplementedError', '(?i)')} then 'NotImplementedError' end,
    case when regexp_matches(compiled_code, '(?i)(^|[^\\p{{L}}\\p{{N}}_])throw new Error\\("not implemented"\\)') then 'throw not implemented' end,
    case when {word_sql('placeholder', '(?i)')} then 'placeholder' end)"""

# One row per compiled block with the outcome of the six rules.
JUDGED = rf"""
    words as (select doc_id, list_distinct(regexp_extract_all(compiled_code, '{W}+')) as words from compiled),
    pre as ({_unmapped('pre_text', fixed.GUARD_STOP_WORDS, True)}),
    post as ({_unmapped('post_text', fixed.RESULT_STOP_WORDS, False)}),
    judged as (select c.*,
      regexp_matches(compiled_code, '(?i)INTL:BEGIN{WS}+\[id=' || block_id || '\]') as has_begin,
      regexp_matches(compiled_code, '(?i)INTL:END{WS}+\[id=' || block_id || '\]') as has_end,
      pre.n as pre_n, coalesce(pre.missing, 0) as pre_missing, post.n as post_n, coalesce(post.missing, 0) as post_missing,
      {RETURNS} as has_return,
      concat_ws('; ',
        case when mutates_text is not null and not {WRITES} then 'MUTATES [''records_table''] declared but no write operation found' end,
        case when observable and not {LOGS} then 'OBSERVABLE declared but no logging call found' end,
        case when emits_text is not null and not {EMITS} then 'EMITS [''record_done''] declared but no event emit found' end) as issues,
      return_type is null or return_type = '' or list_contains(words, return_type) as type_ok,
      {LABELS} as labels
      from compiled c join words using (doc_id) left join pre using (doc_id) left join post using (doc_id)),
    outcome as (select *, has_begin and has_end as t2, pre_missing = 0 as t3,
      post_n is null or (has_return and post_missing = 0) as t4, issues = '' as t5, type_ok as t6, labels = '' as t7 from judged),
    final as (select *, t2 and t3 and t4 and t5 and t6 and t7 as passed from outcome)
"""


def check_query(name: str, message: str, detail: str):
    """A query that reports one check of every compiled row."""
    number = fixed.CHECK_NAMES.index(name) + 1
    sql = f"with {JUDGED} select doc_id, t{number} as passed, {message} as message, case when t{number} then '' else {detail} end as detail from final"

    def run(spark, sf) -> DataFrame:
        found = V.validate(compiled(spark, sf), [name])
        return found.select("doc_id", F.inline("checks")).drop("name")

    return sql, run


for _name, _key, _message, _detail in [
    (
        "T2-Sentinel", "check_sentinel",
        "case when t2 then 'BEGIN/END sentinels present' else 'Missing sentinels: ' || concat_ws(', ', "
        "case when not has_begin then 'INTL:BEGIN [id=' || block_id || ']' end, case when not has_end then 'INTL:END [id=' || block_id || ']' end) end",
        "'Expected sentinels for id=' || block_id",
    ),
    (
        "T3-Preconditions", "check_preconditions",
        "case when pre_n is null then 'No preconditions to check' when t3 then 'All ' || pre_n::varchar || ' precondition(s) mapped' "
        "else pre_missing::varchar || ' precondition(s) not mapped in output' end",
        "'Missing guards for: ' || case when doc_id % 6 = 1 then 'missing_' || doc_id::varchar || ' > 0' else '1 > 0' end",
    ),
    (
        "T4-Postconditions", "check_postconditions",
        "case when post_n is null then 'No postconditions to check' when not has_return then 'No return/result expression found in output' "
        "when t4 then 'All ' || post_n::varchar || ' postcondition(s) mapped' else post_missing::varchar || ' postcondition(s) not verified in output' end",
        "case when not has_return then 'Postconditions: ' || replace(post_text, ';', '; ') else 'Unverified: absent_' || doc_id::varchar || ' IS NOT NULL' end",
    ),
    ("T5-SideEffects", "check_side_effects", "case when t5 then 'All side effects accounted for' else issues end", "''"),
    (
        "T6-Types", "check_return_type",
        "case when return_type is null or return_type = '' then 'No TYPE declaration to check' when t6 then 'Return type ''' || return_type || ''' found in output' "
        "else 'Return type ''' || return_type || ''' not found in compiled output' end",
        "'Expected to find ''' || return_type || ''' in output'",
    ),
    (
        "T7-NoPlaceholders", "check_placeholders",
        "case when t7 then 'No placeholders found' else 'Placeholder(s) found: ' || labels end", "'Output contains incomplete code markers'",
    ),
]:
    _sql, _run = check_query(_name, _message, _detail)
    register(_key, _sql, ["compiled"])(_run)


# --- gates --------------------------------------------------------------------------------------------
BLOCK_REASON = f"""case when not regexp_matches({strip_sql('intl_block')}, 'FUNCTION |PIPELINE |PATCH |MODULE ') then 'missing FUNCTION/PIPELINE/PATCH block header'
    when strpos(intl_block, 'INTENT') = 0 then 'missing INTENT field'
    when not regexp_matches(intl_block, 'END (FUNCTION|PIPELINE|PATCH|MODULE)') then 'missing END marker' else 'ok' end"""
DONE = strip_sql("compiled_code")
COMPLETION_REASON = f"""case when strpos(compiled_code, 'INTL:BEGIN') = 0 then 'missing INTL:BEGIN sentinel'
    when strpos(compiled_code, 'INTL:END') = 0 then 'missing INTL:END sentinel'
    else coalesce((select 'contains stub/placeholder: ''' || s || '''' from (values (1, 'TODO'), (2, 'FIXME'), (3, 'pass  #'), (4, 'raise NotImplementedError'), (5, 'stub')) v(o, s)
                   where contains({DONE}, s) order by o limit 1), 'ok') end"""


@register("block_shape", f"select doc_id, {BLOCK_REASON} as reason from compiled", ["compiled"])
def block_shape(spark, sf) -> DataFrame:
    return view(spark, sf, "compiled").select("doc_id", C.block_reason(F.col("intl_block")).alias("reason"))


@register("completion_shape", f"select doc_id, {COMPLETION_REASON} as reason from compiled", ["compiled"])
def completion_shape(spark, sf) -> DataFrame:
    return view(spark, sf, "compiled").select("doc_id", C.completion_reason(F.col("compiled_code")).alias("reason"))


@register(
    "patch_shape",
    "select doc_id, text like '%INTENT%' and regexp_matches(t, 'PATCH') as has_patch, regexp_matches(t, '^(?i)patch') as starts "
    "from (select doc_id, intl_block as text, case when lang = 'en' then 'Patch ' else '' end || case when source = 'web' then 'PATCH ' else '' end || intl_block as t from compiled) x",
    ["compiled"],
)
def patch_shape(spark, sf) -> DataFrame:
    text = F.concat(
        F.when(F.col("lang") == "en", "Patch ").otherwise(""), F.when(F.col("source") == "web", "PATCH ").otherwise(""), "intl_block"
    )
    rows = view(spark, sf, "compiled").select("doc_id", text.alias("t"))
    return rows.select("doc_id", C.is_patch_text(F.col("t")).alias("has_patch"), C.starts_with_patch(F.col("t")).alias("starts"))


@register(
    "manifest_shape",
    f"""select p_partkey, case when not json_valid({CLEAN}) then 'invalid JSON' when coalesce(json_type({CLEAN}, '$.modules'), '') = 'ARRAY' then 'ok'
        else 'missing modules list' end as reason from manifests""",
    ["manifests"],
)
def manifest_shape(spark, sf) -> DataFrame:
    clean = T.strip_fences_all(F.col("manifest"), lang="(?:json)?")
    rows = view(spark, sf, "manifests").select("p_partkey", clean.alias("clean"))
    return rows.select("p_partkey", C.manifest_reason(F.col("clean")).alias("reason"))


@register(
    "has_sentinels",
    rf"""select doc_id, regexp_matches(raw_code, '(#|--|<!--|/\*){WS}*═+{WS}*INTL:BEGIN') and regexp_matches(raw_code, '(#|--|<!--|/\*){WS}*═+{WS}*INTL:END') as marked from compiled""",
    ["compiled"],
)
def has_sentinels(spark, sf) -> DataFrame:
    return view(spark, sf, "compiled").select("doc_id", C.has_sentinels(F.col("raw_code")).alias("marked"))


# --- syntax -------------------------------------------------------------------------------------------
# Brackets left over after repeatedly removing closed pairs: nothing may remain.
PEELED = (
    r"with recursive b as (select k, id, regexp_replace(t, '[^()\[\]{}]+', '', 'g') as s from "
    r"(select 'doc' as k, doc_id as id, compiled_code as t from compiled union all select 'page', page_id, html from pages) x), "
    r"peel as (select k, id, s, 0 as n from b union all "
    r"select k, id, regexp_replace(s, '\(\)|\[\]|\{\}', '', 'g'), n + 1 from peel where regexp_matches(s, '\(\)|\[\]|\{\}')) "
    r"select k, id, arg_max(s, n) = '' as balanced from peel group by k, id"
)


@register("bracket_balance", PEELED, ["compiled"])
def bracket_balance(spark, sf) -> DataFrame:
    docs = view(spark, sf, "compiled").select(F.lit("doc").alias("k"), F.col("doc_id").alias("id"), F.col("compiled_code").alias("t"))
    pages = table(spark, sf, "pages").select(F.lit("page").alias("k"), F.col("page_id").alias("id"), F.col("html").alias("t"))
    # The bracket strings form their own projection: they are read several times.
    marks = docs.unionByName(pages).select("k", "id", C.brackets_of(F.col("t")).alias("marks"))
    return marks.select("k", "id", C.balanced_marks(F.col("marks")).alias("balanced"))


@register(
    "syntax_signals",
    rf"""select doc_id, {word_sql('SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER|BEGIN|COMMIT', '(?i)')} as sql_word,
       regexp_matches(compiled_code, '<[a-zA-Z][^>]*>') as html_tag, regexp_matches(compiled_code, '({W}|-){WS}*\{{') as css_rule from compiled""",
    ["compiled"],
)
def syntax_signals(spark, sf) -> DataFrame:
    """The keyword, tag and rule tests on every row, whatever its profile."""
    rows = view(spark, sf, "compiled")
    found = lambda prefix: C.check_rules(F.col("compiled_code"), F.lit(prefix))["passed"]
    return rows.select("doc_id", found("sql").alias("sql_word"), found("html").alias("html_tag"), found("css").alias("css_rule"))


# The Python parser has no SQL twin, but the derived rows say what must fail: a planted brace or
# bracket pair, a wrongly indented line, or a text whose carriage returns break out of its comment.
SYNTAX = rf"""
    marks as (select doc_id, regexp_replace(compiled_code, '[^()\[\]{{}}]+', '', 'g') as s from compiled),
    peel as (select doc_id, s, 0 as n from marks union all
             select doc_id, regexp_replace(s, '\(\)|\[\]|\{{\}}', '', 'g'), n + 1 from peel where regexp_matches(s, '\(\)|\[\]|\{{\}}')),
    balance as (select doc_id, arg_max(s, n) = '' as balanced from peel group by doc_id),
    syntax as (select doc_id, profile,
      case when profile like 'python%' then not (doc_id % 17 = 0 or doc_id % 37 = 0 or doc_id % 31 = 0 or regexp_matches(text, '[\r\x0c]'))
           when profile like 'sql%' then {word_sql('SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER|BEGIN|COMMIT', '(?i)')}
           when profile like 'html%' then regexp_matches(compiled_code, '<[a-zA-Z][^>]*>')
           when profile like 'css%' then regexp_matches(compiled_code, '({W}|-){WS}*\{{') else balanced end as t1
      from compiled join balance using (doc_id))
"""


@register(
    "check_syntax",
    f"""with recursive {SYNTAX} select doc_id, profile, t1 as passed,
        case when profile like 'python%' then case when t1 then 'Python AST parse OK' else 'Syntax error' end
             when profile like 'sql%' then case when t1 then 'SQL keyword present' else 'No SQL keyword found in output' end
             when profile like 'html%' then case when t1 then 'HTML tag present' else 'No HTML tag found in output' end
             when profile like 'css%' then case when t1 then 'CSS rule present' else 'No CSS rule found in output' end
             when not t1 then 'Unbalanced braces/brackets' when profile like 'typescript%' or profile like 'javascript%' then 'Brace balance OK'
             else 'Brace balance OK (fallback)' end as message from syntax""",
    ["compiled"],
)
def check_syntax(spark, sf) -> DataFrame:
    """Messages of the Python parser are cut at the colon, behind which its wording varies by version."""
    found = V.validate(compiled(spark, sf), fixed.CHECK_NAMES[:1])
    rows = found.select("doc_id", "profile", F.inline("checks"))
    return rows.select("doc_id", "profile", "passed", F.substring_index("message", ":", 1).alias("message"))


# --- validation as a whole --------------------------------------------------------------------------------
ALL_CHECKED = f"with recursive {SYNTAX}, {JUDGED}, seven as (select f.* exclude (passed), t1, t1 and f.passed as passed from final f join syntax using (doc_id))"


@register("validate", f"{ALL_CHECKED} select doc_id, profile, t1, t2, t3, t4, t5, t6, t7, passed from seven", ["compiled"])
def validate(spark, sf) -> DataFrame:
    rows = V.validate(compiled(spark, sf))
    flags = [F.element_at("checks", n).passed.alias(f"t{n}") for n in range(1, 8)]
    return rows.select("doc_id", "profile", *flags, "passed")


@register("validate_rules", f"with {JUDGED} select doc_id, t2, t3, t4, t5, t6, t7, passed from final", ["compiled"])
def validate_rules(spark, sf) -> DataFrame:
    rows = rules_checked(spark, sf)
    flags = [F.element_at("checks", n).passed.alias(f"t{n + 1}") for n in range(1, 7)]
    return rows.select("doc_id", *flags, "passed")


@register(
    "validation_summary",
    f"""{ALL_CHECKED} select doc_id, 'Validation ' || case when passed then 'PASSED' else 'FAILED' end || ' (' ||
        (t1::int + t2::int + t3::int + t4::int + t5::int + t6::int + t7::int)::varchar || '/7 checks)' as headline,
        8 + (not t2)::int + (not t3)::int + (not t4)::int + (not t6)::int + (not t7)::int::bigint as lines from seven""",
    ["compiled"],
)
def validation_summary(spark, sf) -> DataFrame:
    """Lines leave out the parser's own detail, whose wording is not ours."""
    rows = V.with_summary(V.validate(compiled(spark, sf)))
    first = F.element_at("checks", 1)
    detail = (~first.passed & (first.detail != "")).cast("int")
    lines = (F.size(F.split("summary", "\n")) - detail).cast("bigint").alias("lines")
    return rows.select("doc_id", F.substring_index("summary", "\n", 1).alias("headline"), lines)


@register(
    "escalation_package",
    f"""{ALL_CHECKED} select doc_id, md5(intl_block) as block_digest, md5(compiled_code) as code_digest,
        concat_ws(' ', case when not t1 then 'T1-Syntax' end, case when not t2 then 'T2-Sentinel' end, case when not t3 then 'T3-Preconditions' end, case when not t4 then 'T4-Postconditions' end,
          case when not t5 then 'T5-SideEffects' end, case when not t6 then 'T6-Types' end, case when not t7 then 'T7-NoPlaceholders' end) as failed from seven where not passed""",
    ["compiled"],
)
def escalation_package(spark, sf) -> DataFrame:
    rows = V.escalation_package(V.validate(compiled(spark, sf))).where("package is not null")
    names = F.array_join(F.transform("package.failed_checks", lambda c: c["name"]), " ")
    return rows.select(
        "doc_id", F.md5("package.intl_block").alias("block_digest"), F.md5("package.compiled_code").alias("code_digest"), names.alias("failed")
    )


@register(
    "quality_gate",
    f"""with r as (select doc_id, case when b <> 'ok' then b when c <> 'ok' then c when observable is not true then 'condition 1 not met' else 'ok' end as reason
        from (select doc_id, observable, {BLOCK_REASON} as b, {COMPLETION_REASON} as c from compiled) x)
        select reason, count(*) as rows, sum(doc_id)::bigint as ids from r group by reason""",
    ["compiled"],
)
def quality_gate(spark, sf) -> DataFrame:
    pairs = compiled(spark, sf).select("doc_id", "observable", F.col("intl_block").alias("prompt"), F.col("compiled_code").alias("completion"))
    accepted, rejected = V.quality_gate(pairs, F.col("observable"))
    both = accepted.select("doc_id", F.lit("ok").alias("reason")).unionByName(rejected.select("doc_id", "reason"))
    return both.groupBy("reason").agg(F.count("*").alias("rows"), F.sum("doc_id").alias("ids"))


@register("low_confidence", "select id, confidence from blocks where confidence < 0.8", ["blocks"])
def low_confidence(spark, sf) -> DataFrame:
    return V.low_confidence(view(spark, sf, "blocks")).select("id", "confidence")


EXPECTATIONS = {"priced": "l_extendedprice > 1000", "discounted": "l_discount >= 0.02", "small": "l_quantity <= 45"}


@register(
    "expect",
    """select l_orderkey, l_linenumber, l_partkey, concat_ws(',', case when not (l_extendedprice > 1000) then 'priced' end,
       case when not (l_discount >= 0.02) then 'discounted' end, case when not (l_quantity <= 45) then 'small' end) as broken from lineitem""",
)
def expect(spark, sf) -> DataFrame:
    kept, quarantined = V.expect(table(spark, sf, "lineitem"), EXPECTATIONS)
    key = ["l_orderkey", "l_linenumber", "l_partkey"]
    good = kept.select(*key, F.lit("").alias("broken"))
    return good.unionByName(quarantined.select(*key, F.array_join("broken_rules", ",").alias("broken")))


@register(
    "expect_conditions",
    """with r as (select p_brand, min(p_size) + 10 as least, min(p_type) as t, 10 + count(*) % 3 as n from part group by 1)
       select p_partkey, concat_ws(',', case when not (p_size >= least and not p_type = t or length(p_name) > n) then 'mixed' end,
         case when not (p_retailprice > 1000 or p_size < 30 and p_type <> t) then 'priced' end) as broken, 1 as unread
       from part join r using (p_brand)""",
)
def expect_conditions(spark, sf) -> DataFrame:
    """Conditions that the corpus itself holds: three of each brand, in the block language, one of them prose."""
    parts = table(spark, sf, "part")
    made = parts.groupBy("p_brand").agg((F.min("p_size") + 10).alias("least"), F.min("p_type").alias("t"), (10 + F.count("*") % 3).alias("n"))
    mixed = F.concat(F.lit("p_size >= "), "least", F.lit(' AND NOT p_type == "'), "t", F.lit('" OR p_name.length > '), "n")
    priced = F.concat(F.lit('p_retailprice > 1000 OR p_size < 30 AND p_type != "'), "t", F.lit('"'))
    rules = made.select("p_brand", F.explode(F.array(mixed, priced, F.lit("the part must be sold somewhere"))).alias("condition"))
    judged = V.expect_conditions(parts, rules, "p_brand")
    names = F.transform("broken", lambda c: F.when(c.startswith("p_size"), F.lit("mixed")).otherwise("priced"))
    return judged.select("p_partkey", F.array_join(F.array_sort(names), ",").alias("broken"), F.size("unread").alias("unread"))


FIELDS = [
    {"name": "p_name", "type": "String(11)", "not_null": True},
    {"name": "p_type", "type": "Int?", "not_null": False},
    {"name": "p_size", "type": "Int", "not_null": True},
    {"name": "p_brand", "type": "UUID", "not_null": False},
]


@register(
    "validate_against",
    """select p_partkey, concat_ws('; ', case when length(p_name) > 11 then 'p_name: longer than 11' end,
       case when p_type is not null and try_cast(p_type as bigint) is null then 'p_type: not Int?' end, case when p_size is null then 'p_size: null' end,
       case when not regexp_matches(p_brand, '^[0-9a-fA-F]{8}-') then 'p_brand: not UUID' end,
       case when not (p_retailprice > p_size * 40) then 'constraint: p_retailprice > p_size * 40' end) as violations from part""",
)
def validate_against(spark, sf) -> DataFrame:
    rows = V.validate_against(table(spark, sf, "part"), FIELDS, ["p_retailprice > p_size * 40"])
    return rows.select("p_partkey", F.array_join("violations", "; ").alias("violations"))


@register(
    "fail_if",
    "select o_orderkey, case when o_totalprice > 400000 then 'OrderError' end as error, case when o_totalprice > 400000 then 'too large' end as message from orders",
)
def fail_if(spark, sf) -> DataFrame:
    rows = V.fail_if(table(spark, sf, "orders"), F.col("o_totalprice") > 400000, "OrderError", "too large")
    return rows.select("o_orderkey", F.col("failure.error").alias("error"), F.col("failure.message").alias("message"))


@register("unique_ids", "select l_orderkey::varchar || '-' || l_linenumber::varchar as id, count(*) as n from lineitem group by 1 having count(*) > 1")
def unique_ids(spark, sf) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"))
    return V.duplicate_ids(rows)


@register(
    "required_fields",
    """select p_partkey, kind, concat_ws(' ', case when m1 then 'INTENT' end, case when m2 then 'POSTCONDITION' end) as missing from (
       select p_partkey, 'FUNCTION' as kind, p_partkey % 9 = 0 as m1, p_partkey % 4 = 0 as m2 from part
       union all select p_partkey, 'PIPELINE', false, false from part union all select p_partkey, 'TYPE', true, false from part
       union all select p_partkey, 'PATCH', false, false from part where p_partkey % 8 = 0) x""",
)
def required_fields(spark, sf) -> DataFrame:
    rows = V.required_fields(field_rows(spark, sf))
    return rows.select("p_partkey", "kind", F.array_join("missing_fields", " ").alias("missing"))


# --- rates ------------------------------------------------------------------------------------------------
CATALOG_SQL = "(values " + ", ".join(f"('{p}', {ph}, {t}::double, {n}::bigint)" for p, ph, t, n in fixed.PROFILES) + ") cat(profile, phase, threshold, pairs)"


@register(
    "adapter_pass_rate",
    f"""{ALL_CHECKED} select profile, count(*) as n, avg(passed::int) as pass_rate, any_value(threshold) as threshold, avg(passed::int) >= any_value(threshold) as meets
        from seven join {CATALOG_SQL} using (profile) group by profile""",
    ["compiled"],
)
def adapter_pass_rate(spark, sf) -> DataFrame:
    """Flagship: all seven checks, pass rate per adapter against the adapter's threshold."""
    rates = G.pass_rate(V.validate(compiled(spark, sf)), ["profile"])
    return J.against_threshold(rates, J.default_catalog(spark)).select("profile", "n", "pass_rate", "threshold", "meets")


@register(
    "rule_pass_rate",
    f"""with {JUDGED} select profile, count(*) as n, avg(passed::int) as pass_rate, any_value(threshold) as threshold, avg(passed::int) >= any_value(threshold) as meets
        from final join {CATALOG_SQL} using (profile) group by profile""",
    ["compiled"],
)
def rule_pass_rate(spark, sf) -> DataFrame:
    rates = G.pass_rate(rules_checked(spark, sf), ["profile"])
    return J.against_threshold(rates, J.default_catalog(spark)).select("profile", "n", "pass_rate", "threshold", "meets")


TIER_SQL = "(values " + ", ".join(
    f"('{lang}', '{tier}', {retries}, {rate}::double, {limit}::double)" for tier, langs, retries, rate, limit in fixed.TIERS for lang in langs
) + ") tiers(language, tier, budget, rate, cap)"


@register(
    "tier_pass_rate",
    f"""{ALL_CHECKED} select tier, any_value(rate) as required_rate, count(*) as n, avg(passed::int) as pass_rate, avg(passed::int) >= any_value(rate) as meets
        from seven join {TIER_SQL} on language = split_part(profile, '_', 1) group by tier""",
    ["compiled"],
)
def tier_pass_rate(spark, sf) -> DataFrame:
    return G.tier_pass_rate(V.validate(compiled(spark, sf)))


@register(
    "escalation_rate",
    f"""{ALL_CHECKED} select tier, any_value(cap) as escalation_limit, count(*) as n, avg((not passed and attempt >= budget)::int) as escalation_rate,
        avg((not passed and attempt >= budget)::int) < any_value(cap) as within
        from seven join {TIER_SQL} on language = split_part(profile, '_', 1) group by tier""",
    ["compiled"],
)
def escalation_rate(spark, sf) -> DataFrame:
    rows = J.retry_budget(V.validate(compiled(spark, sf)))
    return G.escalation_rate(rows.withColumn("escalated", ~F.col("passed") & F.col("exhausted")))


@register(
    "failing_checks",
    f"""{ALL_CHECKED}, s as (select count(*) filter (where not t1) as z, count(*) filter (where not t2) as a, count(*) filter (where not t3) as b, count(*) filter (where not t4) as c,
        count(*) filter (where not t5) as d, count(*) filter (where not t6) as e, count(*) filter (where not t7) as f from seven)
        select '{fixed.CHECK_NAMES[0]}' as name, z as failures from s union all select 'T2-Sentinel', a from s union all select 'T3-Preconditions', b from s union all select 'T4-Postconditions', c from s
        union all select 'T5-SideEffects', d from s union all select 'T6-Types', e from s union all select 'T7-NoPlaceholders', f from s""",
    ["compiled"],
)
def failing_checks(spark, sf) -> DataFrame:
    return G.failing_checks(V.validate(compiled(spark, sf)), fixed.CHECK_NAMES)


@register(
    "retry_budget",
    f"select doc_id, budget as retry_budget, attempt >= budget as exhausted from compiled join {TIER_SQL} on language = split_part(profile, '_', 1)",
    ["compiled"],
)
def retry_budget(spark, sf) -> DataFrame:
    return J.retry_budget(view(spark, sf, "compiled")).select("doc_id", "retry_budget", "exhausted")
