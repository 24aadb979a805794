"""Sampling, splits, audits, routing and files of a training corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusworks import fixed
from corpusworks.functions import draws
from corpusworks.functions import text as T
from corpusworks.operators import corpus as G
from corpusworks.operators import routing as J
from corpusworks.operators import sampling as W
from corpusworks.operators.validate import validate as validated
from corpusworks.plans.check_queries import ALL_CHECKED, CATALOG_SQL, TIER_SQL
from corpusworks.plans.inputs import compiled, table, view
from corpusworks.plans.registry import register
from corpusworks.plans.text_queries import TOKENS, WS, strip_sql
from corpusworks.session import scratch_path
from corpusworks.sources import pairs as P
from corpusworks.sources.files import read_sources
from corpusworks.sources.files import write_pieces as write_files

N_VAL = fixed.VALIDATION_PAIRS


def draw_sql(key: str, seed: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::bigint / 4294967296.0)"


def key_sql(col: str) -> str:
    return f"sha256(regexp_replace({strip_sql(col)}, '{WS}+', ' ', 'g'))"


def hex_key():
    return F.lower(F.hex("prompt_key")).alias("prompt_key")


def list_sql(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# --- draws ------------------------------------------------------------------------------------------------
@register(
    "assign_category",
    f"select doc_id, case when d < 0.6 then 'A' when d < 0.6::double + 0.3::double then 'B' else 'C' end as category from (select doc_id, {draw_sql('doc_id::varchar', '7')} as d from documents) x",
)
def assign_category(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", draws.assign_category(F.col("doc_id"), 7).alias("category"))


@register(
    "assign_choice",
    f"""select doc_id, {list_sql(fixed.DOMAINS)}[floor({draw_sql('doc_id::varchar', 'domain')} * 20)::int + 1] as domain,
        {list_sql(fixed.PATCH_IDEAS)}[floor({draw_sql('doc_id::varchar', 'idea')} * 5)::int + 1] as idea,
        {list_sql(fixed.FLAWS)}[floor({draw_sql('doc_id::varchar', 'flaw')} * 5)::int + 1] as flaw from documents""",
)
def assign_choice(spark, sf) -> DataFrame:
    key = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id", draws.uniform_choice(key, fixed.DOMAINS, "domain").alias("domain"),
        draws.uniform_choice(key, fixed.PATCH_IDEAS, "idea").alias("idea"), draws.uniform_choice(key, fixed.FLAWS, "flaw").alias("flaw"),
    )


def needs(spark, sf) -> DataFrame:
    """Rows wanted per adapter, 25 for each pair there is: the quota list grows with the corpus."""
    have = view(spark, sf, "pairs").groupBy("adapter").agg(F.count("*").alias("have"))
    return have.select("adapter", (F.col("have") * 25).alias("need"))


SLOTS = f"""
    with n as (select adapter, count(*) * 25 as need from pairs group by 1),
    q as (select adapter, need, least(100, need // 22) as high from n),
    c as (select unnest({list_sql(fixed.CONSTRUCTS)}) as construct),
    f as (select adapter, need, construct, unnest(range(1, case when construct in ('PARALLEL', 'FALLBACK', 'TRANSACTION') then high else 50 end + 1)) as i from q cross join c),
    m as (select adapter, need, unnest(range(1, greatest(0, need - (3 * high + 950)) + 1)) as i from q),
    p as (select adapter, need, {list_sql(fixed.CONSTRUCTS)}[floor({draw_sql("concat_ws(':', 'pad', adapter, i::varchar)", '3')} * 22)::int + 1] as construct, i + 1000000 as i from m),
    s as (select *, {draw_sql("concat_ws(':', adapter, construct, i::varchar)", '3')} as d from (select * from f union all select * from p) u),
    r as (select adapter, need, construct, row_number() over (partition by adapter order by d, construct, i) as slot from s)
    select adapter, construct, slot from r where slot <= need
"""


@register("construct_schedule", SLOTS, ["compiled", "pairs"])
def construct_schedule(spark, sf) -> DataFrame:
    return W.construct_schedule(needs(spark, sf), 3)


@register(
    "shuffle",
    f"select idx, row_number() over (order by {draw_sql('idx::varchar', '11')}, idx) <= 100 as early from pairs",
    ["compiled", "pairs"],
)
def shuffle(spark, sf) -> DataFrame:
    """Shuffled rows; the first hundred are marked, which only a correct order gets right."""
    pairs = view(spark, sf, "pairs").select("idx")
    first = W.shuffle(pairs, "idx", 11).limit(100).withColumn("early", F.lit(True))
    return pairs.join(first, "idx", "left").withColumn("early", F.coalesce("early", F.lit(False)))


# Sums that the prompts from each place on can make up, then the prompts in drawn order that leave such a rest.
SPLIT = f"""
    g as (select adapter, {key_sql('prompt')} as k, count(*) as n, {draw_sql('k', '5')} as d from pairs group by 1, 2),
    o as (select *, coalesce(sum(n) over (partition by adapter order by d, k rows between unbounded preceding and 1 preceding), 0) as before,
          row_number() over (partition by adapter, n order by d, k) * n <= {N_VAL} as needed from g),
    c as (select adapter, k, n, row_number() over (partition by adapter order by d, k) as i from o where needed),
    reach as (select adapter, count(*) + 1 as i, [0::bigint] as sums from c group by adapter
          union all select adapter, c.i, list_distinct(sums || list_filter(list_transform(sums, lambda x: x + n), lambda x: x <= {N_VAL})) from reach join c using (adapter) where c.i = reach.i - 1),
    walk as (select adapter, 0::bigint as i, {N_VAL}::bigint as rest, null::varchar as k, false as taken from reach where i = 1 and list_contains(sums, {N_VAL})
          union all select w.adapter, c.i, w.rest - case when t.yes then c.n else 0 end, c.k, t.yes from walk w join c on c.adapter = w.adapter and c.i = w.i + 1
          join reach r on r.adapter = c.adapter and r.i = c.i + 1, lateral (select list_contains(r.sums, w.rest - c.n) as yes) t),
    chosen as (select adapter, k from walk where taken union all select adapter, k from o where before < {N_VAL} and adapter not in (select adapter from walk)),
    assigned as (select p.*, case when c.k is null then 'train' else 'validation' end as split from pairs p left join chosen c on c.adapter = p.adapter and c.k = {key_sql('p.prompt')})
"""


def split_pairs(spark, sf) -> DataFrame:
    return W.split_train_val(view(spark, sf, "pairs"), N_VAL, 5)


@register("split_train_val", f"with recursive {SPLIT} select idx, adapter, split from assigned", ["compiled", "pairs"])
def split_train_val(spark, sf) -> DataFrame:
    return split_pairs(spark, sf).select("idx", "adapter", "split")


@register("micro_batches", "select idx, (row_number() over (order by idx) - 1) // 3 as batch, ((row_number() over (order by idx) - 1) % 3)::int as place from pairs where category = 'A'", ["compiled", "pairs"])
def micro_batches(spark, sf) -> DataFrame:
    return W.micro_batches(view(spark, sf, "pairs").where("category = 'A'").select("idx"), "idx")


@register("checkpoint_numbers", "select doc_id as idx, (row_number() over (order by doc_id) - 1) // 50 as checkpoint from compiled where observable", ["compiled"])
def checkpoint_numbers(spark, sf) -> DataFrame:
    good = compiled(spark, sf).where("observable").select(F.col("doc_id").alias("idx"))
    return W.checkpoint_numbers(good, "idx")


@register(
    "next_ids",
    "with last as (select max(substr(block_id, 2)::bigint) as n from compiled) select page_id, 'f' || lpad((n + row_number() over (order by page_id))::varchar, greatest(4, length((n + row_number() over (order by page_id))::varchar))::int, '0') as id from pages, last",
    ["compiled"],
)
def next_ids(spark, sf) -> DataFrame:
    existing = view(spark, sf, "compiled").select(F.col("block_id").alias("id"))
    return W.next_ids(existing, table(spark, sf, "pages").select("page_id"), "page_id")


@register("first_occurrence", f"select min(idx) as idx from pairs group by {key_sql('prompt')}", ["compiled", "pairs"])
def first_occurrence(spark, sf) -> DataFrame:
    return W.first_occurrence(view(spark, sf, "pairs")).select("idx")


@register(
    "top_k_per_group",
    "select adapter, idx, rank from (select adapter, idx, row_number() over (partition by adapter order by length(prompt) desc, idx) as rank from pairs) x where rank <= 7",
    ["compiled", "pairs"],
)
def top_k_per_group(spark, sf) -> DataFrame:
    sized = view(spark, sf, "pairs").select("adapter", "idx", F.length("prompt").alias("n"))
    return W.top_k_per_group(sized, ["adapter"], [F.desc("n"), F.asc("idx")], 7).select(
        "adapter", "idx", F.col("rank").cast("bigint").alias("rank")
    )


# --- leakage and duplicates ------------------------------------------------------------------------------------
@register(
    "leakage",
    f"""with h as (select *, doc_id in (select doc_id from labels) as held from documents)
        select doc_id from h where held and {key_sql('text')} in (select {key_sql('text')} from h where not held)""",
)
def leakage(spark, sf) -> DataFrame:
    """Labelled documents, taken as held out, whose text also occurs among the others."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    labels = table(spark, sf, "labels").select("doc_id")
    corpus, held_out = docs.join(labels, "doc_id", "left_anti"), docs.join(labels, "doc_id", "left_semi")
    return G.leakage(corpus, held_out, "doc_id").select("doc_id")


@register(
    "split_sizes",
    f"with recursive {SPLIT} select adapter, count(*) filter (where split = 'train') as train, count(*) filter (where split = 'validation') as validation, "
    f"greatest(0, count(*) filter (where split = 'validation') - {N_VAL}) as overshoot from assigned group by 1",
    ["compiled", "pairs"],
)
def split_sizes(spark, sf) -> DataFrame:
    return W.split_sizes(split_pairs(spark, sf), N_VAL)


@register(
    "leakage_after_split",
    f"with recursive {SPLIT} select adapter, count(*) as prompts, 0::bigint as leaked from (select distinct adapter, {key_sql('prompt')} as k from assigned) x group by 1",
    ["compiled", "pairs"],
)
def leakage_after_split(spark, sf) -> DataFrame:
    """Prompts per adapter and how many of them are on both sides of the split."""
    return G.split_leakage(split_pairs(spark, sf))


@register(
    "leaked_keys",
    f"select distinct {key_sql('text')} as prompt_key from documents where {key_sql('text')} in (select {key_sql('text')} from documents where lang = 'fr') and lang <> 'fr' "
    f"union select {key_sql('text')} from benchmark",
)
def leaked_keys(spark, sf) -> DataFrame:
    """Keys common to two sets of texts: other languages with French, and the held-out items, which both sets hold."""
    docs = table(spark, sf, "documents").withColumnRenamed("text", "prompt")
    items = table(spark, sf, "benchmark").select(F.col("text").alias("prompt"))
    french = docs.where("lang = 'fr'").select("prompt").unionByName(items)
    others = docs.where("lang <> 'fr'").select("prompt").unionByName(items)
    return G.leaked_keys(others, french).select(hex_key())


@register(
    "without_leakage",
    f"select doc_id from documents where {key_sql('text')} not in (select {key_sql('text')} from documents where source = (select min(source) from documents)) ",
)
def without_leakage(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").withColumnRenamed("text", "prompt")
    held_out = docs.join(docs.agg(F.min("source").alias("source")), "source", "left_semi")
    return G.without_leakage(docs, held_out, "doc_id").select("doc_id")


@register(
    "duplicate_prompts",
    f"select {key_sql('prompt')} as prompt_key, count(*) as copies, min(idx) as first_row from pairs group by 1 having count(*) > 1",
    ["compiled", "pairs"],
)
def duplicate_prompts(spark, sf) -> DataFrame:
    return G.duplicate_prompts(view(spark, sf, "pairs")).select(hex_key(), "copies", "first_row")


# --- coverage and reports -----------------------------------------------------------------------------------------
@register(
    "category_mix",
    """with c as (select adapter, category, count(*) as n from pairs group by 1, 2), t as (select *, sum(n) over (partition by adapter) as total from c)
       select adapter, category, n, total::bigint as total, n / total as share, case category when 'A' then 0.6 when 'B' then 0.3 else 0.1 end::double as target,
         n / total - case category when 'A' then 0.6 when 'B' then 0.3 else 0.1 end::double as deviation from t""",
    ["compiled", "pairs"],
)
def category_mix(spark, sf) -> DataFrame:
    return G.category_mix(view(spark, sf, "pairs"))


GRID = f"""select adapter, construct, case when construct in ('PARALLEL', 'FALLBACK', 'TRANSACTION') then 100 else 50 end::bigint as needed
    from (select distinct adapter from pairs) a cross join (select unnest({list_sql(fixed.CONSTRUCTS)}) as construct) c"""


@register(
    "construct_coverage",
    f"select adapter, construct, needed, count(idx) as have, greatest(0, needed - count(idx)) as shortfall from ({GRID}) g left join pairs using (adapter, construct) group by 1, 2, 3",
    ["compiled", "pairs"],
)
def construct_coverage(spark, sf) -> DataFrame:
    return G.construct_coverage(view(spark, sf, "pairs"))


@register("coverage_grid", GRID, ["compiled", "pairs"])
def coverage_grid(spark, sf) -> DataFrame:
    return G.coverage_grid(view(spark, sf, "pairs").select("adapter").distinct())


@register(
    "patch_target_coverage",
    f"select adapter, construct, count(idx) as have, count(idx) > 0 as covered from ({GRID}) g left join (select * from pairs where category = 'B') p using (adapter, construct) group by 1, 2",
    ["compiled", "pairs"],
)
def patch_target_coverage(spark, sf) -> DataFrame:
    return G.patch_target_coverage(view(spark, sf, "pairs"))


@register(
    "run_progress",
    """select user_id, count(*) filter (where event_type <> 'error') as good, count(*) filter (where event_type = 'error') as failed, count(*) as done,
       case when max(ts) > min(ts) then round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) * 60, 9) else 0.0 end as per_minute from events group by 1""",
)
def run_progress(spark, sf) -> DataFrame:
    rows = G.run_progress(table(spark, sf, "events"), F.col("event_type") != "error", by=["user_id"])
    return rows.withColumn("per_minute", F.round("per_minute", 9))


TARGETS = f"(select profile as adapter, pairs as target from {CATALOG_SQL})"


def targets(spark) -> DataFrame:
    return J.default_catalog(spark).select(F.col("profile").alias("adapter"), F.col("pairs").cast("bigint").alias("target"))


@register(
    "resume_shortfall",
    f"select adapter, target, count(idx) as have, greatest(0, target - count(idx)) as need from {TARGETS} t left join pairs using (adapter) group by 1, 2",
    ["compiled", "pairs"],
)
def resume_shortfall(spark, sf) -> DataFrame:
    return G.resume_shortfall(targets(spark), view(spark, sf, "pairs"), ["adapter"])


@register(
    "call_estimate",
    f"""with n as (select adapter, greatest(0, target - count(idx)) as need from {TARGETS} t left join pairs using (adapter) group by adapter, target)
        select sum(need)::bigint as total_needed, floor(sum(need) * (2 * 0.6::double + 4 * 0.3::double + 3 * 0.1::double))::bigint as calls from n""",
    ["compiled", "pairs"],
)
def call_estimate(spark, sf) -> DataFrame:
    return G.call_estimate(G.resume_shortfall(targets(spark), view(spark, sf, "pairs"), ["adapter"]))


@register(
    "merge_append",
    f"with recursive {SPLIT} select 'old' as origin, split, count(*) as rows from assigned group by 1, 2 union all select 'new', 'train', count(*) from conversations where role = 'user'",
    ["compiled", "pairs"],
)
def merge_append(spark, sf) -> DataFrame:
    old = split_pairs(spark, sf).select("idx", "prompt", "split", F.lit("old").alias("origin"))
    new = table(spark, sf, "conversations").where("role = 'user'").select(
        F.col("text").alias("prompt"), F.lit("train").alias("split"), F.lit("new").alias("origin")
    )
    return G.merge_append(old, new).groupBy("origin", "split").agg(F.count("*").alias("rows"))


@register(
    "turn_pairs",
    """select u.conv_id, u.turn, md5(u.text) as prompt_digest, md5(a.text) as completion_digest from conversations u join conversations a
       on a.conv_id = u.conv_id and a.turn = u.turn + 1 and u.role = 'user' and a.role = 'assistant'""",
)
def turn_pairs(spark, sf) -> DataFrame:
    """Prompt and completion from user turns and the assistant turns that answer them."""
    turns = table(spark, sf, "conversations")
    users = turns.where("role = 'user'").select("conv_id", "turn", F.md5("text").alias("prompt_digest"))
    answers = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.md5("text").alias("completion_digest"))
    return users.join(answers, ["conv_id", "turn"])


def catalog_with_use(spark, sf) -> DataFrame:
    """The catalog with the pairs the corpus really holds."""
    have = view(spark, sf, "pairs").groupBy(F.col("adapter").alias("profile")).agg(F.count("*").alias("pairs"))
    base = J.default_catalog(spark).drop("pairs")
    return base.join(have, "profile", "left").withColumn("pairs", F.coalesce("pairs", F.lit(0).cast("bigint")))


USED = f"(select profile, phase, threshold, count(idx) as pairs from {CATALOG_SQL} left join pairs on adapter = profile group by 1, 2, 3)"


@register("phase_totals", f"select coalesce(phase, -1) as phase, coalesce(profile, 'all') as profile, sum(pairs)::bigint as pairs from {USED} u group by rollup (phase, profile)", ["compiled", "pairs"])
def phase_totals(spark, sf) -> DataFrame:
    totals = G.phase_totals(catalog_with_use(spark, sf))
    return totals.withColumns({"phase": F.coalesce("phase", F.lit(-1)), "profile": F.coalesce("profile", F.lit("all"))})


@register(
    "corpus_status",
    f"select profile, phase, count(idx) as generated, pairs as target, count(idx) >= pairs as complete from {CATALOG_SQL} left join (select idx, adapter from pairs) p on adapter = profile group by profile, phase, pairs",
    ["compiled", "pairs"],
)
def corpus_status(spark, sf) -> DataFrame:
    return G.corpus_status(view(spark, sf, "pairs"), J.default_catalog(spark))


@register(
    "phase_status",
    f"""with s as (select profile, phase, count(idx) >= pairs as complete from {CATALOG_SQL} left join (select idx, adapter from pairs) p on adapter = profile group by profile, phase, pairs)
        select phase, count(*) filter (where complete) || ' / ' || count(*) as progress from s group by 1""",
    ["compiled", "pairs"],
)
def phase_status(spark, sf) -> DataFrame:
    return G.phase_status(G.corpus_status(view(spark, sf, "pairs"), J.default_catalog(spark)))


LENGTHS = f"(select adapter, length(t) as chars, {TOKENS} as tokens from (select adapter, concat(system, chr(10), prompt, chr(10), completion) as t from pairs) y)"


@register(
    "length_profile",
    f"""select adapter, count(*) as n, min(chars) as min_chars, round(avg(chars) + 1e-9, 6) as avg_chars, max(chars) as max_chars,
        quantile_disc(tokens, 0.5) as median_tokens, max(tokens) as max_tokens, count(*) filter (where tokens > 2048) as over_limit from {LENGTHS} l group by 1""",
    ["compiled", "pairs"],
)
def length_profile(spark, sf) -> DataFrame:
    text = F.concat_ws("\n", "system", "prompt", "completion")
    rows = G.length_profile(view(spark, sf, "pairs").select("adapter", text.alias("text")))
    return rows.withColumn("avg_chars", F.round(F.col("avg_chars") + 1e-9, 6))


@register(
    "adapter_readiness",
    f"""{ALL_CHECKED}, {SPLIT}, p as (select adapter, count(*) as n, count(distinct construct) as c from pairs group by 1),
        h as (select adapter, count(*) as n, avg(passed::int) as rate from assigned join seven on doc_id = idx where split = 'validation' group by 1),
        r as (select profile as adapter, coalesce(p.n, 0) >= {fixed.NEW_TARGET_PAIRS} as enough_pairs, coalesce(p.c, 0) = 22 as all_constructs, coalesce(h.n, 0) >= {N_VAL} as enough_held_out,
          coalesce(h.rate >= threshold, false) as meets_threshold
        from {CATALOG_SQL} left join p on p.adapter = profile left join h on h.adapter = profile)
        select *, enough_pairs and all_constructs and enough_held_out and meets_threshold as ready from r""",
    ["compiled", "pairs"],
)
def adapter_readiness(spark, sf) -> DataFrame:
    """Pass rates of all seven checks over the held-out rows of the split."""
    passed = validated(compiled(spark, sf)).select(F.col("doc_id").alias("idx"), "passed")
    held_out = split_pairs(spark, sf).where("split = 'validation'").select("idx", "adapter").join(passed, "idx")
    rates = G.pass_rate(held_out, ["adapter"])
    return G.adapter_readiness(view(spark, sf, "pairs"), rates, J.default_catalog(spark), min_held_out=N_VAL)


@register("delta_ready", "select adapter, count(*) as pairs, count(*) >= 100 as enough from pairs where construct in ('QUERY', 'LOOP', 'LOCK') group by 1", ["compiled", "pairs"])
def delta_ready(spark, sf) -> DataFrame:
    return G.delta_ready(view(spark, sf, "pairs").where("construct in ('QUERY', 'LOOP', 'LOCK')"))


@register(
    "assemble_outputs",
    "select conv_id, turn, md5(text || chr(10) || chr(10)) as digest from conversations",
)
def assemble_outputs(spark, sf) -> DataFrame:
    """A conversation's turns stand for the blocks of a file."""
    pieces = G.assemble_outputs(table(spark, sf, "conversations"), "conv_id", "turn", "text")
    return pieces.select("conv_id", "turn", F.md5("text").alias("digest"))


@register(
    "write_pieces",
    "select conv_id, md5(string_agg(text || chr(10) || chr(10), '' order by turn)) as digest from conversations group by 1",
)
def write_pieces(spark, sf) -> DataFrame:
    """Files written from pieces, read back whole: one conversation of many turns may hold several
    files, whose order is that of their names."""
    folder = scratch_path(spark, "pieces")
    turns = table(spark, sf, "conversations")
    write_files(G.assemble_outputs(turns, "conv_id", "turn", "text"), folder, "conv_id", "turn", "text")
    files = read_sources(spark, f"{folder}/conv_id=*").select(
        F.regexp_extract("path", "conv_id=([0-9]+)", 1).cast("bigint").alias("conv_id"), "path", "source"
    )
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "source"))), lambda f: f.source), "")
    return files.groupBy("conv_id").agg(F.md5(texts).alias("digest"))


# --- routing ------------------------------------------------------------------------------------------------------------
@register(
    "route",
    f"select id, profile, phase, threshold, pairs, profile as adapter_id, '{fixed.BASE_MODEL}' as base_model, '' as error from modules join {CATALOG_SQL} using (profile) "
    f"union all select id, profile, -1, null, -1, null, null, 'Unknown profile ''' || profile || '''. Known profiles (24): {', '.join(sorted(r[0] for r in fixed.PROFILES))}' "
    f"from modules where profile not in (select profile from {CATALOG_SQL})",
    ["modules"],
)
def route(spark, sf) -> DataFrame:
    routed, rejected = J.route(view(spark, sf, "modules").select("id", "profile"), J.default_catalog(spark))
    good = routed.withColumn("error", F.lit(""))
    both = good.unionByName(rejected, allowMissingColumns=True)
    return both.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("phase", "pairs")})


@register("known_profile", f"select id, profile from modules where profile not in (select profile from {CATALOG_SQL})", ["modules"])
def known_profile(spark, sf) -> DataFrame:
    return J.known_profile(view(spark, sf, "modules"), J.default_catalog(spark)).select("id", "profile")


PLANNED = f"(select profile from {CATALOG_SQL} union select lang || '_plain' from documents)"


@register("unused_profiles", f"select profile from {PLANNED} except select profile from modules", ["modules"])
def unused_profiles(spark, sf) -> DataFrame:
    """The catalog with one planned profile for each language of the documents, less all profiles in use."""
    planned = table(spark, sf, "documents").select(F.concat("lang", F.lit("_plain")).alias("profile")).where("profile is not null")
    catalog = J.default_catalog(spark).select("profile").unionByName(planned.distinct())
    return J.unused_profiles(view(spark, sf, "modules"), catalog)


@register(
    "phases_complete",
    f"""with listed as (select distinct profile from modules), cat as (select profile from {CATALOG_SQL})
        select profile, 'catalog' as only_in from cat where profile not in (select profile from listed)
        union all select profile, 'phases' from listed where profile not in (select profile from cat)""",
    ["modules"],
)
def phases_complete(spark, sf) -> DataFrame:
    phases = view(spark, sf, "modules").select("profile")
    return J.phases_complete(J.default_catalog(spark), phases)


@register(
    "list_profiles",
    f"select profile from {USED} u where phase = 2 and pairs > 0",
    ["compiled", "pairs"],
)
def list_profiles(spark, sf) -> DataFrame:
    return J.list_profiles(catalog_with_use(spark, sf).where("pairs > 0"), 2)


@register(
    "adapters_by_phase",
    f"select phase, string_agg(profile || ' ' || pairs::varchar || ' ' || floor(threshold * 100)::int::varchar, ', ' order by profile) as profiles from {USED} u group by 1",
    ["compiled", "pairs"],
)
def adapters_by_phase(spark, sf) -> DataFrame:
    rows = J.adapters_by_phase(catalog_with_use(spark, sf))
    line = F.transform("profiles", lambda p: F.concat_ws(" ", p.profile, p.pairs.cast("string"), p.threshold_percent.cast("string")))
    return rows.select("phase", F.array_join(line, ", ").alias("profiles"))


@register(
    "is_trained",
    f"select id, coalesce(pairs > 0, false) as trained from modules left join {USED} u using (profile)",
    ["compiled", "pairs", "modules"],
)
def is_trained(spark, sf) -> DataFrame:
    return J.is_trained(view(spark, sf, "modules"), catalog_with_use(spark, sf)).select("id", "trained")


@register(
    "language_tiers",
    f"select id, tier, coalesce(budget, -1) as retry_budget, rate as required_rate, cap as escalation_limit from modules left join {TIER_SQL} on language = split_part(profile, '_', 1)",
    ["modules"],
)
def language_tiers(spark, sf) -> DataFrame:
    return J.with_tier(view(spark, sf, "modules")).select(
        "id", "tier", F.coalesce("retry_budget", F.lit(-1)).alias("retry_budget"), "required_rate", "escalation_limit"
    )


# --- files ---------------------------------------------------------------------------------------------------------------
def as_metadata(spark, sf) -> DataFrame:
    rows = split_pairs(spark, sf)
    meta = F.struct("category", "adapter", "construct", F.col("idx").cast("int").alias("idx"))
    return rows.select("system", "prompt", "completion", meta.alias("metadata"), "split")


@register(
    "pairs_round_trip",
    f"with recursive {SPLIT} select idx, adapter, split, md5(prompt) as prompt_digest, md5(completion) as completion_digest from assigned",
    ["compiled", "pairs"],
)
def pairs_round_trip(spark, sf) -> DataFrame:
    """Write pairs as JSON lines, read them back."""
    path = scratch_path(spark, "pairs")
    P.write_pairs(as_metadata(spark, sf), path)
    name = F.regexp_extract("file", "split=([a-z]+)", 1)
    rows = P.read_lines(spark, path).where("_corrupt_record is null").withColumn("split", name)
    return rows.select(
        F.col("metadata.idx").cast("bigint").alias("idx"), "metadata.adapter", "split", F.md5("prompt").alias("prompt_digest"),
        F.md5("completion").alias("completion_digest"),
    )


@register(
    "read_broken_lines",
    """select count(*) filter (where doc_id % 10 not in (3, 7)) as readable, count(*) filter (where doc_id % 10 = 3) as rejected from documents""",
)
def read_broken_lines(spark, sf) -> DataFrame:
    """Pairs from a file in which some lines are cut short and some are blank."""
    path = scratch_path(spark, "broken")
    good = F.to_json(F.struct(F.lit("s").alias("system"), F.col("text").alias("prompt"), F.lit("c").alias("completion")))
    line = F.when(F.col("doc_id") % 10 == 3, F.left(good, F.lit(20))).when(F.col("doc_id") % 10 == 7, " ").otherwise(good)
    table(spark, sf, "documents").select(line.alias("value")).write.text(path)
    lines = P.read_lines(spark, path)
    return lines.agg(
        F.count_if(F.col("_corrupt_record").isNull() & F.col("system").isNotNull()).alias("readable"),
        F.count_if(F.col("_corrupt_record").isNotNull()).alias("rejected"),
    )


@register(
    "append_corrections",
    "select profile as adapter, 2 * count(*) as rows from compiled group by 1",
    ["compiled"],
)
def append_corrections(spark, sf) -> DataFrame:
    """Two appends of the same corrections; counts per adapter folder."""
    from corpusworks.operators.rendering import render_correction
    from corpusworks.plans.text_queries import failed_rows

    path = scratch_path(spark, "corrections")
    rows = render_correction(failed_rows(spark, sf), F.expr("timestamp_ntz'2024-02-01 00:00:00'"))
    P.append_corrections(rows, path, compression="gzip")
    P.append_corrections(rows, path, compression="gzip")
    return P.read_pairs(spark, path).groupBy("metadata.adapter").agg(F.count("*").alias("rows"))


@register(
    "corpus_file_counts",
    """with k as (select unnest(['train', 'validation', 'corrections']) as kind), a as (select distinct lang as adapter from documents)
       select adapter, kind, case kind when 'train' then (select count(*) from documents d where d.lang = a.adapter)
         when 'validation' then (select count(*) from labels l join documents d using (doc_id) where d.lang = a.adapter) else 0 end as rows from a cross join k""",
)
def corpus_file_counts(spark, sf) -> DataFrame:
    """JSON lines files per language folder, counted by file kind."""
    root = scratch_path(spark, "files")
    docs = table(spark, sf, "documents")
    labelled = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id")
    for kind, rows in (("train", docs), ("val", labelled)):
        lines = rows.select(F.to_json(F.struct("doc_id", "text")).alias("value"), F.col("lang").alias("adapter"), F.lit(kind).alias("kind"))
        lines.write.mode("append").partitionBy("adapter", "kind").text(root)
    return P.file_counts(
        spark, f"{root}/adapter=*/kind=*", docs.select(F.col("lang").alias("adapter")).distinct(), r"/adapter=([^/]+)/kind=([^/]+)/"
    )
