"""Data statements and scalar expressions over the order tables and the event log."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusworks.functions import scalars as S
from corpusworks.operators import constructs as D
from corpusworks.plans.inputs import table
from corpusworks.plans.registry import register

NOW = "timestamp '2024-01-31 00:00:00'"


def now():
    """The instant the given event log ends; passed as data so that results repeat."""
    return F.expr("timestamp_ntz'2024-01-31 00:00:00'")


def steady(value, digits: int = 6):
    """Rounded so that sums added up in another order agree: exact halves are moved off the edge."""
    return F.round(value + 1e-9, digits)


# --- reading and changing ------------------------------------------------------------------------------
@register("query_where", "select o_orderkey, o_totalprice from orders where o_totalprice > 300000 and o_orderstatus = 'F' order by o_totalprice desc, o_orderkey limit 50")
def query_where(spark, sf) -> DataFrame:
    rows = D.query(
        table(spark, sf, "orders"), "o_totalprice > 300000 and o_orderstatus = 'F'", 50, [F.desc("o_totalprice"), "o_orderkey"]
    )
    return rows.select("o_orderkey", "o_totalprice")


@register(
    "persist_insert",
    "select s_suppkey as id, s_name as name, s_acctbal as balance, 'S' as side from supplier union all select c_custkey, c_name, c_acctbal, null from customer",
)
def persist_insert(spark, sf) -> DataFrame:
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.lit("S").alias("side")
    )
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")
    )
    return D.persist_insert(suppliers, rows)


@register(
    "persist_update",
    "select c_custkey, case when c_acctbal < 0 then 0.0 else c_acctbal end as c_acctbal, case when c_acctbal < 0 then 'BLOCKED' else c_mktsegment end as c_mktsegment from customer",
)
def persist_update(spark, sf) -> DataFrame:
    rows = D.persist_update(
        table(spark, sf, "customer"), {"c_acctbal": F.lit(0.0), "c_mktsegment": F.lit("BLOCKED")}, "c_acctbal < 0"
    )
    return rows.select("c_custkey", "c_acctbal", "c_mktsegment")


@register("update_returning", "select o_orderkey, 'O' as o_orderstatus, o_totalprice from orders where o_orderstatus = 'P'")
def update_returning(spark, sf) -> DataFrame:
    rows = D.returning(table(spark, sf, "orders"), {"o_orderstatus": F.lit("O")}, "o_orderstatus = 'P'")
    return rows.select("o_orderkey", "o_orderstatus", "o_totalprice")


@register("persist_delete", "select event_id, value from events where not (event_type = 'error' and value > 10)")
def persist_delete(spark, sf) -> DataFrame:
    rows = D.persist_delete(table(spark, sf, "events"), "event_type = 'error' and value > 10")
    return rows.select("event_id", "value")


@register(
    "upsert",
    """with rows as (select c_custkey, c_name, c_acctbal + 100 as c_acctbal from customer where c_mktsegment = 'MACHINERY'
         union all select s_suppkey + 100000000, s_name, s_acctbal from supplier)
       select c_custkey, c_name, c_acctbal from rows union all
       select c_custkey, c_name, c_acctbal from customer where c_custkey not in (select c_custkey from rows)""",
)
def upsert(spark, sf) -> DataFrame:
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    changed = customers.where("c_mktsegment = 'MACHINERY'").withColumn("c_acctbal", F.col("c_acctbal") + 100)
    added = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") + 100000000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal")
    )
    rows = changed.drop("c_mktsegment").unionByName(added)
    return D.upsert(customers.drop("c_mktsegment"), rows, "c_custkey")


@register(
    "archive_move",
    "select o_orderkey < 0 or o_orderdate < timestamp '1996-01-01' and o_orderstatus = 'F' as archived, count(*) as rows, sum(o_orderkey)::bigint as ids from orders group by 1",
)
def archive_move(spark, sf) -> DataFrame:
    kept, archived = D.archive_move(table(spark, sf, "orders"), "o_orderdate < timestamp_ntz'1996-01-01' and o_orderstatus = 'F'")
    both = kept.withColumn("archived", F.lit(False)).unionByName(archived.withColumn("archived", F.lit(True)))
    return both.groupBy("archived").agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("ids"))


@register(
    "audit_append",
    "select 'UPDATE' as action, o_orderkey::varchar as row_key, timestamp '2024-01-31 00:00:00' as at from orders where o_orderstatus = 'P' "
    "union all select event_type, event_id::varchar, ts from events where event_type = 'error'",
)
def audit_append(spark, sf) -> DataFrame:
    audit = table(spark, sf, "events").where("event_type = 'error'").select(
        F.col("event_type").alias("action"), F.col("event_id").cast("string").alias("row_key"), F.col("ts").alias("at")
    )
    touched = table(spark, sf, "orders").where("o_orderstatus = 'P'")
    return D.audit_append(touched, audit, "UPDATE", "o_orderkey", now())


@register(
    "all_or_nothing",
    "select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem where l_orderkey not in (select l_orderkey from lineitem where l_quantity > 48)",
)
def all_or_nothing(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return D.all_or_nothing(lines, "l_orderkey", "l_quantity <= 48")


# --- pages ------------------------------------------------------------------------------------------------
@register("paginate", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25 offset 100")
def paginate(spark, sf) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return D.paginate(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], page=5, size=25)


@register("paginate_after", "select o_orderkey, o_totalprice from orders where o_orderkey > 500 order by o_orderkey limit 40")
def paginate_after(spark, sf) -> DataFrame:
    return D.paginate_after(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500, 40)


@register(
    "page_envelope",
    "select c_custkey, c_acctbal, (select count(*) from customer) as total_count, 3 as page from customer order by c_acctbal desc, c_custkey limit 20 offset 40",
)
def page_envelope(spark, sf) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return D.page_envelope(rows, [F.desc("c_acctbal"), F.asc("c_custkey")], page=3, size=20)


# --- aggregates ---------------------------------------------------------------------------------------------
@register(
    "aggregate",
    "select l_returnflag, count(*) as n, sum(l_linenumber)::bigint as lines, max(l_extendedprice) as top, min(l_quantity) as least, count(distinct l_suppkey) as suppliers from lineitem group by 1",
)
def aggregate(spark, sf) -> DataFrame:
    return D.aggregate(
        table(spark, sf, "lineitem"), ["l_returnflag"],
        {
            "n": ("COUNT", "*"), "lines": ("SUM", "l_linenumber"), "top": ("MAX", "l_extendedprice"),
            "least": ("MIN", "l_quantity"), "suppliers": ("COUNT_DISTINCT", "l_suppkey"),
        },
    )


@register(
    "aggregate_having",
    "select o_custkey, count(*) as n, max(o_totalprice) as top from orders group by 1 having count(*) > 12 and max(o_totalprice) > 400000",
)
def aggregate_having(spark, sf) -> DataFrame:
    return D.aggregate_having(
        table(spark, sf, "orders"), ["o_custkey"], [F.count("*").alias("n"), F.max("o_totalprice").alias("top")],
        "n > 12 and top > 400000",
    )


@register(
    "aggregate_where",
    "select user_id, count(*) filter (where event_type = 'error') as errors, count(*) filter (where value > 20) as large from events group by 1",
)
def aggregate_where(spark, sf) -> DataFrame:
    return D.aggregate_where(
        table(spark, sf, "events"), ["user_id"], {"errors": F.col("event_type") == "error", "large": F.col("value") > 20}
    )


@register("collect_where", "select event_id, user_id, ts from events where event_type = 'purchase' and value > 15")
def collect_where(spark, sf) -> DataFrame:
    rows = D.collect_where(table(spark, sf, "events"), "event_type = 'purchase' and value > 15")
    return rows.select("event_id", "user_id", "ts")


JOINED = """from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
    where o_orderdate between timestamp '1996-01-01' and timestamp '1998-12-31'"""


def sales_by_nation(spark, sf) -> DataFrame:
    day = lambda d: F.expr(f"timestamp_ntz'{d}'")
    return D.aggregate_join(
        table(spark, sf, "lineitem"),
        [
            (table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")),
            (table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")),
            (table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")),
        ],
        ["n_name"],
        [
            F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) + 0.001, 0).cast("bigint").alias("volume"),
            F.countDistinct("o_custkey").alias("customers"), steady(F.avg("l_discount")).alias("discount"),
        ],
        F.col("o_orderdate").between(day("1996-01-01"), day("1998-12-31")),
    )


SALES_SQL = f"""select n_name, round(sum(l_extendedprice * l_quantity) + 0.001, 0)::bigint as volume, count(distinct o_custkey) as customers, round(avg(l_discount) + 1e-9, 6) as discount {JOINED} group by 1"""


@register("aggregate_join", SALES_SQL)
def aggregate_join(spark, sf) -> DataFrame:
    return sales_by_nation(spark, sf)


@register(
    "bucket_counts",
    "select case when l_quantity = 0 then 'out' when l_quantity < 10 then 'low' when l_quantity < 30 then 'in' else 'plenty' end as bucket, count(*) as n from lineitem group by 1",
)
def bucket_counts(spark, sf) -> DataFrame:
    q = F.col("l_quantity")
    return D.bucket_counts(table(spark, sf, "lineitem"), [("out", q == 0), ("low", q < 10), ("in", q < 30)], "plenty")


@register(
    "string_agg",
    f"""select user_id, row_number() over w as pos, case when row_number() over w = 1 then event_type else '; ' || event_type end as piece
        from events where ts > {NOW} - interval 7 days window w as (partition by user_id order by ts, event_id)""",
)
def string_agg(spark, sf) -> DataFrame:
    rows = D.recent(table(spark, sf, "events"), "ts", now(), "7 days")
    return D.string_agg(rows, ["user_id"], "event_type", ["ts", "event_id"], "; ")


@register(
    "weighted_mean",
    """select l_suppkey, round(avg(p_retailprice) + 1e-9, 6) as mean, round(sum(p_retailprice * l_quantity) / sum(l_quantity) + 1e-9, 6) as weighted, count(*) as n
       from lineitem join part on l_partkey = p_partkey where l_quantity >= 5 group by 1""",
)
def weighted_mean(spark, sf) -> DataFrame:
    scored = D.equi_join(table(spark, sf, "lineitem"), table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = D.weighted_mean(scored, ["l_suppkey"], "p_retailprice", "l_quantity", 5)
    return rows.withColumns({"mean": steady(F.col("mean")), "weighted": steady(F.col("weighted"))})


@register(
    "ratio_metrics",
    f"""select user_id, count(*) as n, count(*) filter (where event_type = 'click') / count(*) as hit_ratio, round(sum(value) / count(*) + 1e-9, 6) as score_ratio
        from events where ts > {NOW} - interval 14 days group by 1""",
)
def ratio_metrics(spark, sf) -> DataFrame:
    rows = D.recent(table(spark, sf, "events"), "ts", now(), "14 days")
    out = D.ratio_metrics(rows, ["user_id"], F.col("event_type") == "click", F.col("value"))
    return out.withColumn("score_ratio", steady(F.col("score_ratio")))


@register(
    "trending",
    """select p_brand, count(*) as n, round(avg(l_quantity) + 1e-9, 6) as average from lineitem join part on l_partkey = p_partkey
       group by 1 having count(*) > 100 order by avg(l_quantity) desc, p_brand limit 5""",
)
def trending(spark, sf) -> DataFrame:
    rows = D.equi_join(table(spark, sf, "lineitem"), table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return D.trending(rows, "p_brand", "l_quantity", 100, 5).withColumn("average", steady(F.col("average")))


@register("recent", f"select event_id, user_id from events where ts > {NOW} - interval 3 days")
def recent(spark, sf) -> DataFrame:
    return D.recent(table(spark, sf, "events"), "ts", now(), "3 days").select("event_id", "user_id")


@register("in_list", "select o_orderkey, o_orderstatus from orders where o_orderstatus in ('F', 'P')")
def in_list(spark, sf) -> DataFrame:
    return D.in_list(table(spark, sf, "orders"), "o_orderstatus", ["F", "P"]).select("o_orderkey", "o_orderstatus")


@register("observe", "select 'rows' as metric, count(*)::double as value from events union all select 'errors', count(*) filter (where event_type = 'error') from events union all select 'largest', max(value) from events")
def observe(spark, sf) -> DataFrame:
    """The observed counts, read back after the step has run once."""
    watched, seen = D.observe(
        table(spark, sf, "events"), rows=F.count(F.lit(1)), errors=F.count_if(F.col("event_type") == "error"), largest=F.max("value")
    )
    watched.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(k, float(v)) for k, v in seen.get.items()], "metric string, value double")


@register(
    "search_rank",
    "select doc_id, n_chars as score from documents where text ilike '%entre%' order by score desc, doc_id limit 30",
)
def search_rank(spark, sf) -> DataFrame:
    rows = D.search_rank(table(spark, sf, "documents"), "text", "entre", F.col("n_chars"), 30, "doc_id")
    return rows.select("doc_id", "score")


# --- values ------------------------------------------------------------------------------------------------------
@register(
    "transform_using",
    "select page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) as host, md5(url) as digest from pages",
)
def transform_using(spark, sf) -> DataFrame:
    rows = D.transform(table(spark, sf, "pages"), "url", ["trim", "extract_domain"], "host")
    return D.transform(rows, "url", "md5", "digest").select("page_id", "host", "digest")


@register(
    "transform_chain",
    "select c_custkey, array_to_string(list_transform(string_split(lower(trim(c_mktsegment)), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as segment from customer",
)
def transform_chain(spark, sf) -> DataFrame:
    return D.transform(table(spark, sf, "customer"), "c_mktsegment", ["trim", "lower", "title_case"], "segment").select("c_custkey", "segment")


@register(
    "loop_rows",
    "select vec_id, label, count(*) as items, round(sum(x) + 1e-9, 4) as total from (select vec_id, label, unnest(embedding) as x from embeddings) t group by 1, 2",
)
def loop_rows(spark, sf) -> DataFrame:
    rows = D.loop(table(spark, sf, "embeddings"), "embedding", "x")
    return rows.groupBy("vec_id", "label").agg(F.count("x").alias("items"), steady(F.sum(F.col("x").cast("double")), 4).alias("total"))


@register(
    "loop_values",
    "select page_id, array_to_string(list_transform(string_split(url, '/'), lambda p: upper(p)), '/') as shouted from pages",
)
def loop_values(spark, sf) -> DataFrame:
    parts = table(spark, sf, "pages").withColumn("parts", F.split("url", "/"))
    return D.loop(parts, "parts", "shouted", F.upper).select("page_id", F.array_join("shouted", "/").alias("shouted"))


@register("if_then_else", "select o_orderkey, case when o_totalprice > 250000 then 'large' else o_orderstatus end as size from orders")
def if_then_else(spark, sf) -> DataFrame:
    value = D.if_then_else(F.col("o_totalprice") > 250000, F.lit("large"), F.col("o_orderstatus"))
    return table(spark, sf, "orders").select("o_orderkey", value.alias("size"))


@register(
    "fallback",
    """with p as (select c_custkey as id, c_acctbal as amount from customer), b as (select o_custkey as id, sum(o_orderkey)::double as amount from orders group by 1)
       select id, amount, 'primary' as source from p where amount > 0 union all select id, amount, 'backup' from b where id not in (select id from p where amount > 0)""",
)
def fallback(spark, sf) -> DataFrame:
    primary = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"))
    backup = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_orderkey").cast("double").alias("amount"))
    return D.fallback(primary, backup, "id", "amount > 0")


@register(
    "normalize_band",
    """select event_id, (value - 1.0) / 29.0 as scaled, case when value not between 1.0 and 30.0 then 'rejected' when (value - 1.0) / 29.0 < 0.33 then 'low'
       when (value - 1.0) / 29.0 < 0.67 then 'medium' else 'high' end as band from events""",
)
def normalize_band(spark, sf) -> DataFrame:
    scaled, rejected = D.normalize_band(table(spark, sf, "events"), "value", 1.0, 30.0)
    out_of_range = rejected.select("event_id", ((F.col("value") - 1.0) / 29.0).alias("scaled"), F.lit("rejected").alias("band"))
    return scaled.select("event_id", "scaled", "band").unionByName(out_of_range)


@register(
    "tier_prices",
    """with rates as (select p_brand, avg(p_size) / 25.0 as rate from part where p_type <> 'ECONOMY' group by 1), c as (
         select p_partkey, p_retailprice * coalesce(rate, 1.0) as converted from part left join rates using (p_brand))
       select p_partkey, converted, converted * 1.0 as standard, converted * 0.75 as member from c""",
)
def tier_prices(spark, sf) -> DataFrame:
    parts = table(spark, sf, "part")
    rates = parts.where("p_type <> 'ECONOMY'").groupBy("p_brand").agg((F.avg("p_size") / 25.0).alias("rate"))
    rows = D.tier_prices(parts, rates, "p_brand", "p_retailprice", {"standard": 0.0, "member": 0.25})
    return rows.select("p_partkey", "converted", "prices.standard", "prices.member")


@register(
    "normalize_events",
    "select event_id, user_id, event_type as type, 'log' as source, cast(json_extract(props, '$.k') as bigint) as k, sha256(props) as checksum from events",
)
def normalize_events(spark, sf) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", "props")
    return D.normalize_events(rows, "props", "k bigint", "event_type", "log")


# --- lookups and joins ------------------------------------------------------------------------------------------------
@register(
    "cache_lookup",
    """select g.event_id, g.user_id, case when g.ts < s.ts + interval 1 hour then s.value end as value
       from (select * from events where event_type = 'view') g asof left join (select * from events where event_type = 'click') s on g.user_id = s.user_id and g.ts >= s.ts""",
)
def cache_lookup(spark, sf) -> DataFrame:
    events = table(spark, sf, "events")
    gets = events.where("event_type = 'view'").select("event_id", "user_id", "ts")
    sets = events.where("event_type = 'click'").select("user_id", "ts", "value")
    return D.cache_lookup(gets, sets, key="user_id", ttl="1 hour").select("event_id", "user_id", "value")


@register(
    "cached_report",
    f"""with c as (select n_name || '|1996' as report_key, -1 as volume from nation where n_regionkey = 1)
        select s.n_name, s.n_name || '|1996' as report_key, coalesce(c.volume, s.volume) as volume, c.volume is not null as reused
        from ({SALES_SQL}) s left join c on c.report_key = s.n_name || '|1996'""",
)
def cached_report(spark, sf) -> DataFrame:
    computed = sales_by_nation(spark, sf).select("n_name", "volume", F.lit("1996").alias("year"))
    # Reports cached earlier: one region still valid, one expired.
    nations = table(spark, sf, "nation").where("n_regionkey in (1, 2)")
    until = F.when(F.col("n_regionkey") == 1, F.expr("timestamp_ntz'2024-02-01'")).otherwise(F.expr("timestamp_ntz'2024-01-01'"))
    cache = nations.select(
        "n_name", F.lit(-1).cast("bigint").alias("volume"), F.lit("1996").alias("year"),
        F.concat_ws("|", "n_name", F.lit("1996")).alias("report_key"), until.alias("expires_at"),
    )
    rows = D.cached_report(computed, cache, ["n_name", "year"], now(), "1 hour")
    return rows.select("n_name", "report_key", "volume", "reused")


@register("semi_in", "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 450000)")
def semi_in(spark, sf) -> DataFrame:
    keys = table(spark, sf, "orders").where("o_totalprice > 450000")
    return D.semi_in(table(spark, sf, "customer"), keys, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@register("not_in", "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 400000)")
def not_in(spark, sf) -> DataFrame:
    keys = table(spark, sf, "orders").where("o_totalprice > 400000")
    return D.not_in(table(spark, sf, "customer"), keys, "c_custkey", "o_custkey", sql_nulls=True).select("c_custkey", "c_name")


@register(
    "equi_join",
    "select o_orderkey, c_name, o_totalprice from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING' and o_totalprice > 200000",
)
def equi_join(spark, sf) -> DataFrame:
    condition = (F.col("c_mktsegment") == "BUILDING") & (F.col("o_totalprice") > 200000)
    rows = D.equi_join(table(spark, sf, "orders"), table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), condition)
    return rows.select("o_orderkey", "c_name", "o_totalprice")


@register(
    "scalar_lookup",
    "select d.doc_id, coalesce(quality, -1) as quality from documents d left join labels using (doc_id)",
)
def scalar_lookup(spark, sf) -> DataFrame:
    rows = D.scalar_lookup(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", "quality", -1)
    return rows.select("doc_id", "quality")


# --- expressions ---------------------------------------------------------------------------------------------------------
@register(
    "comparison_expressions",
    """select o_orderkey, o_totalprice >= 100000 and not o_orderstatus = 'F' or o_orderpriority <> '5-LOW' as mixed,
       nullif(o_orderstatus, 'P') is null as is_null, (o_totalprice + 10) * 2 - o_totalprice / 4 as arithmetic, o_totalprice between 1000 and 200000 as inside from orders""",
)
def comparison_expressions(spark, sf) -> DataFrame:
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    mixed = (price >= 100000) & ~(status == "F") | (F.col("o_orderpriority") != "5-LOW")
    return table(spark, sf, "orders").select(
        "o_orderkey", mixed.alias("mixed"), F.nullif(status, F.lit("P")).isNull().alias("is_null"),
        ((price + 10) * 2 - price / 4).alias("arithmetic"), price.between(1000, 200000).alias("inside"),
    )


@register(
    "duration_values",
    """select event_id, ts + to_seconds(cast(substr(d, 1, length(d) - 1) as bigint) * case right(d, 1) when 's' then 1 when 'm' then 60 when 'h' then 3600 else 86400 end) as expires_at,
       cast(substr(d, 1, length(d) - 1) as bigint) * case right(d, 1) when 's' then 1 when 'm' then 60 when 'h' then 3600 else 86400 end as seconds
       from (select event_id, ts, (1 + event_id % 90)::varchar || ['s', 'm', 'h', 'd'][1 + user_id % 4] as d from events) x""",
)
def duration_values(spark, sf) -> DataFrame:
    units = F.array(*[F.lit(u) for u in "smhd"])
    text = F.concat((1 + F.col("event_id") % 90).cast("string"), F.element_at(units, (1 + F.col("user_id") % 4).cast("int")))
    rows = table(spark, sf, "events").select("event_id", "ts", text.alias("d"))
    return rows.select(
        "event_id", (F.col("ts") + S.duration(F.col("d"))).alias("expires_at"), S.duration_seconds(F.col("d")).alias("seconds")
    )


@register(
    "scalar_functions",
    """select c.c_custkey, length(c_name) as n, least(greatest(c_acctbal, 0.0), 5000.0) as clamped, c_acctbal / nullif(c_nationkey, 0) as ratio,
       concat_ws(':', 'customer', c_custkey::varchar, c_mktsegment) as cache_key, sha256(c_name) as name_hash, md5(c_mktsegment) as segment_hash,
       substr(c_name, 1, 8) as head, try_cast(substr(c_name, 10) as bigint) as number, c_mktsegment ilike 'build%' as building from customer c""",
)
def scalar_functions(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(
        "c_custkey", S.length_of(F.col("c_name")).cast("bigint").alias("n"), S.clamp(F.col("c_acctbal"), 0.0, 5000.0).alias("clamped"),
        S.safe_ratio(F.col("c_acctbal"), F.col("c_nationkey")).alias("ratio"),
        S.cache_key(F.lit("customer"), F.col("c_custkey"), F.col("c_mktsegment")).alias("cache_key"),
        S.TRANSFORMS["hash"](F.col("c_name")).alias("name_hash"), S.TRANSFORMS["md5"](F.col("c_mktsegment")).alias("segment_hash"),
        F.substring("c_name", 1, 8).alias("head"), F.substring("c_name", 10, 20).try_cast("bigint").alias("number"),
        F.ilike(F.col("c_mktsegment"), F.lit("build%")).alias("building"),
    )


@register(
    "date_functions",
    """select o_orderkey, year(o_orderdate)::int as y, month(o_orderdate)::int as m, date_trunc('month', o_orderdate)::timestamp as month_start,
       o_orderdate + interval 30 days as due, strftime(o_orderdate, '%Y-%m-%d') as day from orders""",
)
def date_functions(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey", F.extract(F.lit("YEAR"), "o_orderdate").alias("y"), F.extract(F.lit("MONTH"), "o_orderdate").alias("m"),
        F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month_start"),
        (F.col("o_orderdate") + F.expr("interval 30 days")).alias("due"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
    )


@register(
    "json_and_struct_fields",
    "select event_id, cast(json_extract(props, '$.k') as bigint) as k, cast(json_extract(props, '$.k') as bigint) > 50 as large from events",
)
def json_and_struct_fields(spark, sf) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint").alias("props"))
    return rows.select("event_id", F.col("props.k").alias("k"), (F.col("props.k") > 50).alias("large"))


@register(
    "regex_functions",
    r"select doc_id, regexp_matches(text, '[0-9]{3}') as digits, len(regexp_extract_all(text, '[a-z]+')) as words, md5(regexp_replace(text, '[aeiou]', '*', 'g')) as masked from documents",
)
def regex_functions(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", F.col("text").rlike("[0-9]{3}").alias("digits"), F.regexp_count("text", F.lit("[a-z]+")).cast("bigint").alias("words"),
        F.md5(F.regexp_replace("text", "[aeiou]", "*")).alias("masked"),
    )


@register("aggregate_custom", "select event_type, max(value) - min(value) as spread from events group by 1")
def aggregate_custom(spark, sf) -> DataFrame:
    """A user-named aggregate."""
    S.register_aggregate("SPREAD", lambda c: F.max(c) - F.min(c))
    return D.aggregate(table(spark, sf, "events"), ["event_type"], {"spread": ("SPREAD", "value")})


@register("transform_custom", "select p_partkey, replace(p_name, ' ', '-') || '#' || length(p_name)::varchar as slug from part")
def transform_custom(spark, sf) -> DataFrame:
    """A user-named function."""
    S.register_transform("slug", lambda c: F.concat(F.replace(c, F.lit(" "), F.lit("-")), F.lit("#"), F.length(c).cast("string")))
    return D.transform(table(spark, sf, "part"), "p_name", "slug", "slug").select("p_partkey", "slug")


def second_largest(values):
    """The two largest distinct values; missing ones are NaN."""
    top = np.unique(values)[::-1][:2]
    return np.concatenate([top, np.full(2 - len(top), np.nan)])


SECOND_LARGEST = S.Mergeable(
    second_largest,
    lambda a, b: second_largest(np.concatenate([a, b])[~np.isnan(np.concatenate([a, b]))]),
    lambda state: None if np.isnan(state[1]) else float(state[1]),
)


@register(
    "aggregate_merging",
    """select event_type, user_id % 7 as team, max(value) filter (where value < top) as runner_up from events
       join (select event_type, user_id % 7 as team, max(value) as top from events group by 1, 2) t using (event_type) where t.team = user_id % 7 group by 1, 2""",
)
def aggregate_merging(spark, sf) -> DataFrame:
    """A user-named aggregate with a state of its own: the second largest distinct value."""
    S.register_mergeable("SECOND_LARGEST", SECOND_LARGEST)
    rows = table(spark, sf, "events").select("event_type", (F.col("user_id") % 7).alias("team"), "value")
    return D.aggregate_merging(rows, ["event_type", "team"], "SECOND_LARGEST", "value", "runner_up")


def check_digits(numbers: pa.Array) -> pa.Array:
    """The digit that, put behind a number, makes its weighted digit sum a multiple of ten."""
    rest, total, double = numbers.to_numpy(zero_copy_only=False).copy(), 0, True
    total = np.zeros(len(rest), dtype=np.int64)
    while rest.any():
        digit = rest % 10 * (2 if double else 1)
        total += np.where(digit > 9, digit - 9, digit)
        rest, double = rest // 10, not double
    return pa.array((10 - total % 10) % 10)


@register(
    "transform_vectorised",
    """select p_partkey, (10 - list_sum(list_transform(range(1, len(s) + 1), lambda i: case when i % 2 = 1 then case when s[i]::int > 4 then s[i]::int * 2 - 9 else s[i]::int * 2 end else s[i]::int end))::bigint % 10) % 10 as digit
       from (select p_partkey, reverse(p_partkey::varchar) as s from part where p_size > 25) x""",
)
def transform_vectorised(spark, sf) -> DataFrame:
    """A user-named function over whole Arrow arrays, behind a filter."""
    S.register_vectorised("check_digit", check_digits, "bigint")
    rows = table(spark, sf, "part").where("p_size > 25")
    return D.transform(rows.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), F.col("p_partkey").cast("bigint").alias("n")), "n", "check_digit", "digit").select("p_partkey", "digit")
