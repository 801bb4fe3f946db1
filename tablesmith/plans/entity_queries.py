"""Registered queries of entities by several keys, similar names, the page index, novelty and evolving tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

from tablesmith.operators import graph, names, novelty, shared
from tablesmith.plans import evolving
from tablesmith.plans.queries import _SEARCH, literal, query, table, values
from tablesmith.sources import index


@query("""with recursive k as (select c_custkey as id, 'a' || c_nationkey || ':' || floor(c_acctbal / 3)::bigint as v from customer union all select c_custkey, 'b' || c_custkey // 2 from customer where c_custkey % 10 < 6),
e as (select distinct x.id as a, y.id as b from k x join k y using (v) where x.id <> y.id),
r(id, seen) as (select c_custkey, c_custkey from customer union select e.b, r.seen from r join e on e.a = r.id)
select id as c_custkey, min(seen) as leader from r group by 1""")
def multi_key_entities(s: SparkSession, d: str) -> DataFrame:
    """Customers that share a nation and a balance, or a pair of numbers, by any chain of these."""
    k = F.col("c_custkey")
    keys = {"a": F.concat_ws(":", "c_nationkey", F.floor(F.col("c_acctbal") / 3)), "b": F.when(k % 10 < 6, F.floor(k / 2))}
    return graph.same_by_keys(table(s, d, "customer"), "c_custkey", keys).select("c_custkey", "leader")


@query("""with p as (select 'http://u/' || (c_custkey % 400) as url, c_custkey as seq, case when c_custkey % 3 > 0 then c_mktsegment end as segment, c_custkey % 7 / 10.0::double as confidence from customer),
t as (select url, max((confidence, seq)) as top from p group by url), r as (select p.*, case when seq = top[2] then 0 else 1 end as o from p join t using (url))
select arg_min(segment, (o, seq)) filter (segment is not null) as segment, max(confidence) as confidence, count(*) as member_count, string_agg(url, '; ' order by seq) as sources from r group by url""")
def same_url_merge(s: SparkSession, d: str) -> DataFrame:
    """Rows of one page merged into one."""
    k = F.col("c_custkey")
    p = table(s, d, "customer").select(k.alias("seq"), F.concat(F.lit("http://u/"), k % 400).alias("source_url"), F.when(k % 3 > 0, F.col("c_mktsegment")).alias("segment"), (k % 7 / 10).alias("confidence"))
    return graph.merged_by_url(p, "source_url", ["segment"]).select("segment", "confidence", "member_count", F.array_join("sources", "; ").alias("sources"))


@query("""with n as (select distinct p_type || ' ' || p_brand as name from part), j as (select x.name as a, y.name as b, jaro_winkler_similarity(x.name, y.name) as v from n x join n y on x.name < y.name)
select a, b, round(v, 6) as similarity, case when v >= 0.95 then 'same' when v >= 0.85 then 'likely' else 'possible' end as tier from j where v >= 0.85""")
def similar_names(s: SparkSession, d: str) -> DataFrame:
    """Part types with their brand that are likely or surely the same."""
    n = table(s, d, "part").select(F.concat_ws(" ", "p_type", "p_brand").alias("name"))
    return names.similar_names(n, names.TIERS["likely"]).select("a", "b", F.round("similarity", 6).alias("similarity"), "tier")


@query("""with n as (select distinct p_name as name from part), j as (select x.name as a, y.name as b, jaro_winkler_similarity(x.name, y.name) as v from n x join n y on x.name < y.name)
select a, b, round(v, 6) as similarity, case when v >= 0.95 then 'same' when v >= 0.85 then 'likely' else 'possible' end as tier from j where v >= 0.7""")
def similar_names_all_tiers(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "part").select(F.col("p_name").alias("name"))
    return names.similar_names(n).select("a", "b", F.round("similarity", 6).alias("similarity"), "tier")


@query(f"""
with t as (select distinct query_id, unnest(string_split(q, ' ')) as term from {literal(_SEARCH, "query_id, q")}),
w as (select page_id, list_filter(regexp_split_to_array(lower(regexp_replace(html, '<[^>]*>', ' ', 'g')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as w from pages),
st as (select count(*) as n, sum(len(w))::double / count(*) as avg_dl from w),
tf as (select page_id, dl, term, count(*) as tf from (select page_id, len(w) as dl, unnest(w) as term from w) group by all),
df as (select term, count(*) as df from tf group by 1),
sc as (select query_id, page_id, sum(floor(ln((n - df + 0.5::double) / (df + 0.5::double) + 1.0::double) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avg_dl)) * 1000000)::bigint)::bigint as score from tf join df using (term) join t using (term), st group by all),
r as (select *, row_number() over (partition by query_id order by score desc, page_id) - 1 as position from sc)
select query_id::bigint as query_id, url, position, score from r join pages using (page_id) where position < 20""")
def bm25_search(s: SparkSession, d: str) -> DataFrame:
    """The best 20 pages of each search by a stored index."""
    found = index.build(table(s, d, "pages"), shared.new_path(s, "index"))
    return found.search(values(s, _SEARCH, "query_id long, query_text string")).select("query_id", "url", "position", "score")


@query("""with r as (select event_type as run_id, event_id // 500 as batch, user_id as key from events),
f as (select run_id, batch, count(*) as new_rows from (select run_id, key, min(batch) as batch from r group by 1, 2) group by 1, 2),
m as (select run_id, batch, total_rows, coalesce(new_rows, 0) as new_rows, coalesce(new_rows, 0)::double / total_rows < 0.2 as saturated from (select run_id, batch, count(*) as total_rows from r group by 1, 2) left join f using (run_id, batch)),
c as (select run_id, min(batch) as stop from m where saturated group by 1)
select m.* from m left join c using (run_id) where stop is null or batch <= stop""")
def novel_stop(s: SparkSession, d: str) -> DataFrame:
    """Runs end once fewer than a fifth of a batch's rows are entities that the run hasn't had."""
    e = table(s, d, "events").select(F.col("event_type").alias("run_id"), F.floor(F.col("event_id") / 500).alias("batch"), F.col("user_id").alias("key"))
    return novelty.saturation_stop(e, 0.2)


@query("select o_orderkey as id, o_totalprice as price, case when o_orderstatus <> 'F' then o_orderpriority end as priority from orders")
def evolved_table(s: SparkSession, d: str) -> DataFrame:
    """Orders of which some were written before a column was added and another renamed."""
    o = table(s, d, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority"), "o_orderstatus")
    t = evolving.EvolvingTable(s, shared.new_path(s, "evolving"), "orders")
    t.add_column("id", LongType())
    t.add_column("total", DoubleType())
    t.append(o.where("o_orderstatus = 'F'"))
    t.add_column("priority", StringType())
    t.rename_column("total", "price")
    t.append(o.where("o_orderstatus <> 'F'").withColumnRenamed("total", "price"))
    return t.read()
