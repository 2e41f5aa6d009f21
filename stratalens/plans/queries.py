"""Queries that run the analysis operators on the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import diffing, graph, lookup, overview, rules, surface
from ..sinks import reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parents(spark: SparkSession, d: str) -> DataFrame:
    """(child, parent, rank, ord): customers and suppliers below nations below regions; a debt weakens a link."""
    link = lambda t, c, p, cp, pp, rank: table(spark, d, t).select(
        F.concat(F.lit(cp), F.col(c).cast("string")).alias("child"), F.concat(F.lit(pp), F.col(p).cast("string")).alias("parent"), rank.cast("int").alias("rank"), F.lit(1).alias("ord"))
    weak = lambda c: F.when(F.col(c) < 0, 2).otherwise(3)
    return (link("customer", "c_custkey", "c_nationkey", "c", "n", weak("c_acctbal"))
            .unionByName(link("supplier", "s_suppkey", "s_nationkey", "s", "n", weak("s_acctbal")))
            .unionByName(link("nation", "n_nationkey", "n_regionkey", "n", "r", F.lit(3))))


_LINKS = """links as (
  select 'c' || c_custkey as child, 'n' || c_nationkey as parent, case when c_acctbal < 0 then 2 else 3 end as rank from customer
  union all select 's' || s_suppkey, 'n' || s_nationkey, case when s_acctbal < 0 then 2 else 3 end from supplier
  union all select 'n' || n_nationkey, 'r' || n_regionkey, 3 from nation)"""


@query(f"""with recursive {_LINKS},
up(node, role, confidence, depth, path) as (
  select child, parent, rank, 1, parent || '>' || child from links where parent[1] = 'r'
  union all select l.child, u.role, least(l.rank, u.confidence), u.depth + 1, u.path || '>' || l.child from up u join links l on l.parent = u.node)
select role, node, confidence::int as confidence, depth::int as depth, path from up""")
def role_assign_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("type")).withColumn("role", F.col("type"))
    found = graph.assign_roles(_parents(spark, sf_dir), types)
    return found.select("role", "node", "confidence", "depth", F.concat_ws(">", "path").alias("path"))


@query(f"""with recursive {_LINKS},
up(node, ancestor, depth) as (select child, parent, 1 from links union select u.node, l.parent, u.depth + 1 from up u join links l on l.child = u.ancestor)
select node, ancestor, min(depth)::int as depth from up group by 1, 2""")
def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ancestor_closure(_parents(spark, sf_dir).select(F.col("child").alias("src"), F.col("parent").alias("dst")))


@query("""select 'c' || c_custkey as node, 'c' || c_custkey || ' → n' || n_nationkey || ' → r' || n_regionkey as chain from customer join nation on c_nationkey = n_nationkey
union all select 's' || s_suppkey, 's' || s_suppkey || ' → n' || n_nationkey || ' → r' || n_regionkey from supplier join nation on s_nationkey = n_nationkey
union all select 'n' || n_nationkey, 'n' || n_nationkey || ' → r' || n_regionkey from nation""")
def superclass_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.chain_text(ancestor_closure(spark, sf_dir))


def _supply(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst"),
                    F.lit("launches").alias("kind"), F.lit("order").alias("via"), F.lit(1).alias("line"), F.lit(3).alias("rank")).unionByName(
        li.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"),
                  F.lit("uses").alias("kind"), F.lit("line").alias("via"), F.col("l_linenumber").alias("line"), F.when(F.col("l_discount") > 0.05, 2).otherwise(3).alias("rank")))


@query("""with a as (
  select 'o' || l_orderkey as src, 's' || l_suppkey as dst, l_linenumber as line, case when l_discount > 0.05 then 2 else 3 end as rank from lineitem),
oa as (select src, dst, rank, row_number() over (partition by src order by dst, line, rank desc) as ord from a),
ca as (select 'c' || o_custkey as src, 'o' || o_orderkey as dst, row_number() over (partition by o_custkey order by 'o' || o_orderkey) as ord from orders),
p as (select ca.src as entry, oa.dst as target, oa.rank as confidence, ca.dst as mid, ca.ord as o1, oa.ord as o2
  from ca join oa on ca.dst = oa.src join supplier on oa.dst = 's' || s_suppkey where s_acctbal < 0),
k1 as (select * from (select *, row_number() over (partition by entry, mid, target order by o1, o2) as k from p) where k = 1),
k2 as (select * exclude (k) from (select * exclude (k), row_number() over (partition by entry, target order by o1, o2) as k from k1) where k <= 3),
k3 as (select * exclude (k) from (select *, row_number() over (partition by entry order by o1, o2) as k from k2) where k <= 30)
select entry, target, 2::int as length, confidence::int as confidence, entry || '>' || mid || '>' || target as nodes,
  row_number() over (partition by entry order by confidence desc, target, mid)::int as n from k3""")
def path_search_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("entry"))
    targets = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("target"))
    return graph.search_paths(_supply(spark, sf_dir), entries, targets, 3).withColumn("nodes", F.concat_ws(">", "nodes"))


@query("""with e as (select 'c' || o_custkey as src, 'o' || o_orderkey as dst from orders union all select 'o' || l_orderkey, 's' || l_suppkey from lineitem),
b as (select src as x, dst as y from e union select dst, src from e),
d1 as (select distinct y as node from b where x = 's1' and y <> 's1'),
d2 as (select distinct y as node from b where x in (select node from d1) and y <> 's1' and y not in (select node from d1)),
n as (select 's1' as node, 0 as depth union all select node, 1 from d1 union all select node, 2 from d2),
k as (select node, depth from n order by depth, node limit 300)
select depth::int as depth, count(*) as nodes, min(node) as first, max(node) as last from k group by depth""")
def neighborhood_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = graph.neighbourhood(_supply(spark, sf_dir), spark.sql("select 's1' as node"), 2)
    return nodes.groupBy("depth").agg(F.count("*").alias("nodes"), F.min("node").alias("first"), F.max("node").alias("last"))


@query("""select p1.p_brand as a, p2.p_type as b, count(*) as links from lineitem join part p1 on l_partkey = p1.p_partkey join part p2 on l_suppkey = p2.p_partkey
where p1.p_brand <> p2.p_type group by 1, 2""")
def package_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("b"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("dst"))
    p = table(spark, sf_dir, "part")
    groups = p.select(F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_brand").alias("grp")).unionByName(
        p.select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_type").alias("grp")))
    return graph.group_links(edges, groups)


@query("""with e as (select distinct 'o' || l_orderkey as src, 'p' || l_partkey as dst from lineitem)
select dst as node, count(*) as degree from e group by 1 order by degree desc, node limit 20""")
def degree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct()
    return graph.degrees(e).filter(F.col("node").startswith("p")).orderBy(F.desc("degree"), "node").limit(20)


@query("""with w as (select distinct unnest(string_split(p_name, ' ')) as name from part),
c as (select name, 1 as priority, p_brand as target from w join part on p_name = name union all
  select w.name, 2, p_brand from w join part on string_split(p_name, ' ')[1] = w.name union all
  select w.name, 3, p_type from w join part on contains(string_split(p_name, ' '), w.name)),
l as (select name, priority, min(target) as target, count(distinct target) as n from c group by 1, 2),
b as (select name, arg_min(target, priority) as target, arg_min(n, priority) as n from l group by 1)
select w.name, case when n = 1 then target end as target, case when n is null then 'unresolved' when n = 1 then 'resolved' else 'ambiguous' end as status
from w left join b on w.name = b.name""")
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    words = p.select("p_name", "p_brand", "p_type", F.split("p_name", " ").alias("ws"))
    wanted = words.select(F.explode("ws").alias("name")).distinct()
    c = words.select(F.col("p_name").alias("name"), F.lit(1).alias("priority"), F.col("p_brand").alias("target")).unionByName(
        words.select(F.col("ws")[0].alias("name"), F.lit(2).alias("priority"), F.col("p_brand").alias("target"))).unionByName(
        words.select(F.explode("ws").alias("name"), F.lit(3).alias("priority"), F.col("p_type").alias("target")))
    return lookup.resolve(wanted, c.join(wanted, "name", "left_semi"))


_TOKEN = r'token\s*=\s*"([0-9a-f]{40})"'


@query("""with m as (select doc_id, unnest(regexp_extract_all(text, 'token\\s*=\\s*"([0-9a-f]{40})"', 1)) as v, generate_subscripts(regexp_extract_all(text, 'token\\s*=\\s*"([0-9a-f]{40})"', 1), 1) as n from documents)
select doc_id, n::int as n, v[1:4] || '…[' || length(v) || ' chars]' as value, 'high' as confidence from m""")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.matches(table(spark, sf_dir, "documents"), ["doc_id"], "text", _TOKEN, "secret-known-format", 1)
    return found.select("doc_id", "n", S.masked(F.col("value")).alias("value"), F.lit("high").alias("confidence"))


_MAIL = r"[a-z0-9.]+@[a-z0-9.]+\.[a-z]+"


@query(f"""with m as (select doc_id, unnest(regexp_extract_all(text, '{_MAIL}')) as value, generate_subscripts(regexp_extract_all(text, '{_MAIL}'), 1) as n from documents)
select doc_id, 'mail' as rule, n::int as n, value from m where n <= 20""")
def pii_rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.matches(table(spark, sf_dir, "documents"), ["doc_id"], "text", _MAIL, "mail")
    return rules.capped(found, ["rule", "doc_id"], ["n"])


@query("""with t as (select distinct unnest(regexp_extract_all(text, '[0-9A-Za-z]{32,}')) as token from documents)
select token, round(entropy(string_split(token, '')), 6) as entropy from t""".replace("round(entropy(string_split(token, '')), 6)", "round((select entropy(c) from unnest(string_split(token, '')) u(c)), 6)"))
def entropy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.matches(table(spark, sf_dir, "documents"), ["doc_id"], "text", "[0-9A-Za-z]{32,}", "token")
    return found.select(F.col("value").alias("token")).distinct().withColumn("entropy", F.round(S.shannon_entropy(F.col("token")), 6))


@query("""select page_id, url, 'medium' as confidence, 'info' as severity from pages where regexp_matches(url, '^http://') and not starts_with(url, 'http://schemas.')""")
def cleartext_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").filter(F.col("url").rlike("^http://") & ~F.col("url").startswith("http://schemas."))
    return p.select("page_id", "url", F.lit("medium").alias("confidence"), F.lit("info").alias("severity"))


@query("""select l_returnflag, count(*) filter (l_discount < 0.03) as info, count(*) filter (l_discount >= 0.03 and l_discount < 0.06) as low,
count(*) filter (l_discount >= 0.06 and l_discount < 0.09) as medium, count(*) filter (l_discount >= 0.09) as high from lineitem group by 1""")
def rule_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_discount")
    f = table(spark, sf_dir, "lineitem").withColumn("severity", F.when(d < 0.03, "info").when(d < 0.06, "low").when(d < 0.09, "medium").otherwise("high"))
    return rules.severity_counts(f, ["l_returnflag"], S.SEVERITIES)


@query("""select l_orderkey, l_linenumber, (case when l_returnflag = 'R' then 0 when l_returnflag = 'A' then case when l_linestatus = 'F' then 3 else 0 end else least(case when l_linestatus = 'F' then 3 else 2 end, 1) end)::int as confidence
from lineitem where not (l_returnflag = 'R' or (l_returnflag = 'A' and l_linestatus <> 'F'))""")
def three_valued_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an argument that is a string for A and R, and an identifier (unknown) for N
    arg = F.struct(F.when(F.col("l_returnflag") == "N", "identifier").otherwise("string").alias("kind"), F.col("l_returnflag").alias("sval"), F.lit(None).cast("long").alias("ival"), F.lit(None).cast("boolean").alias("bval"), F.lit(None).cast("string").alias("text"))
    other = F.struct(F.when(F.col("l_returnflag") == "N", "identifier").otherwise("string").alias("kind"), F.col("l_linestatus").alias("sval"), F.lit(None).cast("long").alias("ival"), F.lit(None).cast("boolean").alias("bval"), F.lit(None).cast("string").alias("text"))
    receiver = F.when(F.col("l_linestatus") == "F", 3).otherwise(2)
    li = table(spark, sf_dir, "lineitem").withColumn("arg", arg).withColumn("other", other)
    c = rules.combined(receiver, [rules.check(F.col("arg"), "equals", "A"), rules.check(F.col("other"), "equals", "F")])
    return li.select("l_orderkey", "l_linenumber", c.cast("int").alias("confidence")).filter("confidence > 0")


_ATTRIBUTES = """a as (select o_orderkey, case o_orderkey % 4 when 0 then 'provider' when 1 then 'service' else 'activity' end as kind,
  case o_orderstatus when 'F' then 'true' when 'O' then null when 'P' then '@bool/x' end as attribute,
  (o_orderkey % 3)::int as filters, case when o_orderkey % 5 = 0 then null else (14 + o_orderkey % 20)::int end as target, case when o_orderkey % 7 = 0 then null else (10 + o_orderkey % 25)::int end as min_sdk,
  case when o_custkey % 3 = 0 then true when o_custkey % 3 = 1 then false end as res,
  case when o_orderpriority like '1%' then 'signature' when o_orderpriority like '2%' then 'normal' when o_orderpriority like '3%' then null else 'none' end as lvl from orders)"""


@query(f"""with {_ATTRIBUTES},
b as (select *, coalesce(target, min_sdk, 1) as sdk, lvl is distinct from 'none' as has_permission from a),
c as (select *, case when kind = 'provider' then sdk < 17 else filters > 0 end as implicit from b),
d as (select *, case when attribute = 'true' then 'true' when attribute is not null then 'unknown' when kind = 'provider' then case when sdk < 17 then 'true' else 'false' end
    when filters > 0 and sdk >= 31 then 'inconsistent' when filters > 0 then 'true' else 'false' end as exported,
  case when attribute = 'true' then null when attribute is not null then coalesce(res, implicit) when kind <> 'provider' and filters > 0 and sdk >= 31 and min_sdk < 31 then true end as guess,
  case when not has_permission then 0 when lvl is null then 1 when lvl = 'normal' then 2 else 9 end as rnk from c),
e as (select *, exported in ('unknown', 'inconsistent') as unsure from d),
f as (select *, case when unsure then coalesce(guess, false) else exported = 'true' end as eff from e)
select o_orderkey, exported, guess, case when attribute = 'true' then 'high' when attribute is not null or exported = 'inconsistent' then 'low' when target is not null then 'high' else 'medium' end as confidence,
  (case when eff then case when rnk = 0 then 0 when rnk < 9 then 1 else 2 end + case when unsure then 3 else 0 end when unsure then 6 else 7 end)::int as exposure from f""")
def export_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    a = o.select(
        "o_orderkey", F.when(k % 4 == 0, "provider").when(k % 4 == 1, "service").otherwise("activity").alias("kind"),
        F.when(F.col("o_orderstatus") == "F", "true").when(F.col("o_orderstatus") == "P", "@bool/x").alias("attribute"), (k % 3).cast("int").alias("filters"),
        F.when(k % 5 != 0, (k % 20 + 14).cast("int")).alias("target"), F.when(k % 7 != 0, (k % 25 + 10).cast("int")).alias("min_sdk"),
        F.when(F.col("o_custkey") % 3 == 0, True).when(F.col("o_custkey") % 3 == 1, False).alias("res"),
        F.when(F.col("o_orderpriority").startswith("1"), "signature").when(F.col("o_orderpriority").startswith("2"), "normal").when(F.col("o_orderpriority").startswith("3"), None).otherwise("none").alias("lvl"))
    x = a.withColumn("x", surface.effective_export(F.col("kind"), F.col("attribute"), F.col("filters"), F.col("target"), F.col("min_sdk"), F.col("res")))
    permission = F.when(~F.col("lvl").eqNullSafe("none"), "p")
    rank = surface.level_rank(permission, F.col("lvl"))
    return x.select("o_orderkey", "x.exported", "x.guess", "x.confidence", surface.exposure(F.col("x.exported"), F.col("x.guess"), rank, F.lit("true")).cast("int").alias("exposure"))


@query(r"""with p as (select page_id, regexp_extract(url, '^([a-z]+)://', 1) as scheme, regexp_extract(url, '://([^/]+)', 1) as host, regexp_extract(url, '://[^/]+(/[^/]*)', 1) as path from pages),
h as (select distinct host as grp, host from p), s as (select distinct host as grp, scheme from p), q as (select distinct host as grp, path from p where path <> ''),
x as (select s.grp, scheme, h.host, q.path from s join h on s.grp = h.grp left join q on q.grp = s.grp),
n as (select grp, scheme || '://' || host || coalesce(path, '') as uri, row_number() over (partition by grp order by scheme, host, path nulls first) as n from x)
select grp, uri, n::int as n from n where n <= 50""")
def deep_link_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "://([^/]+)", 1).alias("host"), F.regexp_extract("url", "://[^/]+(/[^/]*)", 1).alias("path"))
    parts = p.groupBy(F.col("host").alias("grp")).agg(F.collect_set("scheme").alias("schemes"), F.collect_set("host").alias("hosts"), F.collect_set(F.when(F.col("path") != "", F.col("path"))).alias("paths"))
    return surface.deep_links(parts, ["grp"])


@query("""select doc_id, coalesce(l.quality, d.n_chars % 3)::bigint as level,
least(case when l.quality is not null then case l.quality when 0 then 1 else 9 end when lang = 'en' then 2 else 0 end, case when l.toxic is not null then case l.toxic when 0 then 3 else 9 end when lang = 'en' then 2 else 0 end)::int as weakest
from documents d left join labels l using (doc_id)""")
def permission_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    read, write = F.col("quality").cast("string"), F.col("toxic").cast("string")
    rank = {"read": F.when(F.col("quality") == 0, 1).otherwise(9), "write": F.when(F.col("toxic") == 0, 3).otherwise(9), "shared": F.lit(2)}
    return j.select("doc_id", F.coalesce(F.col("quality").cast("long"), F.col("n_chars") % 3).alias("level"),
                    surface.weakest_side(read, write, F.when(F.col("lang") == "en", "en"), rank).cast("int").alias("weakest"))


@query("""select count(*) as documents, count(distinct source) as sources, count(*) filter (lang = 'en') as english, count(*) filter (toxic = 1) as toxic, count(*) filter (quality = 0) as poor,
round(avg(case when n_chars <= 200 then 1.0 else 0.0 end), 3) as short_share, max(n_chars) as longest from documents left join labels using (doc_id)""")
def stats_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return j.agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.col("toxic") == 1).alias("toxic"),
                 F.count_if(F.col("quality") == 0).alias("poor"), F.round(F.avg(F.when(F.col("n_chars") <= 200, 1.0).otherwise(0.0)), 3).alias("short_share"), F.max("n_chars").alias("longest"))


@query("""with f as (select p_partkey, p_name, p_brand from part where p_size >= 20 and contains(lower(p_name), 'a'))
select p_partkey, p_name, p_brand, (select count(*) from f) as total from f order by p_partkey limit 50 offset 50""")
def list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").filter((F.col("p_size") >= 20) & F.contains(F.lower("p_name"), F.lit("a"))).select("p_partkey", "p_name", "p_brand")
    return lookup.page(rows, "p_partkey", 1, 50)


@query("""select p_partkey, case when contains(lower(p_name), '1') then 'p_name' when contains(lower(p_brand), '1') then 'p_brand' else 'p_type' end as field,
(case when contains(lower(p_name), '1') then 0 when contains(lower(p_brand), '1') then 1 else 2 end)::int as priority,
case when contains(lower(p_name), '1') then p_name when contains(lower(p_brand), '1') then p_brand else p_type end as text
from part where contains(lower(p_name), '1') or contains(lower(p_brand), '1') or contains(lower(p_type), '1')""")
def search_best_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.best_field(table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_brand", "p_type"], "1")


@query(r"""with h as (select page_id, array_to_string(list_reverse(string_split(regexp_extract(url, '://([^/]+)', 1), '.')), '.') as name from pages)
select page_id, name, starts_with(name, 'com.') or starts_with(name, 'org.') as library from h""")
def library_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "pages").select("page_id", F.array_join(F.reverse(F.split(F.regexp_extract("url", "://([^/]+)", 1), r"\.")), ".").alias("name"))
    return lookup.mark_libraries(h, "name", spark.sql("select explode(array('com.', 'org.')) as prefix"))


_HALVES = ("o_orderdate < timestamp_ntz '1998-04-01 00:00:00'", "o_orderdate >= timestamp_ntz '1998-04-01 00:00:00'")


@query("""with a as (select distinct o_custkey from orders where o_orderdate < timestamp '1998-04-01'), b as (select distinct o_custkey from orders where o_orderdate >= timestamp '1998-04-01')
select o_custkey, 'added' as change from (select * from b except select * from a) union all select o_custkey, 'removed' from (select * from a except select * from b)""")
def set_diff_added_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return diffing.added_removed(o.filter(_HALVES[0]), o.filter(_HALVES[1]), "o_custkey")


@query("""with g as (select o_custkey, o_orderdate < timestamp '1998-04-01' as old, count(*) as orders, max(o_orderpriority) as priority, min(o_orderstatus) as status from orders group by 1, 2),
j as (select a.o_custkey, a.orders::varchar as o1, b.orders::varchar as n1, a.priority as o2, b.priority as n2, a.status as o3, b.status as n3 from g a join g b on a.o_custkey = b.o_custkey and a.old and not b.old)
select o_custkey, 'orders' as field, o1 as old, n1 as new from j where o1 is distinct from n1 union all select o_custkey, 'priority', o2, n2 from j where o2 is distinct from n2
union all select o_custkey, 'status', o3, n3 from j where o3 is distinct from n3""")
def component_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    side = lambda f: o.filter(f).groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("o_orderpriority").alias("priority"), F.min("o_orderstatus").alias("status"))
    return diffing.field_changes(side(_HALVES[0]), side(_HALVES[1]), "o_custkey", ["orders", "priority", "status"])


@query(r"""with d as (select doc_id % 2 as side, sha256(trim(regexp_replace(text, '\s+', ' ', 'g')))[1:12] as identity from documents),
o as (select identity, count(*) as o from d where side = 0 group by 1), n as (select identity, count(*) as n from d where side = 1 group by 1),
j as (select coalesce(o.identity, n.identity) as identity, coalesce(o, 0) as o, coalesce(n, 0) as n from o full join n on o.identity = n.identity)
select identity, greatest(n - o, 0) as added, greatest(o - n, 0) as removed from j where o <> n""")
def finding_multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 2).alias("side"), S.snippet_digest(F.col("text")).alias("identity"))
    return diffing.multiset_difference(d.filter("side = 0"), d.filter("side = 1"), ["identity"])


@query("""with o as (select p_name as key, p_type, p_size from part where p_partkey % 2 = 0), n as (select p_name as key, p_type, p_size from part where p_partkey % 2 = 1),
g as (select * from o where key not in (select key from n)), c as (select * from n where key not in (select key from o)),
g1 as (select p_type, p_size, min(key) as old_key from g group by 1, 2 having count(*) = 1), c1 as (select p_type, p_size, min(key) as new_key from c group by 1, 2 having count(*) = 1)
select old_key, new_key from g1 join c1 using (p_type, p_size)""")
def rename_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("key"), "p_type", "p_size", "p_partkey")
    side = lambda r: p.filter(F.col("p_partkey") % 2 == r).drop("p_partkey")
    return diffing.rename_pairs(side(0), side(1), "key", ["p_type", "p_size"])


@query("""select user_id, array_to_string(list_sort(list(distinct event_type)), ',') as triggers from events group by 1""")
def trigger_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffing.triggers(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("""with d as (select distinct p_brand, p_name from part)
select p_brand, p_name, 'Class' || lpad(row_number() over (partition by p_brand order by p_name)::varchar, 4, '0') as alias from d""")
def anonymize_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.numbered(table(spark, sf_dir, "part"), "p_name", "Class", 4, ["p_brand"])


@query(r"""with h as (select distinct regexp_extract(url, '://([^/]+)', 1) as host from pages)
select host, 'host' || lpad(row_number() over (order by host)::varchar, 6, '0') as alias from h""")
def anonymize_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.numbered(table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("host")), "host", "host", 6)


@query("""select user_id, event_id, event_type from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events) where n <= 3""")
def ranked_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.capped(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], 3).select("user_id", "event_id", "event_type")


@query("""select o_orderkey, o_orderstatus from orders o where not exists (select 1 from lineitem where l_orderkey = o.o_orderkey and l_linestatus = o.o_orderstatus)""")
def incremental_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("o_orderstatus")).distinct()
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(cache, ["o_orderkey", "o_orderstatus"], "left_anti")


@query("""select s_suppkey, case when s_acctbal < 0 then 'low' when s_acctbal < 5000 then 'medium' else 'high' end as confidence, regexp_replace(s_name, '#', '') as cell from supplier""")
def confidence_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    rank = F.when(F.col("s_acctbal") < 0, 1).when(F.col("s_acctbal") < 5000, 2).otherwise(3)
    return s.select("s_suppkey", S.name_of(rank, S.CONFIDENCES, 1).alias("confidence"), S.table_cell(F.regexp_replace("s_name", "#", "")).alias("cell"))


_CANDIDATES = """f as (select o_orderkey as line, 'c' || o_custkey as class_id, o_orderpriority as rule, o_orderstatus as category,
  case left(o_orderpriority, 1) when '1' then 'high' when '2' then 'medium' when '3' then 'low' else 'info' end as severity,
  case when o_totalprice < 100000 then 'low' when o_totalprice < 200000 then 'medium' else 'high' end as confidence from orders)"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    o, p, price = table(spark, d, "orders"), F.substring("o_orderpriority", 1, 1), F.col("o_totalprice")
    severity = F.when(p == "1", "high").when(p == "2", "medium").when(p == "3", "low").otherwise("info")
    return o.select(F.col("o_orderkey").alias("line"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("class_id"), F.col("o_orderpriority").alias("rule"), F.col("o_orderstatus").alias("category"),
                    severity.alias("severity"), F.when(price < 100000, "low").when(price < 200000, "medium").otherwise("high").alias("confidence"))


@query(f"""with {_CANDIDATES} select class_id, line, rule, severity, confidence from f where severity in ('medium', 'high') and confidence in ('medium', 'high') and category = 'F'
order by case severity when 'high' then 0 else 1 end, class_id, line, rule limit 500""")
def finding_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.listed_findings(_candidates(spark, sf_dir), "medium", "medium", "F").select("class_id", "line", "rule", "severity", "confidence")


@query(f"""with recursive {_LINKS}, up(node, root, n) as (select child, parent, 1 from links union all select u.node, l.parent, n + 1 from up u join links l on l.child = u.root)
select node, arg_max(root, n) as root from up group by node""")
def root_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.root_class(_parents(spark, sf_dir).select(F.col("child").alias("src"), F.col("parent").alias("dst")))


@query(f"""with {_LINKS}, e as (select child as src, parent as dst from links), s as (select 'n3' as node),
a as (select src as node, 1 as depth from e where dst = 'n3'), g as (select node, count(*) as degree from (select src as node from e union all select dst from e) group by node),
x as (select node, 0 as depth from s union all select * from a)
select x.node, depth::int as depth, degree from x join g on g.node = x.node order by depth > 0, degree desc, x.node limit 600""")
def focus_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _parents(spark, sf_dir).select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    return overview.focus(edges, spark.createDataFrame([("n3",)], "node string"), "children")


@query("""select 'o' || o_custkey as project, o_orderpriority as flag, min(case when o_orderstatus = 'F' then 'true' else 'false' end) as old, max(case when o_orderstatus = 'F' then 'true' else 'false' end) as new, true as highlight
from orders group by 1, 2 having count(distinct o_orderstatus = 'F') = 2""")
def flag_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    v = F.when(F.col("o_orderstatus") == "F", "true").otherwise("false")
    side = lambda agg: o.groupBy(F.concat(F.lit("o"), F.col("o_custkey").cast("string")).alias("project"), F.col("o_orderpriority").alias("flag")).agg(agg(v).alias("value"))
    return overview.flag_changes(side(F.min), side(F.max))


@query("""select coalesce(a.p, b.p) as project, case when a.p is null then 'added' else 'removed' end as change
from (select distinct o_custkey::varchar as p from orders where o_orderstatus = 'F') a full join (select distinct o_custkey::varchar as p from orders where o_orderstatus = 'O') b on a.p = b.p where a.p is null or b.p is null""")
def manifest_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda s: table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").cast("string").alias("project"))
    return overview.presence(side("F"), side("O"))


@query("""select to_json({'r_regionkey': r_regionkey, 'r_name': r_name})::varchar as value from region""")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.json_rows(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))


@query(r"""select p_partkey, substr(replace(regexp_replace(p_name || case when p_partkey % 3 = 0 then ' | a' || chr(10) || 'b' else '' end || case when p_partkey % 5 = 0 then repeat('x', 200) else '' end, '[\r\n]+', ' ', 'g'), '|', '\|'), 1, 160) as cell from part""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " | a\nb").otherwise(""), F.when(F.col("p_partkey") % 5 == 0, F.repeat(F.lit("x"), 200)).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", S.table_cell(text).alias("cell"))


@query(r"""with t as (select p_partkey, md5(p_name) || upper(left(md5(p_brand), 12)) || case when p_partkey % 4 = 0 then ' x' else '' end as t from part where p_size >= 32),
n as (select p_partkey, t, length(t)::double as n, unnest(list_distinct(string_split(t, ''))) as c from t),
e as (select p_partkey, any_value(t) as t, -sum((n - length(replace(t, c, ''))) / n * log2((n - length(replace(t, c, ''))) / n)) as e from n group by p_partkey)
select p_partkey, regexp_matches(t, '[a-z]') and regexp_matches(t, '[A-Z]') and regexp_matches(t, '[0-9]') and not regexp_matches(t, '\s') and length(t) between 32 and 256 and e >= 4.0 as hit from e""")
def high_entropy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.md5("p_name"), F.upper(F.substring(F.md5("p_brand"), 1, 12)), F.when(F.col("p_partkey") % 4 == 0, " x").otherwise(""))
    return table(spark, sf_dir, "part").filter("p_size >= 32").select("p_partkey", rules.high_entropy(t).alias("hit"))


@query("""with o as (select 'k' || c_custkey as name, c_name || '/' || c_acctbal::decimal(18,2)::varchar as shape, c_custkey from customer),
n as (select case when c_custkey % 2 = 0 then name else 'r' || c_custkey end as name, shape from o where c_custkey % 3 <> 0),
gone as (select shape, min(name) as name from o where name not in (select name from n) group by shape having count(*) = 1),
come as (select shape, min(name) as name from n where name not in (select name from o) group by shape having count(*) = 1)
select gone.name as old_key, come.name as new_key from gone join come on gone.shape = come.shape""")
def rename_pairs_by_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    old = table(spark, sf_dir, "customer").select(F.concat(F.lit("k"), k.cast("string")).alias("name"), F.concat_ws("/", "c_name", F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("shape"), k)
    new = old.filter(k % 3 != 0).select(F.when(k % 2 == 0, F.col("name")).otherwise(F.concat(F.lit("r"), k.cast("string"))).alias("name"), "shape")
    return diffing.rename_pairs(old.drop("c_custkey"), new, "name", ["shape"])
