"""The registered queries of the graph and analytics operators, each with SQL that checks it where SQL can.

A query applies an operator to graphs and tables derived from the star schema (``plans.derive``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from ..operators import changes, community, dataflow, quality, retrieval, rules, similarity, traverse
from ..operators.components import components
from ..operators.pattern import Pattern
from ..sources import files
from ..storage import delete
from ..streaming import windows
from . import derive as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WORDS = ["the", "and", "of"]
#: The vector that vector queries look for: made by a rule, of the width of the table.
PROBE = [((k * 37) % 19 - 9) / 10 for k in range(64)]


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _with(*parts: str, recursive: bool = False) -> str:
    return ("with recursive " if recursive else "with ") + ", ".join(p.strip() for p in parts) + " "


SUPPLY, COPART, COPART2 = _with(D.SUPPLY_SQL), _with(D.COPART_SQL), _with(D.COPART2_SQL)


# Scans and predicates


@query(SUPPLY + "select id, label, name, complexity from nodes where label in ('Function', 'Class') and (complexity between 10 and 30 or complexity is null) and name ilike '%r%'")
def node_scan_filter(spark, sf):
    return D.supply(spark, sf).scan(["Function", "Class"], "*r*", F.col("complexity").between(10, 30) | F.col("complexity").isNull()).select("id", "label", "name", "complexity")


@query("select p_partkey, p_name ilike 'red%' as anchored, coalesce(regexp_matches(p_name, '(?i)r.*g'), false) as loose, contains(p_name, 'blue') as part from part")
def glob_match(spark, sf):
    n = F.col("p_name")
    return D.table(spark, sf, "part").select("p_partkey", P.glob(n, "red*").alias("anchored"), P.loose_glob(n, "r*g").alias("loose"), P.path_glob(n, "blue").alias("part"))


@query("select page_id, regexp_matches(url, '/[^/]*/[0-9]+') as one_level, regexp_matches(url, 'example.*page') as deep from pages")
def path_patterns(spark, sf):
    u = F.col("url")
    return D.table(spark, sf, "pages").select("page_id", F.coalesce(u.rlike("/[^/]*/[0-9]+"), F.lit(False)).alias("one_level"), P.path_glob(u, "example**page").alias("deep"))


@query(
    """select p_partkey, p_size > 25 as over, p_size between 10 and 20 as inside, contains(lower(p_name), 'ring') as has, starts_with(lower(p_name), 'small') as starts,
    suffix(lower(p_name), 'widget') as ends, regexp_matches(p_brand, '#[12]$') as re, p_type in ('PROMO', 'LARGE') as listed, p_name is null as missing from part"""
)
def cypher_predicates(spark, sf):
    n = F.col("p_name")
    return D.table(spark, sf, "part").select(
        "p_partkey",
        P.number_compare(F.col("p_size"), ">", 25).alias("over"),
        F.col("p_size").between(10, 20).alias("inside"),
        P.contains(n, "RING").alias("has"),
        P.starts_with(n, "Small").alias("starts"),
        P.ends_with(n, "WIDGET").alias("ends"),
        P.regex(F.col("p_brand"), "#[12]$").alias("re"),
        F.col("p_type").isin("PROMO", "LARGE").alias("listed"),
        n.isNull().alias("missing"),
    )


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events where cast(json_extract(props, '$.k') as bigint) > 50")
def props_json(spark, sf):
    k = F.variant_get(F.parse_json("props"), "$.k", "bigint")
    return D.table(spark, sf, "events").select("event_id", k.alias("k")).where("k > 50")


@query("select event_id, 'k' as key, cast(json_extract(props, '$.k') as varchar) as value from events")
def json_flatten(spark, sf):
    return files.json_entries(D.table(spark, sf, "events"), "event_id", "props", 2).select(F.col("id").alias("event_id"), "key", "value")


@query("select o_orderkey, o_totalprice from orders order by lower(o_orderpriority), o_totalprice desc, o_orderkey limit 50 offset 10")
def order_page(spark, sf):
    return D.table(spark, sf, "orders").orderBy(F.lower("o_orderpriority"), F.desc("o_totalprice"), "o_orderkey").offset(10).limit(50).select("o_orderkey", "o_totalprice")


# Expansion and patterns


@query(SUPPLY + "select e.src as id, e.type, e.dst as neighbour from nodes n join edges e on e.src = n.id where n.label = 'Class'")
def edge_expand_out(spark, sf):
    g = D.supply(spark, sf)
    return g.expand(g.scan(["Class"]).select("id"))


@query(SUPPLY + "select e.dst as id, e.type, e.src as neighbour from nodes n join edges e on e.dst = n.id where n.label = 'Interface' and e.type = 'IMPLEMENTS'")
def edge_expand_in(spark, sf):
    g = D.supply(spark, sf)
    return g.expand(g.scan(["Interface"]).select("id"), ["IMPLEMENTS"], "in")


@query(SUPPLY + "select n.id, e.type, e.dst as neighbour from nodes n join edges e on e.src = n.id where n.label = 'Package' union all select n.id, e.type, e.src from nodes n join edges e on e.dst = n.id where n.label = 'Package'")
def edge_expand_both(spark, sf):
    g = D.supply(spark, sf)
    return g.expand(g.scan(["Package"]).select("id"), None, "both")


@query(SUPPLY + "select a.id as a_id, b.name as b_name, e.weight from nodes a join edges e on e.src = a.id join nodes b on b.id = e.dst where a.label = 'Method' and b.label = 'Function' and e.type = 'CALLS' and b.complexity > 40")
def pattern_one_hop(spark, sf):
    return Pattern(D.supply(spark, sf)).node("a", "Method").hop("CALLS").node("b", "Function").where("b.complexity > 40").select("a.id as a_id", "b.name as b_name", "a_b.weight as weight")


@query(SUPPLY + "select a.name as customer, count(*) as n from nodes o join edges m on m.src = o.id and m.type = 'MEMBER_OF' join nodes a on a.id = m.dst join edges b on b.src = a.id and b.type = 'BELONGS_TO' join nodes p on p.id = b.dst where o.label = 'Method' and p.label = 'Package' group by a.name")
def pattern_two_hop(spark, sf):
    return Pattern(D.supply(spark, sf)).node("o", "Method").hop("MEMBER_OF").node("a", "Class").hop("BELONGS_TO").node("p", "Package").select("a.name as customer", "count(o.id) as n")


@query(
    _with(D.COPART2_SQL, "w as (select src as a, dst as b, 1 as hops, [struct_pack(s := src, d := dst)] as walk from copart2 where src < 20 union all select a, dst, hops + 1, list_append(walk, struct_pack(s := src, d := dst)) from w join copart2 on src = b where hops < 3 and not list_contains(walk, struct_pack(s := src, d := dst)))", recursive=True)
    + "select a, b, cast(hops as integer) as hops from w"
)
def pattern_var_length(spark, sf):
    return Pattern(D.copart2(spark, sf)).node("a").where("a.id < 20").hop("CALLS", low=1, high=3).node("b").select("a.id as a", "b.id as b", "a_b.hops as hops")


@query(SUPPLY + "select a.id as id, count(b.id) as n from nodes a left join (select e.src, b.id from edges e join nodes b on b.id = e.dst where b.label = 'Interface' and e.type = 'IMPLEMENTS') b on b.src = a.id where a.label = 'Function' group by a.id")
def pattern_optional(spark, sf):
    return Pattern(D.supply(spark, sf)).node("a", "Function").hop("IMPLEMENTS", optional=True).node("b", "Interface").select("a.id as id", "count(b.id) as n")


@query(SUPPLY + "select name from nodes where label = 'Project' union select name from nodes where label = 'Package'")
def pattern_union(spark, sf):
    g = D.supply(spark, sf)
    return Pattern(g).node("a", "Project").select("a.name as name").union(Pattern(g).node("a", "Package").select("a.name as name")).distinct()


@query(SUPPLY + "select file_path as brand, count(*) as n, cast(sum(complexity) as bigint) as total, round(avg(complexity), 6) as mean, min(complexity) as low, max(complexity) as high from nodes where label = 'Function' group by file_path")
def pattern_agg(spark, sf):
    out = Pattern(D.supply(spark, sf)).node("a", "Function").select("a.file_path as brand", "count(a.id) as n", "sum(a.complexity) as total", "avg(a.complexity) as mean", "min(a.complexity) as low", "max(a.complexity) as high")
    return out.withColumn("mean", F.round("mean", 6))


# Statistics and integrity


@query(SUPPLY + "select label, count(*) as n from nodes group by label")
def label_stats(spark, sf):
    return D.supply(spark, sf).label_stats()


@query(SUPPLY + "select type, count(*) as n from edges group by type")
def type_stats(spark, sf):
    return D.supply(spark, sf).type_stats()


@query(
    SUPPLY
    + """select (select count(*) from nodes) as nodes, (select count(*) from edges) as edges, round((select count(*) from edges) / (select count(*) from nodes), 6) as density,
    min(complexity) as low, max(complexity) as high, round(avg(complexity), 6) as mean, (select complexity from (select complexity, row_number() over (order by complexity) as r, count(*) over () as n from nodes where complexity > 0) where r = n // 2 + 1) as median
    from nodes where complexity > 0"""
)
def graph_stats(spark, sf):
    return D.supply(spark, sf).stats()


@query(SUPPLY + "select id, count(*) as degree from (select src as id from edges union all select dst from edges) group by id order by degree desc, id limit 25")
def degree_topk(spark, sf):
    return D.supply(spark, sf).degree().orderBy(F.desc("degree"), "id").limit(25)


@query(SUPPLY + "select label, name, count(*) as n, list_sort(list(id)) as ids from nodes where name <> '' group by label, name having count(*) > 1")
def duplicate_keys(spark, sf):
    return D.supply(spark, sf).duplicate_names()


def _faulty(spark, sf):
    g = D.supply(spark, sf)
    nodes = g.nodes.where("label <> 'Function' or id % 7 <> 0").withColumn("name", F.when(F.col("id") % 11 == 0, "").otherwise(F.col("name")))
    return D.PropertyGraph(nodes, g.edges)


FAULTY = _with(D.SUPPLY_SQL, "bad as (select id, label, case when id % 11 = 0 then '' else name end as name from nodes where label <> 'Function' or id % 7 <> 0)")


@query(FAULTY + "select distinct src, dst, type from edges where src not in (select id from bad) or dst not in (select id from bad)")
def orphan_edges(spark, sf):
    return _faulty(spark, sf).orphan_edges()


@query(
    FAULTY
    + """select 'duplicate_name' as issue, count(*) as n from (select 1 from bad where name <> '' group by label, name having count(*) > 1)
    union all select 'missing_name', count(*) from bad where name is null or name = ''
    union all select 'orphan_edge', count(*) from (select distinct src, dst, type from edges where src not in (select id from bad) or dst not in (select id from bad))"""
)
def integrity(spark, sf):
    return _faulty(spark, sf).integrity()


@query(SUPPLY + "select e.src, e.dst, e.type, e.weight from edges e where e.src in (select id from nodes where label in ('Function', 'Interface') ) and e.dst in (select id from nodes where label in ('Function', 'Interface'))")
def induced_subgraph(spark, sf):
    g = D.supply(spark, sf)
    return g.induced(g.scan(["Function", "Interface"])).select("src", "dst", "type", "weight")


@query(SUPPLY + "select id, label from nodes where id not in (select dst from edges where type in ('CALLS', 'MEMBER_OF', 'IMPLEMENTS'))")
def root_nodes(spark, sf):
    return D.supply(spark, sf).roots(["CALLS", "MEMBER_OF", "IMPLEMENTS"]).select("id", "label")


@query(SUPPLY + "select id, label from nodes where label = 'Class' and id in (select src from edges where type = 'BELONGS_TO' union select dst from edges where type = 'MEMBER_OF')")
def prune_isolated(spark, sf):
    g = D.supply(spark, sf)
    return D.PropertyGraph(g.scan(["Class"]), g.hops(["BELONGS_TO", "MEMBER_OF"])).prune_isolated([]).select("id", "label")


@query(
    SUPPLY
    + """select id, cast(sum(s) as bigint) as score, case when sum(s) >= 30 then 'high' when sum(s) >= 15 then 'medium' else 'low' end as risk
    from (select src as id, case type when 'CALLS' then 1 when 'IMPLEMENTS' then 2 else 0 end as s from edges union all select dst, case type when 'CALLS' then 1 when 'IMPLEMENTS' then 2 else 0 end from edges)
    group by id having sum(s) >= 10 order by score desc, id limit 20"""
)
def hotspots(spark, sf):
    weight = F.when(F.col("type") == "CALLS", 1).when(F.col("type") == "EXTENDS", 3).when(F.col("type") == "IMPLEMENTS", 2).otherwise(0)
    ends = D.supply(spark, sf).edges.select(F.explode(F.array("src", "dst")).alias("id"), weight.alias("s"))
    score = ends.groupBy("id").agg(F.sum("s").alias("score")).where("score >= 10")
    return score.withColumn("risk", S.ladder(F.col("score"), [(30, "high"), (15, "medium")], "low")).orderBy(F.desc("score"), "id").limit(20)


@query(
    SUPPLY
    + """select id, rule, n, case when rule = 'extract' and n > 20 or rule = 'decouple' and n > 30 then 'high' else 'medium' end as severity from (
    select src as id, 'extract' as rule, count(*) as n from edges where type = 'CALLS' group by src having count(*) > 6
    union all select dst, 'decouple', count(*) from edges where type = 'CALLS' group by dst having count(*) > 25)"""
)
def refactor_candidates(spark, sf):
    calls = D.supply(spark, sf).hops(["CALLS"])
    out = calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).where("n > 6").select("id", F.lit("extract").alias("rule"), "n")
    into = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).where("n > 25").select("id", F.lit("decouple").alias("rule"), "n")
    return out.unionByName(into).withColumn("severity", F.when(((F.col("rule") == "extract") & (F.col("n") > 20)) | ((F.col("rule") == "decouple") & (F.col("n") > 30)), "high").otherwise("medium"))


@query(SUPPLY + "select b, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 4) as share from (select case when count(*) <= 5 then '1-5' when count(*) <= 10 then '6-10' when count(*) <= 20 then '11-20' when count(*) <= 50 then '21-50' else '50+' end as b from (select src as id from edges union all select dst from edges) group by id) group by b")
def degree_distribution(spark, sf):
    d = F.col("degree")
    bucket = F.when(d <= 5, "1-5").when(d <= 10, "6-10").when(d <= 20, "11-20").when(d <= 50, "21-50").otherwise("50+")
    counts = D.supply(spark, sf).degree().groupBy(bucket.alias("b")).agg(F.count("*").alias("n"))
    return counts.crossJoin(counts.agg(F.sum("n").alias("all"))).select("b", "n", F.round(100.0 * F.col("n") / F.col("all"), 4).alias("share"))


# Traversal

BFS_SQL = "b as (select cast({seed} as bigint) as id, 0 as d union select dst, d + 1 from b join {edges} on src = id where d < {depth})"


def _seed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


@query(_with(D.COPART_SQL, BFS_SQL.format(seed=1, edges="copart", depth=6), recursive=True) + "select id, cast(min(d) as integer) as distance from b group by id")
def bfs_distance(spark, sf):
    return traverse.bfs(D.copart(spark, sf).hops(), _seed(spark, 1), 6).select("id", "distance")


@query(_with(D.COPART_SQL, BFS_SQL.format(seed=1, edges="(select dst as src, src as dst from copart)", depth=3), recursive=True) + "select id, cast(min(d) as integer) as distance, 'CALLS' as relation from b where id <> 1 group by id having min(d) > 0")
def reverse_impact(spark, sf):
    return traverse.reverse_impact(D.copart(spark, sf).hops(), _seed(spark, 1), 3, ["CALLS", "IMPLEMENTS", "EXTENDS", "MEMBER_OF"])


@query(_with(D.COPART_SQL, BFS_SQL.format(seed=1, edges="(select src, dst from copart union select dst, src from copart)", depth=10), recursive=True) + "select cast(min(d) as integer) as hops, cast(min(d) + 1 as integer) as nodes from b where id = 7 having min(d) is not null")
def shortest_path(spark, sf):
    return traverse.shortest_path(D.copart(spark, sf).hops(None, "both"), 1, 7, 10).select("hops", F.size("path").alias("nodes"))


@query(_with(D.COPART_SQL, BFS_SQL.format(seed=2, edges="copart", depth=5), recursive=True) + "select id, cast(min(d) as integer) as distance, cast(least(100, greatest(0, 100 - 15 * min(d) + 10)) as integer) as score from b where id <> 2 group by id")
def flow_search_score(spark, sf):
    e = D.copart(spark, sf).hops()
    return traverse.flow_scores(traverse.bfs(e, _seed(spark, 2), 5), e, {"CALLS": 10, "DATA_FLOWS": 5, "IMPORTS": -5})


@query(
    _with(D.COPART2_SQL, "p as (select [cast(p_partkey as bigint)] as path, cast(p_partkey as bigint) as last, false as ended from part where p_partkey in (3, 5) union all select list_append(path, dst), dst, dst in (select p_partkey from part where p_type = 'PROMO') from p join copart2 on src = last where not ended and len(path) < 6 and not list_contains(path, dst))", recursive=True)
    + "select path, cast(len(path) - 1 as integer) as hops from p where ended"
)
def simple_paths_taint(spark, sf):
    sinks = D.table(spark, sf, "part").where("p_type rlike '^PROMO$'").select(F.col("p_partkey").alias("id"))
    return traverse.simple_paths(D.copart2(spark, sf).hops(), _seed(spark, 3, 5), sinks, 6)


@query(
    _with("e as (select user_id, k, k2 from (select user_id, cast(json_extract(props, '$.k') as bigint) as k, lead(cast(json_extract(props, '$.k') as bigint)) over (partition by user_id order by ts, event_id) as k2 from events) where k2 is not null and k <> k2)", "u as (select k as a, k2 as b from e union select k2, k from e)", "r as (select a as id, a as c from u union select u.b, r.c from r join u on u.a = r.id)", recursive=True)
    + "select id, min(c) as component from r group by id"
)
def connected_components(spark, sf):
    k = F.variant_get(F.parse_json("props"), "$.k", "bigint")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    links = D.table(spark, sf, "events").select(k.alias("a"), F.lead(k).over(w).alias("b"))
    return components(links)


@query(COPART + "select x.src as a, x.dst as b from copart x join copart y on x.src = y.dst and x.dst = y.src where x.src < x.dst")
def cycles_2(spark, sf):
    return traverse.two_cycles(D.copart(spark, sf).hops())


@query(
    _with(D.COPART2_SQL, "c as (select [src, dst] as path, src as first, dst as last, false as closed from copart2 where src < dst union all select case when dst = first then path else list_append(path, dst) end, first, dst, dst = first from c join copart2 on src = last where not closed and dst >= first and len(path) <= 4 and (dst = first or not list_contains(path, dst)))", recursive=True)
    + "select path, cast(len(path) as integer) as hops from c where closed and len(path) <= 4"
)
def cycles_bounded(spark, sf):
    return traverse.bounded_cycles(D.copart2(spark, sf).hops(), 4)


@query(
    COPART
    + """, both_ways as (select src, dst, sum(weight) as w from (select src, dst, weight from copart union all select dst, src, weight from copart) group by src, dst),
    t as (select sum(w) as m2 from both_ways), d as (select p_brand as c, sum(w) as k from both_ways join part on p_partkey = src group by p_brand)
    select round((select sum(w) from both_ways join part a on a.p_partkey = src join part b on b.p_partkey = dst where a.p_brand = b.p_brand) / m2 - (select sum((k / m2) * (k / m2)) from d, t), 6) as modularity from t"""
)
def modularity(spark, sf):
    g = D.copart(spark, sf)
    return community.modularity(g.edges, g.nodes.select("id", F.col("file_path").alias("community"))).select(F.round("modularity", 6).alias("modularity"))


@query()
def louvain(spark, sf):
    return community.louvain(D.copart(spark, sf).edges)


@query()
def leiden(spark, sf):
    return community.leiden(D.copart(spark, sf).edges)


# Retrieval


@query(
    "select id, score from (select doc_id as id, cast(score as double) as score from (select doc_id, " + " + ".join(f"case when contains(lower(text), '{w}') then 5 + 3 else (case when contains(lower(source), '{w}') then 2 + 3 else 0 end) end" for w in ("stupid", "src1", "inthe")) + " as score from documents) where score > 0) order by score desc, id limit 30"
)
def fts_weighted(spark, sf):
    return retrieval.top(retrieval.field_search(D.table(spark, sf, "documents"), ["stupid", "src1", "inthe"], {"text": 5, "source": 2}, "doc_id"), 30)


BM25_SQL = """
q as (select unnest(['the', 'and', 'of']) as term),
toks as (select doc_id, list_filter(regexp_split_to_array(lower(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: length(x) > 1) as t from documents),
tf as (select doc_id, term, len(t) as dl, len(list_filter(t, lambda x: x = term)) as f from toks, q),
stat as (select count(*) as n, avg(len(t)) as adl from toks),
df as (select term, count(*) as df from tf where f > 0 group by term),
bm as (select doc_id as id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / adl))) as score from tf join df using (term), stat where f > 0 group by doc_id)
"""
#: The same with the k1 of the normalised score.
BM25_SQL_15 = BM25_SQL.replace("f * 2.2 / (f + 1.2 *", "f * 2.5 / (f + 1.5 *")
#: The index of documents by their files, with sizes and times: written once in a session for each state of a folder; an older state's goes.
_indexes: dict[tuple[str, str], tuple[str, retrieval.Index]] = {}


def _index(spark, sf) -> retrieval.Index:
    docs = D.table(spark, sf, "documents")
    key, state = (spark.sparkContext.applicationId, sf), retrieval.files_state(docs)
    if key not in _indexes or _indexes[key][0] != state:
        if key in _indexes:
            delete(spark, [_indexes[key][1].folder])
        _indexes[key] = (state, retrieval.build_index(docs))
    return _indexes[key][1]


def _bm25(spark, sf, k1: float = 1.2):
    return retrieval.index_search(spark, _index(spark, sf), WORDS, k1)


@query(_with(BM25_SQL) + "select id, round(score, 6) as score from bm order by bm.score desc, id limit 20")
def bm25_topk(spark, sf):
    return retrieval.top(_bm25(spark, sf), 20).select("id", F.round("score", 6).alias("score"))


@query(_with(BM25_SQL_15) + "select id, round(score / (score + 1), 6) as score from bm order by bm.score desc, id limit 20")
def bm25_normalised(spark, sf):
    return retrieval.top(_bm25(spark, sf, 1.5), 20).select("id", F.round(S.saturate(F.col("score")), 6).alias("score"))


COS_SQL = "cosq as (select vec_id as id, list_cosine_similarity(cast(embedding as double[]), [" + ", ".join(str(x) for x in PROBE) + "]::double[]) as score from embeddings)"


@query(_with(COS_SQL) + "select id, round(score, 6) as score from cosq where score > 0 order by cosq.score desc, id limit 10")
def vector_topk(spark, sf):
    return retrieval.vector_search(D.table(spark, sf, "embeddings"), PROBE, 10).select("id", F.round("score", 6).alias("score"))


@query(
    _with(BM25_SQL, COS_SQL, "a as (select id, row_number() over (order by score desc, id) as r from bm order by r limit 50)", "b as (select id, row_number() over (order by score desc, id) as r from cosq where score > 0 order by r limit 50)")
    + "select id, round(sum(1.0 / (60 + r)), 6) as score from (select * from a union all select * from b) group by id"
)
def hybrid_rrf(spark, sf):
    text = retrieval.top(_bm25(spark, sf), 50)
    near = retrieval.vector_search(D.table(spark, sf, "embeddings"), PROBE, 50)
    return retrieval.fuse([(text, 1.0), (near, 1.0)]).select("id", F.round("score", 6).alias("score"))


@query(
    _with(BM25_SQL, COS_SQL)
    + """select doc_id as id, round((coalesce(0.2 * bm.score / (bm.score + 1), 0) + coalesce(0.25 * cosq.score, 0) + 0.15 * case when lang = 'en' then 1 else 0 end)
    / (case when bm.score is null then 0 else 0.2 end + case when cosq.score is null then 0 else 0.25 end + 0.15), 6) as score from documents left join bm on bm.id = doc_id left join cosq on cosq.id = doc_id"""
)
def multi_signal(spark, sf):
    docs = D.table(spark, sf, "documents")
    text = _bm25(spark, sf).withColumnRenamed("score", "bm")
    near = D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), S.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in PROBE])).alias("cos"))
    rows = docs.select(F.col("doc_id").alias("id"), "lang").join(text, "id", "left").join(near, "id", "left")
    score = retrieval.weighted_mean({"bm25": (S.saturate(F.col("bm")), 0.2), "semantic": (F.col("cos"), 0.25), "exact": (F.when(F.col("lang") == "en", 1.0).otherwise(0.0), 0.15)})
    return rows.select("id", F.round(score, 6).alias("score"))


@query(
    """with toks as (select doc_id, list_filter(regexp_split_to_array(lower(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: length(x) > 1) as t from documents),
    w as (select doc_id, unnest(t) as x from toks) select doc_id as id, count(*) as hits from w where starts_with(x, 'the') or starts_with(x, 'an') group by doc_id having bool_or(starts_with(x, 'the')) and bool_or(starts_with(x, 'an'))"""
)
def prefix_search(spark, sf):
    return retrieval.prefix_search(spark, _index(spark, sf), ["the", "an"])


@query()
def hashed_ngram_embedding(spark, sf):
    return retrieval.hashed_embedding(D.table(spark, sf, "documents"), 256, "doc_id")


# Similarity


def _part_sets(spark, sf):
    return D.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("item"))


@query()
def minhash_signature(spark, sf):
    rows = D.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), S.name_tokens("p_name").alias("items"))
    return similarity.minhash(rows, 16)


@query()
def near_clone(spark, sf):
    rows = D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), S.ngrams(S.code_tokens(F.col("text")), 5).alias("items"))
    return similarity.similar_pairs(rows, 0.7, 18, 7)


@query(
    """with m as (select distinct l_suppkey as owner, l_partkey as item from lineitem), s as (select owner, count(*) as n from m group by owner),
    x as (select a.owner as a, b.owner as b, count(*) as shared from m a join m b on a.item = b.item and a.owner < b.owner group by 1, 2 having count(*) >= 2)
    select a, b, shared, round(shared / (sa.n + sb.n - shared), 6) as similarity from x join s sa on sa.owner = a join s sb on sb.owner = b where shared / (sa.n + sb.n - shared) >= 0.05"""
)
def shared_neighbours_jaccard(spark, sf):
    return similarity.overlap_pairs(_part_sets(spark, sf), 0.05, 2).withColumn("similarity", F.round("similarity", 6))


@query(
    """with m as (select distinct l_suppkey as owner, l_partkey as item from lineitem), s as (select owner, count(*) as n from m group by owner),
    x as (select a.owner as a, b.owner as b, count(*) as shared from m a join m b on a.item = b.item and a.owner < b.owner group by 1, 2 having count(*) >= 2)
    select a, b, shared, round(2 * shared / (sa.n + sb.n), 6) as similarity from x join s sa on sa.owner = a join s sb on sb.owner = b where 2 * shared / (sa.n + sb.n) >= 0.1"""
)
def method_overlap_dice(spark, sf):
    return similarity.overlap_pairs(_part_sets(spark, sf), 0.1, 2, "dice").withColumn("similarity", F.round("similarity", 6))


@query("with a as (select distinct p_name as name from part where p_partkey % 2 = 0), b as (select distinct p_name as name from part where p_partkey % 2 = 1) select a.name as \"left\", b.name as \"right\", cast(levenshtein(a.name, b.name) as integer) as distance from a, b where levenshtein(a.name, b.name) between 1 and 2")
def levenshtein_match(spark, sf):
    names = D.table(spark, sf, "part").select(F.col("p_name").alias("name"), "p_partkey")
    return changes.near_names(names.where("p_partkey % 2 = 0"), names.where("p_partkey % 2 = 1"))


# Changes and projects

BEFORE_AFTER = "a as (select doc_id as k, cast(doc_id as varchar) || '.txt' as path, md5(text) as checksum from documents where doc_id % 3 <> 0), b as (select doc_id as k, case when doc_id % 10 = 1 then 'moved/' || cast(doc_id as varchar) else cast(doc_id as varchar) || '.txt' end as path, case when doc_id % 7 = 2 then md5(text || 'x') else md5(text) end as checksum from documents where doc_id % 4 <> 0)"


@query(
    _with(BEFORE_AFTER, "m as (select coalesce(a.path, b.path) as path, a.checksum as o, b.checksum as n, case when a.path is null then 'added' when b.path is null then 'deleted' when a.checksum = b.checksum then 'unchanged' else 'modified' end as change from a full join b on a.path = b.path)", "g as (select o as n, min(path) as from_path from m where change = 'deleted' group by o)", "r as (select x.path, g.from_path from (select n, min(path) as path from m where change = 'added' group by n) x join g using (n))")
    + "select m.path, case when r.from_path is not null then 'renamed' else change end as change, r.from_path from m left join r on r.path = m.path where m.path not in (select from_path from r)"
)
def change_set(spark, sf):
    docs = D.table(spark, sf, "documents")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    before = docs.where("doc_id % 3 <> 0").select(name.alias("path"), F.md5(F.col("text").cast("binary")).alias("checksum"))
    path = F.when(F.col("doc_id") % 10 == 1, F.concat(F.lit("moved/"), F.col("doc_id").cast("string"))).otherwise(name)
    text = F.when(F.col("doc_id") % 7 == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return changes.change_set(before, docs.where("doc_id % 4 <> 0").select(path.alias("path"), F.md5(text.cast("binary")).alias("checksum")))


@query(
    """with a as (select c_name as name, c_mktsegment as s, c_acctbal > 0 as e from customer where c_custkey % 3 <> 0), b as (select c_name as name, case when c_custkey % 5 = 0 then 'X' else c_mktsegment end as s, c_acctbal > 5000 as e from customer where c_custkey % 4 <> 0)
    select coalesce(a.name, b.name) as name, 'removed' as change, 'critical' as severity from a left join b on a.name = b.name where b.name is null
    union all select b.name, 'added', 'low' from b left join a on a.name = b.name where a.name is null
    union all select a.name, 'signature_changed', 'high' from a join b on a.name = b.name where a.s <> b.s
    union all select a.name, 'visibility_changed', case when b.e then 'medium' else 'high' end from a join b on a.name = b.name where a.e <> b.e"""
)
def contract_diff(spark, sf):
    c = D.table(spark, sf, "customer")
    before = c.where("c_custkey % 3 <> 0").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("signature"), (F.col("c_acctbal") > 0).alias("exported"))
    after = c.where("c_custkey % 4 <> 0").select(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 5 == 0, "X").otherwise(F.col("c_mktsegment")).alias("signature"), (F.col("c_acctbal") > 5000).alias("exported"))
    return changes.contract_diff(before, after)


@query(_with(D.CROSS_SQL) + "select * from cross_repo")
def cross_repo_edges(spark, sf):
    return changes.cross_edges(*D.repos(spark, sf))


@query(
    _with(D.CROSS_SQL, "o as (select src_repo as repo, count(distinct dst_repo) as fan_out from cross_repo group by 1)", "i as (select dst_repo as repo, count(distinct src_repo) as fan_in from cross_repo group by 1)")
    + "select coalesce(o.repo, i.repo) as repo, coalesce(fan_in, 0) as fan_in, coalesce(fan_out, 0) as fan_out, round((coalesce(fan_in, 0) + coalesce(fan_out, 0)) / 48, 3) as coupling from o full join i on o.repo = i.repo"
)
def fan_in_out(spark, sf):
    return changes.coupling(changes.cross_edges(*D.repos(spark, sf)), 25)


@query(_with(D.VERSIONS_SQL) + "select package, cast(count(distinct repo) as integer) as repos, string_agg(repo || '=' || version, ',' order by repo) as versions from uses group by package having count(distinct repo) >= 2")
def version_matrix(spark, sf):
    m = changes.version_matrix(D.versions(spark, sf))
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("versions")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return m.select("package", "repos", flat.alias("versions"))


@query(
    _with(D.VERSIONS_SQL, "v as (select *, cast(split_part(version, '.', 1) as integer) as a, cast(split_part(version, '.', 2) as integer) as b, cast(split_part(version, '.', 3) as integer) as c from uses)")
    + "select package, count(distinct version) as versions, case when count(distinct a) > 1 then 'major' when count(distinct a * 1000 + b) > 1 then 'minor' else 'patch' end as severity, arg_max(version, a * 1000000 + b * 1000 + c) as recommended from v group by package having count(distinct version) > 1"
)
def version_conflicts(spark, sf):
    return changes.version_conflicts(D.versions(spark, sf))


#: Dependencies of more than the mean strength.
CHEAP_CROSS = "strong as (select src_repo as src, dst_repo as dst, n from cross_repo where n > (select avg(n) from cross_repo))"


@query(_with(D.CROSS_SQL, CHEAP_CROSS, "b as (select 3 as id, 0 as d union select src, d + 1 from b join strong on dst = id where d < 3)", recursive=True) + "select cast(id as bigint) as id, cast(min(d) as integer) as distance, case when min(d) <= 1 then 'high' when min(d) = 2 then 'medium' else 'low' end as level from b where id <> 3 group by id")
def blast_radius(spark, sf):
    cross = changes.cross_edges(*D.repos(spark, sf))
    strong = cross.crossJoin(F.broadcast(cross.agg(F.avg("n").alias("mean")))).where("n > mean")  # the mean is one row
    back = strong.select(F.col("dst_repo").cast("long").alias("src"), F.col("src_repo").cast("long").alias("dst"))
    reached = traverse.bfs(back, _seed(spark, 3), 3).where("distance > 0")
    return reached.select("id", "distance", F.when(F.col("distance") <= 1, "high").when(F.col("distance") == 2, "medium").otherwise("low").alias("level"))


# Evaluation

RANGES = "f as (select l_orderkey * 10 + l_linenumber as id, cast(l_orderkey // 40 as varchar) as file, cast(l_quantity as integer) as s, cast(l_quantity + 10 as integer) as e from lineitem), t as (select o_orderkey as id, cast(o_orderkey // 40 as varchar) as file, cast(o_totalprice % 50 as integer) as s, cast(o_totalprice % 50 + 12 as integer) as e from orders)"


def _ranges(spark, sf):
    li, o = D.table(spark, sf, "lineitem"), D.table(spark, sf, "orders")
    found = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.floor(F.col("l_orderkey") / 40).cast("string").alias("file"), F.round("l_quantity").cast("int").alias("start"), F.round(F.col("l_quantity") + 10).cast("int").alias("end")).dropDuplicates(["id"])
    price = F.col("o_totalprice") % 50
    truth = o.select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_orderkey") / 40).cast("string").alias("file"), F.floor(price).cast("int").alias("start"), (F.floor(price) + 12).cast("int").alias("end"))
    return found, truth


@query()
def detection_match(spark, sf):
    return quality.greedy_matches(*_ranges(spark, sf))


@query(
    """with d as (select l_orderkey as id, cast(l_orderkey // 40 as varchar) as file, min(cast(l_quantity as integer)) as s from lineitem group by l_orderkey),
    t as (select o_orderkey as id, cast(o_orderkey // 40 as varchar) as file, cast(floor(o_totalprice % 50) as integer) as s from orders),
    p as (select d.id, t.id as truth_id, greatest(0, least(d.s + 10, t.s + 12) - greatest(d.s, t.s) + 1) as i from d join t on d.file = t.file where d.s <= t.s + 12 and d.s + 10 >= t.s)
    select id, truth_id, round(i / (11 + 13 - i), 6) as overlap from p where i / (11 + 13 - i) >= 0.5 qualify row_number() over (partition by id order by i desc, truth_id) = 1"""
)
def iou_overlap(spark, sf):
    li = D.table(spark, sf, "lineitem")
    found = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.min(F.col("l_quantity").cast("int")).alias("start")).select("id", F.floor(F.col("id") / 40).cast("string").alias("file"), "start", (F.col("start") + 10).alias("end"))
    return quality.range_matches(found, _ranges(spark, sf)[1]).withColumn("overlap", F.round("overlap", 6))


EVAL = "ev as (select l.doc_id, d.lang, l.quality as truth, case when n_chars > 500 then 1 else 0 end as predicted, case when n_chars > 500 then 1 else 0 end = l.quality as right1, case when lang = 'en' then 1 else 0 end = l.quality as right2 from labels l join documents d on d.doc_id = l.doc_id)"


def _eval(spark, sf):
    rows = D.table(spark, sf, "labels").join(D.table(spark, sf, "documents"), "doc_id")
    out = rows.select("doc_id", "lang", F.col("quality").alias("truth"), F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("predicted"))
    return out.withColumn("right1", (F.col("predicted") == F.col("truth")).cast("int")).withColumn("right2", (F.when(F.col("lang") == "en", 1).otherwise(0) == F.col("truth")).cast("int"))


PRF = "count(*) filter (predicted = 1 and truth = 1) as tp, count(*) filter (predicted = 1 and truth <> 1) as fp, count(*) filter (predicted <> 1 and truth = 1) as fn"
PRF2 = "round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 6) as \"precision\", round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 6) as recall, round(case when 2 * tp + fp + fn = 0 or tp = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 6) as f1"


@query(_with(EVAL, f"c as (select {PRF} from ev)") + f"select tp, fp, fn, {PRF2} from c")
def precision_recall(spark, sf):
    return quality.prf(_eval(spark, sf), "predicted", "truth").select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(_with(EVAL, f"c as (select lang, {PRF} from ev group by lang)") + f"select lang, tp, fp, fn, {PRF2} from c")
def precision_recall_by(spark, sf):
    return quality.prf(_eval(spark, sf), "predicted", "truth", ["lang"]).select("lang", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(_with(EVAL, "c as (select count(*) filter (right1 and not right2) as only_first, count(*) filter (right2 and not right1) as only_second from ev)") + "select only_first, only_second, round(case when only_first + only_second = 0 then 0 else power(greatest(abs(only_first - only_second) - 1, 0), 2) / (only_first + only_second) end, 6) as chi2 from c")
def mcnemar(spark, sf):
    return quality.mcnemar(_eval(spark, sf), "right1", "right2").withColumn("chi2", F.round("chi2", 6))


@query()
def bootstrap_ci(spark, sf):
    return quality.bootstrap_interval(_eval(spark, sf), "right1", "doc_id", 200)


# Dashboards and series


@query(
    """select strftime(o_orderdate, '%Y-%m') as month, count(*) as reviews, count(*) filter (o_orderpriority = '1-URGENT') as critical, round(avg(o_totalprice), 6) as mean, count(distinct o_custkey) as authors from orders group by 1"""
)
def dashboard_metrics(spark, sf):
    o = D.table(spark, sf, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("reviews"), F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("critical"), F.round(F.avg("o_totalprice"), 6).alias("mean"), F.countDistinct("o_custkey").alias("authors"))


@query(
    """with c as (select o_orderstatus as s, count(*) filter (o_orderpriority = '1-URGENT') / 100.0 as security, count(*) filter (o_orderpriority = '2-HIGH') / 100.0 as correctness, count(*) filter (o_orderpriority = '3-MEDIUM') / 100.0 as performance from orders group by 1)
    select s, round((0.4 * greatest(0, 100 - 10 * security) + 0.25 * greatest(0, 100 - 10 * correctness) + 0.15 * greatest(0, 100 - 10 * performance)) / 0.8, 6) as health from c"""
)
def health_score(spark, sf):
    n = lambda p: (F.sum(F.when(F.col("o_orderpriority") == p, 1).otherwise(0)) / 100.0)
    c = D.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("s")).agg(n("1-URGENT").alias("security"), n("2-HIGH").alias("correctness"), n("3-MEDIUM").alias("performance"))
    return c.select("s", F.round(quality.health(c, {"security": 0.4, "correctness": 0.25, "performance": 0.15}), 6).alias("health"))


@query("select user_id, count(*) as n, round(avg(h), 4) as mean_hours from (select user_id, epoch_us(ts - lag(ts) over (partition by user_id order by ts)) / 3600000000.0 as h from events) where h > 0 and h < 168 group by user_id")
def team_insights(spark, sf):
    return quality.gaps(D.table(spark, sf, "events"), "user_id", "ts").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("hours"), 4).alias("mean_hours"))


@query(
    """with e as (select event_type, arg_min(value, (ts, event_id)) as first, arg_max(value, (ts, event_id)) as last from events group by 1), c as (select *, (last - first) / first * 100 as change from e)
    select event_type, first, last, round(change, 6) as change, case when abs(change) < 2 then 'stable' when (case when event_type = 'error' then -change else change end) > 0 then 'improving' else 'declining' end as direction from c"""
)
def trend(spark, sf):
    rows = D.table(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    return quality.trend(rows, "event_type", "at", "value", ["error"]).withColumn("change", F.round("change", 6))


@query("select conv_id, turn, cast(sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as bigint) as grp, cast(ceil(length(text) / 4) as bigint) as tokens from conversations")
def turn_grouping(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return D.table(spark, sf, "conversations").select("conv_id", "turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w).alias("grp"), S.token_estimate(F.col("text")).alias("tokens"))


@query("select conv_id, zone, count(*) as n, cast(sum(tokens) as bigint) as tokens from (select conv_id, ceil(length(text) / 4) as tokens, case when row_number() over (partition by conv_id order by turn) <= 1 then 'frozen' when row_number() over (partition by conv_id order by turn desc) <= 2 then 'recent' else 'middle' end as zone from conversations) group by 1, 2")
def three_zone_compress(spark, sf):
    first, last = Window.partitionBy("conv_id").orderBy("turn"), Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    zone = F.when(F.row_number().over(first) <= 1, "frozen").when(F.row_number().over(last) <= 2, "recent").otherwise("middle")
    rows = D.table(spark, sf, "conversations").select("conv_id", zone.alias("zone"), S.token_estimate(F.col("text")).alias("tokens"))
    return rows.groupBy("conv_id", "zone").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


# Rules

RULES = [rules.Rule("long-word", "style", "low", "[a-z]{18,}"), rules.Rule("table", "correctness", "medium", r" \| "), rules.Rule("symbols", "performance", "high", r"###|\$\$\$"), rules.Rule("digits", "security", "critical", "[0-9]{6,}")]
FINDINGS = "li as (select doc_id, unnest(string_split(text, chr(10))) as line from documents), fi as (" + " union all ".join(f"select doc_id, '{r.id}' as rule, '{r.category}' as category, '{r.severity}' as severity from li where regexp_matches(line, '{r.pattern}')" for r in RULES) + ")"


@query(_with(FINDINGS) + "select doc_id as id, rule, count(*) as n from fi group by 1, 2")
def line_rules(spark, sf):
    return rules.line_findings(D.table(spark, sf, "documents"), RULES).groupBy("id", "rule").agg(F.count("*").alias("n"))


@query(_with(FINDINGS) + "select severity, category, count(*) as n, count(distinct doc_id) as docs from fi group by 1, 2")
def rule_severity(spark, sf):
    return rules.line_findings(D.table(spark, sf, "documents"), RULES).groupBy("severity", "category").agg(F.count("*").alias("n"), F.countDistinct("id").alias("docs"))


@query(
    _with(FINDINGS, "w as (select * from (values ('long-word', 2), ('table', 3), ('symbols', 4), ('digits', 5)) v(rule, wt))", "r as (select d.doc_id, w.rule, w.wt, not exists (select 1 from fi where fi.doc_id = d.doc_id and fi.rule = w.rule) as passed from documents d, w)")
    + "select round(avg(cast(passed as integer)) * 100, 6) as score, round(sum(wt * cast(passed as integer)) / sum(wt) * 100, 6) as weighted from r"
)
def compliance_score(spark, sf):
    docs = D.table(spark, sf, "documents")
    found = rules.line_findings(docs, RULES).select("id", "rule").distinct().withColumn("bad", F.lit(True))
    table = F.array(*[F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity")) for r in RULES])
    every = docs.select(F.col("doc_id").alias("id"), F.explode(table).alias("r")).select("id", "r.*")
    return rules.compliance(every.join(found, ["id", "rule"], "left").withColumn("passed", F.col("bad").isNull()))


@query(
    _with(FINDINGS, "g as (select source as file, category, count(*) as n, max(case severity when 'critical' then 5 when 'high' then 4 when 'medium' then 3 when 'low' then 2 else 1 end) as worst, count(distinct rule) as rules from fi join documents using (doc_id) group by 1, 2)")
    + "select file, category, n, round(0.5 * worst / 5 + 0.3 * least(n / 10, 1.0) + 0.2 / rules, 6) as score from g order by score desc, file, category limit 20"
)
def recommendation_rank(spark, sf):
    docs = D.table(spark, sf, "documents")
    found = rules.line_findings(docs, RULES).join(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("file")), "id")
    return rules.recommendations(found)


@query(
    _with("li as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as line from documents)", "n as (select doc_id, len(string_split(text, chr(10))) as last from documents)", "h as (select doc_id, line, text from li where regexp_matches(text, '^(Th|Er)[a-z]*'))")
    + "select doc_id as id, cast(line as integer) as start, cast(coalesce(lead(line) over (partition by doc_id order by line) - 1, last) as integer) as \"end\" from h join n using (doc_id)"
)
def section_split(spark, sf):
    return rules.sections(D.table(spark, sf, "documents"), heading=r"^(Th|Er)([a-z]*)").select("id", "start", "end")


@query("select page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://[^/]*', ''), '[?#].*$', ''), '(.)/$', '\\1') as path, regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1) as host from pages")
def url_canonicalise(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", S.route(F.col("url")).alias("path"), F.regexp_extract("url", "^[a-zA-Z]+://([^/:?#]+)", 1).alias("host"))


@query("select page_id, count(*) as links, count(distinct l) as targets from (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) as l from pages) group by page_id")
def route_extract(spark, sf):
    links = D.table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("l"))
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("l").alias("targets"))


# Control and data flow: each conversation is a function, its turns blocks; a turn goes to the next and, every third, to one further on.

CFG = "blocks as (select conv_id as fn, turn as block from conversations), es as (select fn, block as src, block + 1 as dst from blocks where (fn, block + 1) in (select fn, block from blocks) union select fn, block, block + 2 from blocks where block % 3 = 0 and (fn, block + 2) in (select fn, block from blocks) union select fn, block, block - 2 from blocks where block % 4 = 3), defs as (select conv_id as fn, turn as block, role as var from conversations), uses as (select conv_id as fn, turn as block, case when role = 'user' then 'assistant' else 'user' end as var from conversations)"


def _cfg(spark, sf):
    c = D.table(spark, sf, "conversations").select(F.col("conv_id").alias("fn"), F.col("turn").alias("block"), "role")
    blocks = c.select("fn", "block")
    ways = F.array(F.col("block") + 1, F.when(F.col("block") % 3 == 0, F.col("block") + 2), F.when(F.col("block") % 4 == 3, F.col("block") - 2))
    edges = c.select("fn", F.col("block").alias("src"), F.explode(ways).alias("dst")).where("dst is not null").join(blocks.withColumnRenamed("block", "dst"), ["fn", "dst"], "left_semi").select("fn", "src", "dst").distinct()
    return blocks, edges, c.select("fn", "block", F.col("role").alias("var")), c.select("fn", "block", F.when(F.col("role") == "user", "assistant").otherwise("user").alias("var"))


@query(_with(CFG, "rd as (select d.fn, e.dst as block, d.var, d.block as def_block from defs d join es e on e.fn = d.fn and e.src = d.block union select r.fn, e.dst, r.var, r.def_block from rd r join es e on e.fn = r.fn and e.src = r.block where not exists (select 1 from defs k where k.fn = r.fn and k.block = r.block and k.var = r.var))", recursive=True) + "select fn, block, var, def_block from rd")
def reaching_defs(spark, sf):
    _, edges, defs, _ = _cfg(spark, sf)
    return dataflow.reaching_definitions(edges, defs)


@query(_with(CFG, "lv as (select u.fn, e.src as block, u.var from uses u join es e on e.fn = u.fn and e.dst = u.block union select l.fn, e.src, l.var from lv l join es e on e.fn = l.fn and e.dst = l.block where not exists (select 1 from defs k where k.fn = l.fn and k.block = l.block and k.var = l.var))", recursive=True) + "select fn, block, var from lv")
def live_vars(spark, sf):
    _, edges, defs, uses = _cfg(spark, sf)
    return dataflow.live_variables(edges, defs, uses)


@query(_with(CFG, "lv as (select u.fn, e.src as block, u.var from uses u join es e on e.fn = u.fn and e.dst = u.block union select l.fn, e.src, l.var from lv l join es e on e.fn = l.fn and e.dst = l.block where not exists (select 1 from defs k where k.fn = l.fn and k.block = l.block and k.var = l.var))", recursive=True) + "select distinct fn, block, var from defs where not exists (select 1 from lv where lv.fn = defs.fn and lv.block = defs.block and lv.var = defs.var)")
def dead_stores(spark, sf):
    _, edges, defs, uses = _cfg(spark, sf)
    return dataflow.dead_stores(edges, defs, uses)


CUT = "e2 as (select * from es where src % 5 <> 2)"


@query(_with(CFG, CUT, "rc as (select fn, block from blocks where block = 0 union select e.fn, e.dst from rc join e2 e on e.fn = rc.fn and e.src = rc.block)", recursive=True) + "select fn, block from blocks where (fn, block) not in (select fn, block from rc)")
def unreachable(spark, sf):
    blocks, edges, _, _ = _cfg(spark, sf)
    return dataflow.unreachable(edges.where("src % 5 <> 2"), blocks)


@query(_with(CFG, "rc as (select fn, block from blocks where block = 0 union select e.fn, e.dst from rc join es e on e.fn = rc.fn and e.src = rc.block)", "wo as (select a.fn, d.block as dom, a.block from rc a join rc d on d.fn = a.fn where a.block = 0 and d.block <> 0 union select w.fn, w.dom, e.dst from wo w join es e on e.fn = w.fn and e.src = w.block where e.dst <> w.dom)", recursive=True) + "select a.fn, a.block, d.block as dom from rc a join rc d on d.fn = a.fn where not exists (select 1 from wo where wo.fn = a.fn and wo.dom = d.block and wo.block = a.block)")
def dominators(spark, sf):
    blocks, edges, _, _ = _cfg(spark, sf)
    return dataflow.dominators(edges, blocks)


# Streams, in batch


@query("select user_id, min(ts) as started, max(ts) as ended, count(*) as n from (select user_id, ts, sum(nw) over (partition by user_id order by ts, event_id) as b from (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 3600 second then 0 else 1 end as nw from events)) group by user_id, b")
def debounce_events(spark, sf):
    return windows.debounce(D.table(spark, sf, "events"), "user_id", "ts", 3600)


@query("select event_id, used, used <= 3 as allowed from (select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 43200000000 - 1 preceding and current row) as used from events)")
def sliding_rate_limit(spark, sf):
    return windows.rate_limit(D.table(spark, sf, "events"), "user_id", "ts", 43200, 3).select("event_id", "used", "allowed")


@query()
def token_bucket(spark, sf):
    return windows.token_bucket(D.table(spark, sf, "events"), "user_id", "ts", 1 / 7200, 3.0)


@query("select date_trunc('day', ts) as started, event_type, count(*) as n from events group by 1, 2")
def tumbling_counts(spark, sf):
    return windows.tumbling_counts(D.table(spark, sf, "events"), "ts", "1 day", ["event_type"]).withColumn("started", F.col("started").cast("timestamp_ntz"))
