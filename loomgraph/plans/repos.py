"""Registered queries of impact and of several repositories, each with its SQL. Parts are symbols, brands and nations repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..operators import crossrepo, dataflow, impact, quality, retrieval, traverse
from .programs import BLOCKS, DOM, EDGES, STEPS
from .registry import registry

QUERIES, ORACLES, query = registry()

# ---- impact

DEPTH = 3


def _levels() -> str:
    """The first shortest paths of all sources, one level after another."""
    parts = ["m0 as (select id as source, id as node, [id] as path, false as sanitized, false as sink from sources)"]
    for d in range(1, DEPTH + 1):
        seen = " union all ".join(f"select source, node from m{k}" for k in range(d))
        parts.append(
            f"""m{d} as materialized (select source, dst as node, list_append(arg_min(path, path), dst) as path, arg_min(sanitized, path) or dst in (select id from clean) as sanitized, dst in (select id from sinks) as sink
            from m{d - 1} join steps on src = node where not sink and (source, dst) not in ({seen}) group by source, dst)"""
        )
    return ", ".join(parts) + ", hit as (" + " union all ".join(f"select * from m{d} where sink" for d in range(1, DEPTH + 1)) + ")"


RISK = "cast(case when sanitized then floor((least(10 * len(path), 50) + 50) * 0.5) else least(10 * len(path), 50) + 50 end as int)"
FLOW = {"steps": STEPS, "sources": "select p_partkey as id from {part} where p_size = 1", "sinks": "select p_partkey as id from {part} where p_size = 50", "clean": "select p_partkey as id from {part} where p_size = 25"}


@query(f", {_levels()} select source, node as sink, array_to_string(path, '>') as path, sanitized, {RISK} as risk from hit", **FLOW)
def dataflow_risk(steps, sources, sinks, clean):
    return impact.dataflow_paths(steps, sources, sinks, clean, DEPTH).withColumn("path", F.array_join("path", ">"))


@query(f", {_levels()} select source, count(*) as paths, count(distinct node) as sinks, bool_or(sanitized) as sanitizers, case when max({RISK}) >= 90 then 'critical' when max({RISK}) >= 70 then 'high' when max({RISK}) >= 40 then 'medium' else 'low' end as risk from hit group by source", **FLOW)
def taint_report(steps, sources, sinks, clean):
    return impact.taint_report(impact.dataflow_paths(steps, sources, sinks, clean, DEPTH))


NODES = """select p_partkey as id, case p_size % 5 when 0 then 'Route' when 1 then 'Process' when 2 then 'Class' when 3 then 'Module' else 'Function' end as label, p_name as name, p_brand || '.' || p_name as qname,
    case when p_size % 10 = 0 then 'POST' end as method, '/' || p_type as path, p_brand as file, p_size % 2 = 0 as exported, p_brand as repo from {part}"""
TYPED = "select distinct l_partkey as src, cast(l_suppkey * 17 % 199 + 1 as bigint) as dst, case l_returnflag when 'A' then 'HANDLES_ROUTE' when 'R' then 'CALLS' else 'STEP_IN_PROCESS' end as type from {lineitem}"
CHANGED = "select p_partkey as id from {part} where p_partkey % 7 = 3"


@query(
    """, r as (select id, qname, coalesce(method, 'GET') as method, path from nodes where label = 'Route'),
    e as (select r.method, r.path, 0 as rank, r.id as by_, cast(null as bigint) as of_, r.qname as handler from r join changed using (id)
    union all select r.method, r.path, 1, edges.src, edges.dst, n.qname from edges join changed on changed.id = edges.src join nodes n on n.id = edges.src join r on r.id = edges.dst where type = 'HANDLES_ROUTE'),
    f as (select * from e qualify row_number() over (partition by method, path order by rank, by_, of_) = 1)
    select f.method, f.path, f.handler, coalesce(array_to_string(list_sort(list(distinct n.qname) filter (where n.qname is not null)), ','), '') as consumers from f left join edges c on c.src = f.of_ and c.type = 'CALLS' left join nodes n on n.id = c.dst group by all""",
    nodes=NODES, edges=TYPED, changed=CHANGED,
)
def affected_routes(nodes, edges, changed):
    return impact.affected_routes(nodes, edges, changed).withColumn("consumers", F.array_join("consumers", ","))


@query(
    """, e as (select n.name as process, true as own, cast(null as varchar) as step from nodes n join changed using (id) where label = 'Process'
    union all select p.name, false, s.name from (select distinct src, dst from edges where type = 'STEP_IN_PROCESS') x join changed on changed.id = x.dst join nodes p on p.id = x.src join nodes s on s.id = x.dst)
    select process, case when bool_or(own) then 'blocked' else 'degraded' end as severity, coalesce(string_agg(step, ',' order by step), '') as steps from e group by process""",
    nodes=NODES, edges=TYPED, changed=CHANGED,
)
def affected_processes(nodes, edges, changed):
    return impact.affected_processes(nodes, edges, changed).withColumn("steps", F.array_join("steps", ","))


@query("select e.src as test, min(e.dst) as symbol, case when e.src in (select id from changed) then 'direct' else 'indirect' end as impact from (select src, dst from edges where type = 'CALLS') e where e.dst in (select id from changed) group by e.src", nodes=NODES, edges=TYPED, changed=CHANGED)
def affected_tests_once(nodes, edges, changed):
    return impact.affected_tests(nodes, edges.withColumn("type", F.when(F.col("type") == "CALLS", "TESTS").otherwise("OTHER")), changed)


@query("select file, cast(sum(i) as bigint) as inbound, cast(sum(o) as bigint) as outbound, cast(sum(i + o) as bigint) as total from (select n.file, 0 as i, 1 as o from edges e join nodes n on n.id = e.src where type = 'CALLS' union all select n.file, 1, 0 from edges e join nodes n on n.id = e.dst where type = 'CALLS') group by file", nodes=NODES, edges=TYPED)
def file_dependencies(nodes, edges):
    return impact.file_dependencies(nodes, edges)


@query("select label, n, cast(round(100 * n / sum(n) over ()) as int) as percent from (select label, count(*) as n from nodes group by label)", nodes=NODES)
def structure_report(nodes):
    return impact.structure_report(nodes)


@query(
    """, c as (select (select count(*) from nodes) as nodes, (select count(*) from edges) as edges, (select count(*) from nodes where label <> 'Module' and id not in (select src from edges union select dst from edges)) as isolated),
    d as (select *, round(edges / (cast(nodes as double) * (nodes - 1)) * 10000) / 100 as density, cast(round(100 * isolated / nodes) as int) as isolated_percent from c)
    select *, case when density < 1 then 'healthy' when density < 5 then 'moderate' else 'dense' end as density_level, case when isolated_percent < 5 then 'healthy' when isolated_percent < 20 then 'moderate' else 'high' end as isolated_level from d""",
    nodes=NODES, edges=TYPED,
)
def graph_health(nodes, edges):
    return impact.graph_health(nodes, edges, ("Module",))


@query(
    """select 'module' as part, name, qname from nodes where label = 'Module' union all select 'route', name, qname from nodes where label = 'Route'
    union all (select 'class', name, qname from nodes where label = 'Class' order by id limit 20) union all (select 'entry_point', name, qname from nodes where label = 'Function' and exported order by id limit 20)""",
    nodes=NODES,
)
def architecture(nodes):
    return impact.architecture(nodes)


# ---- repositories

CROSS = "select c_nationkey as src, s_nationkey as dst, cast(count(*) % 12 as int) as weight from {lineitem} join {orders} on o_orderkey = l_orderkey join {customer} on c_custkey = o_custkey join {supplier} on s_suppkey = l_suppkey"
RELATED = CROSS + " where c_nationkey <> s_nationkey and (c_nationkey * 7 + s_nationkey) % 6 = 0 group by c_nationkey, s_nationkey"
LAYERED = CROSS + " where c_nationkey < s_nationkey and (c_nationkey * 5 + s_nationkey) % 3 = 0 group by c_nationkey, s_nationkey"
LADDER = "case when {w} >= 10 then 'critical' when {w} >= 7 then 'high' when {w} >= 4 then 'medium' else 'low' end"


@query(
    f""", recursive r as (select 3 as id, 0 as d union select dst, d + 1 from r join edges on src = id where d < 30), l as (select id, min(d) as depth from r group by id having min(d) > 0)
    select id as repo, cast(depth as int) as depth, case when depth = 1 then 'direct' else 'transitive' end as kind, {LADDER.format(w="(select max(weight) from edges where dst = l.id)")} as severity,
    exists (select 1 from edges where src = 3 and dst = l.id and weight >= 7) as critical from l""",
    edges=RELATED,
)
def repo_blast_radius(edges):
    return crossrepo.blast_radius(edges, edges.sparkSession.createDataFrame([(3,)], "id int"))


@query(
    f""", recursive p as (select [0] as path, 0 as last union all select list_append(path, dst), dst from p join edges on src = last where not list_contains(path, dst))
    select array_to_string(path, '>') as path, cast(len(path) - 1 as int) as depth, {LADDER.format(w="(select max(weight) from edges where list_contains(p.path, src) or list_contains(p.path, dst))")} as criticality
    from p where len(path) > 1 and last not in (select src from edges)""",
    edges=LAYERED,
)
def dependency_chains(edges):
    return crossrepo.dependency_chains(edges, edges.sparkSession.createDataFrame([(0,)], "id int")).withColumn("path", F.array_join("path", ">"))


TRACES = "select src, dst, case when src % 3 = 0 then 'CROSS_REPO_CALLS' when src % 3 = 1 then 'CROSS_REPO_IMPORTS' else 'CALLS' end as type from (" + STEPS + ") s"


@query(
    """, c as (select * from edges where starts_with(type, 'CROSS_REPO_')), a as (select distinct n.* from nodes n join seeds s on s.repo = n.repo and (lower(n.name) = lower(symbol) or contains(lower(n.qname), lower(symbol)))),
    one as (select a.repo as a_repo, a.qname as source, b.id as b_id, b.repo as b_repo, b.qname as b_qname, c.type from a join c on c.src = a.id join nodes b on b.id = c.dst where b.repo <> a.repo)
    select distinct source, b_repo as target_repo, b_qname as target, type as kind, cast(1 as int) as depth, 'high' as confidence from one
    union select source, n.repo, n.qname, 'transitive_' || c.type, 2, 'medium' from one join c on c.src = b_id join nodes n on n.id = c.dst where n.repo <> b_repo""",
    nodes=NODES, edges=TRACES, seeds="select distinct p_brand as repo, 'red ring' as symbol from {part}",
)
def symbol_trace(nodes, edges, seeds):
    return crossrepo.trace_symbol(nodes, edges, seeds)


FOUND = "select id, cast(case when contains(lower(name), 'ring') then 8 else 0 end + case when contains(lower(name), 'blue') then 8 else 0 end as double) as score from nodes where contains(lower(name), 'ring') or contains(lower(name), 'blue')"


@query(
    f""", s as (select * from ({FOUND}) order by score desc, id limit 250), h as (select s.*, n.repo, n.label, n.name, count(*) over () as found from s join nodes n using (id)),
    k as (select *, row_number() over (order by score desc, id) as rank from h where found <= 50 or label in ('Function', 'Class', 'Interface', 'TypeAlias', 'Enum', 'Method'))
    select id, repo, name, score / 20 as relevance, cast(rank as int) as rank, count(*) over (partition by repo) as in_repo from k where rank <= 50""",
    nodes=NODES,
)
def federated_search(nodes):
    return crossrepo.federated_search(retrieval.field_search(nodes, ["ring", "blue"], {"name": 5}), nodes)


@query(
    """, h as (select *, case when name = 'blue ring' or qname = 'blue ring' then 'exact' else 'partial' end as match from nodes where label in ('Function', 'Class', 'Variable', 'Interface', 'TypeAlias', 'Enum', 'Method') and (contains(lower(name), 'blue ring') or contains(lower(qname), 'blue ring')))
    select id, repo, qname, match from h qualify row_number() over (partition by repo, qname order by match <> 'exact', id) = 1""",
    nodes=NODES,
)
def find_symbol(nodes):
    return crossrepo.find_symbol(nodes, "blue ring")


FILES = "select p_brand as repo, p_brand || '/' || p_type || cast(p_size % 4 as string) as file, case when p_size % 3 = 0 then 'Class' else 'Function' end as label, substring(p_name, 1, 9) as name from {part}"


@query(
    """, s as (select repo, file, list_sort(list(distinct label || ':' || name)) as w from symbols group by all), c as (select repo, w, min(file) as file, count(*) as files from s group by all)
    select a.repo as repo_a, a.file as file_a, a.files as files_a, b.repo as repo_b, b.file as file_b, b.files as files_b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 2) as similarity
    from c a join c b on a.repo < b.repo where len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.4""",
    symbols=FILES,
)
def cross_repo_duplicates(symbols):
    return crossrepo.cross_repo_duplicates(symbols, 0.4)


BEFORE = "select 's' || cast(p_partkey as string) as symbol, split(case p_size % 3 when 0 then 'a' when 1 then 'a,b' else 'a,b,c' end, ',') as params, p_size % 3 as required, p_type as returns, cast(p_partkey % 300 as string) as body from {part} where p_partkey % 5 <> 0"
AFTER = "select case when p_partkey % 11 = 4 then 't' else 's' end || cast(p_partkey as string) as symbol, split(case (p_size + p_partkey % 2) % 3 when 0 then 'a' when 1 then 'a,b' else 'a,b,c' end, ',') as params, (p_size + p_partkey % 2) % 3 as required, case when p_partkey % 13 = 0 then 'void' else p_type end as returns, cast(p_partkey % 300 as string) as body from {part} where p_partkey % 7 <> 0"


@query(
    """, f as (select a.body, min(a.symbol) as new_name from after a where a.symbol not in (select symbol from before) group by a.body), u as (select symbol, count(distinct repo) as repos from uses group by symbol),
    b as (select o.*, n.params as np, n.required as nr, n.returns as nt from before o join after n using (symbol) where symbol in (select symbol from u)),
    x as (select o.symbol, case when f.new_name is null then 'removed' else 'renamed' end as change, f.new_name from before o left join f using (body) where o.symbol not in (select symbol from after)
    union all select symbol, 'signature_changed', null from b where params <> np or returns <> nt union all select symbol, 'return_type_changed', null from b where returns <> nt
    union all select symbol, 'parameter_added_required', null from b where nr > required union all select symbol, 'parameter_removed', null from b where len(list_filter(params, lambda p: not list_contains(np, p))) > 0)
    select x.*, coalesce(repos, 0) as repos from x left join u using (symbol)""",
    before=BEFORE, after=AFTER, uses="select 's' || cast(l_partkey as string) as symbol, l_suppkey % 5 as repo from {lineitem}",
)
def predicted_breaks(before, after, uses):
    return crossrepo.breaking_changes(before, after, uses)


LINKS = [crossrepo.RouteRule("links", ("en", "de", "fr", "es"), r'<(a|link)\s[^>]*href="(/[^"]*)"', 2, 1)]


@query(
    """, l as (select id, unnest(string_split(text, chr(10))) as code, generate_subscripts(string_split(text, chr(10)), 1) as line from pages_),
    m as (select id, line, unnest(regexp_extract_all(code, '<(a|link)\\s[^>]*href="(/[^"]*)"', 1)) as method, unnest(regexp_extract_all(code, '<(a|link)\\s[^>]*href="(/[^"]*)"', 2)) as path from l)
    select distinct id as file, cast(line as int) as line, 'links' as framework, upper(method) as method, path from m""",
    pages_="select page_id as id, html as text from {pages}",
)
def detected_routes(pages_):
    return crossrepo.detect_routes(pages_.select(F.col("id").alias("file"), F.lit("en").alias("language"), "text"), LINKS)


STANDARDS = {"secure": "^https://", "english": "/en/", "numbered": "[0-9]+$", "query": "[?]"}


@query(
    ", h as (" + " union all ".join(f"select '{n}' as standard, file from files where regexp_matches(file, '{p}')" for n, p in STANDARDS.items()) + ") select standard, count(distinct file) as files, min(file) as evidence from h group by standard",
    files="select url as file from {pages}",
)
def applicable_standards(files):
    return crossrepo.applicable_standards(files, STANDARDS)


LENS = "select p_brand as file, p_partkey % 40 as line, case when p_size > 40 then 'high' when p_size > 20 then 'medium' else 'low' end as severity, p_name as message from {part} where p_size % 3 = "


@query(
    """, e as (select 'security' as lens, * from a union all select 'style' as lens, * from b),
    s as (select 'synthesis' as lens, file, line, arg_max(severity, case severity when 'high' then 3 when 'medium' then 2 else 1 end) as severity, string_agg(distinct lens, ', ' order by lens) as message, count(distinct lens) as k, max(case severity when 'high' then 3 when 'medium' then 2 else 1 end) as w from e group by file, line having count(distinct lens) > 1)
    select lens, file, line, severity, message from e union all (select lens, file, line, severity, message from s order by k desc, w desc, file, line limit 10)""",
    a=LENS + "0", b=LENS + "1",
)
def review_lenses(a, b):
    return crossrepo.lenses({"security": a, "style": b}, {"high": 3, "medium": 2, "low": 1})


# ---- operators of other modules that had no query


@query(f", {DOM} select e.fn, e.src, e.dst from es e join dom d on d.fn = e.fn and d.block = e.src and d.dom = e.dst", blocks=BLOCKS, es=EDGES)
def back_edges(blocks, es):
    return dataflow.back_edges(es, dataflow.dominator_sets(es, blocks))


@query(
    ", recursive r as (select id, 0 as d from ids where id not in (select dst from edges) union select dst, d + 1 from r join edges on src = id) select id, cast(max(d) as int) as level from r group by id",
    ids="select cast(n_nationkey as bigint) as id from {nation}", edges="select distinct cast(least(c_nationkey, s_nationkey) as bigint) as src, cast(greatest(c_nationkey, s_nationkey) as bigint) as dst from {lineitem} join {orders} on o_orderkey = l_orderkey join {customer} on c_custkey = o_custkey join {supplier} on s_suppkey = l_suppkey where c_nationkey <> s_nationkey",
)
def topological_levels(ids, edges):
    return traverse.topological_levels(edges, ids)


@query("select 'node' as kind, count(*) as n from nodes where id % 7 <> 3 union all select 'edge', count(*) from edges where src % 7 <> 3 and dst % 7 <> 3", nodes=NODES, edges=TYPED, changed=CHANGED)
def removed_nodes(nodes, edges, changed):
    g = PropertyGraph(nodes, edges.withColumn("weight", F.lit(1.0))).remove(changed)
    return g.nodes.agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "n").unionByName(g.edges.agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "n"))


@query("select user_id, round(hours, 6) as hours from (select user_id, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts)) / 3600000000.0 as hours from ev) where hours > 0 and hours < 168", ev="select user_id, ts from {events}")
def event_gaps(ev):
    return quality.gaps(ev, "user_id", "ts").select("user_id", F.round("hours", 6).alias("hours"))
