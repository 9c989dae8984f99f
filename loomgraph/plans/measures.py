"""Registered queries of measures and smaller reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import impact, quality, reports, structure
from .registry import registry
from .repos import CHANGED, DEPTH, FLOW, NODES, TYPED, _levels

QUERIES, ORACLES, query = registry()

JUDGED = "select l.doc_id, case when case when n_chars > 500 then 1 else 0 end = l.quality then 1 else 0 end as a, case when case when lang = 'en' then 1 else 0 end = l.quality then 1 else 0 end as b from {labels} l join {documents} d on d.doc_id = l.doc_id"


def _erfc(x: str) -> str:
    t = f"(1 / (1 + {S.ERFC_P} * {x}))"
    y = "0"
    for a in reversed(S.ERFC):
        y = f"(({y} + {a}) * t)"
    return y.replace("t)", f"{t})") + f" * exp(-{x} * {x})"


@query(
    f""", n as (select count(*) filter (a = 1 and b = 0) as only_first, count(*) filter (a = 0 and b = 1) as only_second, count(*) as cases from judged),
    c as (select *, case when only_first + only_second = 0 then 0.0 else greatest(abs(only_first - only_second) - 1, 0) ** 2 / (only_first + only_second) end as chi2 from n),
    p as (select *, case when chi2 <= 0 then 1.0 else {_erfc("sqrt(chi2 / 2)")} end as p from c)
    select only_first, only_second, round(chi2, 6) as chi2, round(p, 9) as p, p < 0.05 as significant, case when abs(only_first - only_second) / cases > 0.2 then 'large' when abs(only_first - only_second) / cases > 0.1 then 'medium' when abs(only_first - only_second) / cases > 0.05 then 'small' else 'negligible' end as effect from p""",
    judged=JUDGED,
)
def mcnemar_test(judged):
    return quality.mcnemar_test(judged, "a", "b").withColumn("chi2", F.round("chi2", 6)).withColumn("p", F.round("p", 9))


OWNED = "select p_partkey as id, p_brand as project, case p_size % 3 when 0 then 'Class' else 'Function' end as label, case when p_size % 4 > 0 then p_type end as language, p_size % 6 as cluster, '/' || p_type || '/' || p_brand as file from {part}"


@query(
    """select project, 'label' as kind, label as value, count(*) as n from nodes group by project, label union all select project, 'language', language, count(*) from nodes where language is not null group by project, language
    union all select project, 'edge', type, count(*) from edges join nodes on id = src group by project, type""",
    nodes=OWNED, edges=TYPED,
)
def project_stats(nodes, edges):
    return reports.project_stats(nodes, edges)


@query("select cluster, count(*) as n, arg_min(language, id) filter (language is not null) as language from nodes group by cluster", nodes=OWNED)
def clusters(nodes):
    return reports.clusters(nodes)


@query("select string_split(file, '/')[2] as module, count(distinct file) as files, cast(sum(added) as bigint) as added, cast(sum(removed) as bigint) as removed from stats group by all", stats="select '/' || p_type || '/' || p_name as file, p_size as added, p_size % 5 as removed from {part}")
def changes_by_module(stats):
    return reports.by_module(stats)


@query(
    "select case when score > 50 then '50+' when score > 20 then '21-50' when score > 10 then '11-20' when score > 5 then '6-10' else '1-5' end as bucket, count(*) as n, min(score) as low, max(score) as high, round(avg(score), 2) as mean, cast(round(100 * count(*) / sum(count(*)) over ()) as int) as percent from scores where score > 0 group by 1",
    scores="select l_partkey as id, count(distinct l_suppkey) as score from {lineitem} group by l_partkey",
)
def complexity_distribution(scores):
    return reports.complexity_distribution(scores)


@query(
    """, of as (select id, string_split(file, '/')[2] as p from nodes), s as (select distinct a.p as a, b.p as b from (select distinct src, dst from edges where type = 'CALLS') e join of a on a.id = src join of b on b.id = dst where a.p <> b.p)
    select s.a, s.b from s join s r on r.a = s.b and r.b = s.a where s.a < s.b""",
    nodes=OWNED, edges=TYPED,
)
def package_cycles(nodes, edges):
    return reports.package_cycles(nodes, edges)


IMPLS = "select distinct l_partkey as src, l_suppkey as dst, case when l_returnflag = 'A' then 'IMPLEMENTS' else 'HAS_METHOD' end as type from {lineitem}"


@query(
    "select e.dst as interface, e.src as \"class\", count(m.dst) as methods from (select distinct src, dst from edges where type = 'IMPLEMENTS') e left join (select distinct src, dst from edges where type = 'HAS_METHOD') m on m.src = e.src where e.dst in (select id from wanted) group by all",
    nodes=OWNED, edges=IMPLS, wanted="select s_suppkey as id from {supplier}",
)
def implementations(nodes, edges, wanted):
    return reports.implementations(nodes, edges, wanted)


@query("select dst as id, count(*) as uses from edges where dst not in (select id from nodes) group by dst", nodes="select p_partkey as id from {part} where p_size > 10", edges="select l_orderkey as src, l_partkey as dst from {lineitem}")
def external_symbols(nodes, edges):
    return reports.external_symbols(nodes, edges)


@query(
    """select conv_id, zone, count(*) as n, cast(sum(tokens) as bigint) as tokens from (select conv_id, ceil(length(text) / 4) as tokens, case when row_number() over (partition by conv_id order by turn) <= 2 then 'frozen'
    when row_number() over (partition by conv_id order by turn desc) <= 3 then 'recent' else 'middle' end as zone from turns) group by conv_id, zone""",
    turns="select conv_id, turn, text from {conversations}",
)
def compressed_turns(turns):
    return reports.compressed_turns(turns, 2, 3).withColumn("tokens", F.col("tokens").cast("long"))


@query("select id, 'added' as change from b where id not in (select id from a) union all select id, 'removed' from a where id not in (select id from b)", a="select o_orderkey as id from {orders} where o_orderkey % 3 <> 0", b="select o_orderkey as id from {orders} where o_orderkey % 5 <> 0")
def report_diff(a, b):
    return reports.report_diff(a, b)


@query(f", {_levels()} select source, node as sink, count(*) as paths, cast(min(len(path)) as int) as shortest from hit group by all", **FLOW)
def reachable_sinks(steps, sources, sinks, clean):
    return impact.reachable_sinks(impact.dataflow_paths(steps, sources, sinks, clean, DEPTH))


@query(
    "select distinct regexp_replace(file, '/[^/]*$', '') as owner from nodes where id in (select src from edges where type = 'CALLS' and dst in (select id from changed)) order by owner limit 5",
    nodes=OWNED, edges=TYPED, changed=CHANGED,
)
def caller_owners(nodes, edges, changed):
    return impact.suggested_owners(nodes, edges, changed)


@query("select id, cast(case when direct > 0 then round(least(1.0, 0.9 + least(direct, 5) * 0.02 + case when heuristic > 0 then 0.03 else 0 end + case when heuristic > 0 and inferred > 0 then 0.02 else 0 end), 3) when heuristic > 0 then round(least(1.0, 0.7 + least(heuristic, 10) * 0.019 + case when inferred > 0 then 0.02 else 0 end), 3) when inferred > 0 then round(0.5 + least(inferred, 10) * 0.019, 3) else 0.0 end as double) as confidence from found",
    found="select p_partkey as id, p_size % 4 as direct, p_size % 3 as heuristic, p_size % 5 as inferred from {part}")
def evidence_confidence(found):
    return found.select("id", S.evidence_confidence(F.col("direct"), F.col("heuristic"), F.col("inferred")).alias("confidence"))


@query("select id, sha256(mode || chr(0) || path || chr(0) || content) as fingerprint, array_to_string(list_filter(list_transform(string_split(regexp_extract(signature, '\\(([^)]*)\\)', 1), ','), lambda p: trim(p)), lambda p: p <> ''), '|') as params from code",
    code="select doc_id as id, lang as mode, source as path, text as content, 'f(' || lang || ', ' || source || ',, x)' as signature from {documents}")
def fingerprints_and_params(code):
    return code.select("id", S.content_fingerprint(F.col("mode"), F.col("path"), F.col("content")).alias("fingerprint"), F.array_join(S.signature_params(F.col("signature")), "|").alias("params"))


STEPS_SQL = "case when {n} >= {a} then {w} when {n} >= {b} then {x} when {n} >= {c} then {y} when {n} >= {d} then {z} else 0 end"


@query(
    f"""select id, cast(least(100, case when symbols > 0 then case level when 'medium' then 5 when 'high' then 15 when 'critical' then 30 else 0 end else 0 end + {STEPS_SQL.format(n="impacted", a=20, b=10, c=5, d=1, w=25, x=18, y=12, z=5)}
    + case when processes >= 3 then 20 when processes >= 2 then 13 when processes >= 1 then 7 else 0 end + {STEPS_SQL.format(n="files", a=10, b=5, c=2, d=1, w=15, x=10, y=5, z=2)} + {STEPS_SQL.format(n="symbols", a=20, b=10, c=5, d=1, w=10, x=7, y=4, z=1)}) as int) as risk from found""",
    found="select p_partkey as id, case p_size % 4 when 0 then 'low' when 1 then 'medium' when 2 then 'high' else 'critical' end as level, p_size % 23 as symbols, p_size % 29 as impacted, p_size % 5 as processes, p_size % 13 as files from {part}",
)
def change_risk(found):
    return found.select("id", S.change_risk(F.col("level"), F.col("symbols"), F.col("impacted"), F.col("processes"), F.col("files")).alias("risk"))


@query(
    """, recursive r as (select id, 0 as d from changed union select src, d + 1 from r join edges on dst = id where type = 'CALLS' and d < 2), i as (select count(*) as impacted from (select id from r group by id having min(d) > 0)),
    rt as (select count(*) as routes from (select distinct coalesce(n.method, 'GET') as m, n.path from nodes n where label = 'Route' and (id in (select id from changed) or id in (select dst from edges where type = 'HANDLES_ROUTE' and src in (select id from changed))))),
    ps as (select count(distinct name) as processes from nodes where (label = 'Process' and id in (select id from changed)) or id in (select src from edges where type = 'STEP_IN_PROCESS' and dst in (select id from changed))),
    o as (select count(distinct file) as files, count(*) as symbols from nodes where id in (select id from changed)), x as (select * from i, rt, ps, o),
    l as (select *, case when impacted >= 20 or processes >= 3 then 'critical' when impacted >= 10 or processes >= 2 then 'high' when impacted >= 3 or processes >= 1 then 'medium' else 'low' end as level from x)
    select impacted, cast(0 as bigint) as tests, routes, processes, files, level, cast(least(100, case level when 'critical' then 30 when 'high' then 15 when 'medium' then 5 else 0 end + case when impacted >= 20 then 25 when impacted >= 10 then 18 when impacted >= 5 then 12 when impacted >= 1 then 5 else 0 end
    + case when processes >= 3 then 20 when processes >= 2 then 13 when processes >= 1 then 7 else 0 end + case when files >= 10 then 15 when files >= 5 then 10 when files >= 2 then 5 when files >= 1 then 2 else 0 end + case when symbols >= 20 then 10 when symbols >= 10 then 7 when symbols >= 5 then 4 when symbols >= 1 then 1 else 0 end) as int) as risk,
    case when files > 10 then 'high' when files > 5 then 'medium' else 'low' end as effort from l""",
    nodes=NODES, edges=TYPED, changed=CHANGED,
)
def change_report(nodes, edges, changed):
    return impact.change_report(nodes, edges, changed, 2)


@query("select id, label from nodes where label in ('Class', 'Function', 'Module', 'Route')", nodes=NODES)
def structural_nodes(nodes):
    return structure.structural(nodes).select("id", "label")


@query(
    """, b as (select src as id, dst as other, 'out' as way, type from edges union select dst, src, 'in', type from edges), n as (select b.*, x.name from b join nodes x on x.id = b.other where b.id in (select id from changed)),
    f as (select * from n qualify row_number() over (partition by id, way order by type, other) <= 5) select id, way, type, other, name from f""",
    nodes=NODES, edges=TYPED, changed="select p_partkey as id from {part}",
)
def symbol_context(nodes, edges, changed):
    return impact.context(nodes, edges, changed, 5)
