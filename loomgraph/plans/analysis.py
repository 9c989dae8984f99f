"""Registered queries of symbol resolution, taint, impact and reports, each with its SQL.

Their inputs are derived from the star schema by statements that both engines take: ``{name}`` is a table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports, resolution, retrieval, security, traverse
from .registry import registry

QUERIES, ORACLES, query = registry()


SYMBOLS = """select cast(p_partkey as bigint) as id, p_brand as file, p_name as name, p_brand || '.' || p_name as qname, case p_size % 3 when 0 then 'Class' when 1 then 'Function' else 'Method' end as label,
    p_partkey % 100 as line_start, p_partkey % 100 + p_size as line_end, p_size as complexity, cast(p_partkey % 4 as int) as repo, p_type as type from {part}"""
IMPORTS = "select distinct 'Brand#' || cast((p_partkey * 7) % 25 + 1 as string) as file, p_name as name, p_brand as target_file from {part} where p_size = 7"
REFS = """select l_orderkey * 10 + l_linenumber as id, 'Brand#' || cast(min(l_suppkey) % 25 + 1 as string) as file, max(p_name) as name, cast(min(l_quantity) as int) as line
    from {lineitem} join {part} on p_partkey = l_partkey group by l_orderkey * 10 + l_linenumber"""
PAGES = r"select page_id as id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as project, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[?#].*$', '') as path, url from {pages}"
COMMENTS = "select o_orderkey as id, 'f' || cast(o_custkey % 50 as string) as path, o_orderpriority as category, cast(floor(o_totalprice) as bigint) % 200 as start, cast(floor(o_totalprice) as bigint) % 200 + o_orderkey % 9 as \"end\" from {orders}"
COMMENTS = COMMENTS.replace('"end"', "`end`")


# References


@query(
    """, local as (select name, file, min(id) as target from symbols group by all),
    i as (select imports.file, imports.name, min(target) as t1 from imports join local on local.name = imports.name and local.file = target_file group by all),
    f as (select r.file, r.name, min(target) as t2 from (select distinct file, name from refs) r join local on local.name = r.name and local.file <> r.file group by all)
    select id, coalesce(t1, t2, local.target) as target, case when t1 is not null then 1 when t2 is not null then 2 when local.target is not null then 3 end as tier
    from refs left join i using (file, name) left join f using (file, name) left join local using (file, name)""",
    refs=REFS, symbols=SYMBOLS, imports=IMPORTS,
)
def scope_resolution(refs, symbols, imports):
    return resolution.resolve(refs, symbols, imports)


@query(
    """, l as (select name, file, min(id) as t from symbols group by all),
    q as (select qname, min(id) as t from symbols group by all), i as (select imports.file, l.name, min(l.t) as t from (select distinct file, target_file from imports) imports join l on l.file = target_file group by all)
    select id, coalesce(q.t, i.t, l.t) as target from heritage h left join q on q.qname = base left join i on i.file = h.file and i.name = base left join l on l.file = h.file and l.name = base""",
    symbols=SYMBOLS, imports=IMPORTS,
    heritage="select a.p_partkey as id, a.p_brand as file, case when a.p_partkey % 3 = 0 then b.p_brand || '.' || b.p_name else b.p_name end as base from {part} a join {part} b on b.p_partkey = (a.p_partkey * 3) % 180",
)
def inheritance_resolution(symbols, imports, heritage):
    return resolution.inherit(heritage, symbols, imports)


@query(
    "select r.id, arg_min(s.id, s.line_start * 1000000 + s.id) as caller from refs r join symbols s on s.file = r.file and r.line between s.line_start and s.line_end where s.label in ('Function', 'Method') group by r.id",
    refs=REFS, symbols=SYMBOLS,
)
def enclosing_symbol(refs, symbols):
    return resolution.callers(refs, symbols.where("label in ('Function', 'Method')"))


@query(
    "select distinct i.file, i.name, s.repo, s.id as target from imports i join symbols s on s.file = i.target_file and s.name = i.name where s.repo <> cast(split_part(i.file, '#', 2) as int) % 4",
    symbols=SYMBOLS, imports=IMPORTS,
)
def import_reference_match(symbols, imports):
    rows = imports.join(symbols.select(F.col("file").alias("target_file"), "name", "repo", F.col("id").alias("target")), ["target_file", "name"])
    return rows.where("repo <> cast(split_part(file, '#', 2) as int) % 4").select("file", "name", "repo", "target").distinct()


@query("select c.id, min(r.id) as target from pages_ c join pages_ r on r.path = c.path and r.project <> c.project group by c.id", pages_=PAGES)
def route_match(pages_):
    return resolution.match_routes(pages_.select("id", "project", "path"), pages_.select("id", "project", "path"))


EVENTS = "select event_type || '-' || cast(event_id % 13 as string) as channel, user_id % 20 as project, value >= 10 as emits from {events}"


@query("select distinct a.channel, a.project as emitter, b.project as listener from ev a join ev b on a.channel = b.channel and a.emits and not b.emits and a.project <> b.project", ev=EVENTS)
def channel_match(ev):
    return resolution.match_channels(ev.where("emits").select("channel", "project"), ev.where("not emits").select("channel", "project"))


CALLS = [("graphql", r"/g[a-z]*/"), ("secure", r"^https://"), ("http", r"^http://")]


@query("select id, " + "case " + " ".join(f"when regexp_matches(url, '{p}') then '{n}'" for n, p in CALLS) + " end as kind from pages_", pages_=PAGES)
def call_classification(pages_):
    return resolution.classify(pages_, "url", CALLS).select("id", "kind")


# Taint

TAINT_RULES = [("source", "PROMO|ECONOMY", None), ("sink", "ring$", "1"), ("sanitizer", "^STANDARD small", None)]


@query(
    "select id, unnest(list_filter([" + ", ".join(f"case when regexp_matches(signature || ' ' || name, '{p}')" + (f" and language = '{lang}'" if lang else "") + f" then '{r}' end" for r, p, lang in TAINT_RULES) + "], lambda x: x is not null)) as role from code",
    code="select p_partkey as id, cast(p_partkey % 2 as string) as language, p_type as signature, p_name as name from {part}",
)
def taint_labels(code):
    return security.label(code, TAINT_RULES)


FLOWS = "select distinct o_custkey % 1000 as src, o_orderkey % 1000 as dst, cast(case o_orderstatus when 'F' then 1 when 'P' then 2 else 0 end as int) as mask from {orders}"


@query(
    """, recursive st as (select place as origin, place, 0 as mask from seeds union select origin, dst, st.mask | flows.mask from st join flows on src = place)
    select distinct origin, st.place, kind from st join sinks on sinks.place = st.place where st.mask & kind = 0""",
    flows=FLOWS, seeds="select distinct o_custkey % 1000 as place from {orders} where o_custkey % 1000 < 3", sinks="select distinct o_orderkey % 1000 as place, cast(1 + o_orderkey % 2 as int) as kind from {orders} where o_orderkey % 1000 > 600",
)
def taint_propagation(flows, seeds, sinks):
    return security.findings(security.propagate(seeds.select(F.col("place").alias("origin"), "place"), flows), sinks)


CALL_FLOWS = "select distinct p_partkey * 8 + l_linenumber % 4 as src, l_suppkey * 8 + (l_linenumber + 1) % 4 as dst, cast(case l_returnflag when 'A' then 1 when 'R' then 4 else 0 end as int) as mask from {lineitem} join {part} on p_partkey = l_partkey"


@query(
    """, recursive st as (select place as origin, place, 0 as mask from seeds union select origin, dst, st.mask | flows.mask from st join flows on src = place)
    select origin, place, cast(min(bit_count(mask)) as int) as neutralised from st group by all""",
    flows=CALL_FLOWS, seeds="select distinct s_suppkey * 8 as place from {supplier} where s_suppkey % 40 < 2",
)
def interprocedural_taint(flows, seeds):
    states = security.propagate(seeds.select(F.col("place").alias("origin"), "place"), flows)
    return states.groupBy("origin", "place").agg(F.min(F.bit_count("mask")).cast("int").alias("neutralised"))


@query(
    "select id, line, case when regexp_matches(code, 'is') then 40 else 80 end as risk from (select doc_id as id, unnest(string_split(text, chr(10))) as code, generate_subscripts(string_split(text, chr(10)), 1) as line from texts) where regexp_matches(code, 'the ') and regexp_matches(code, ' of ')",
    texts="select doc_id, text from {documents}",
)
def line_taint(texts):
    return security.line_taint(texts.select(F.col("doc_id").alias("id"), "text"), "the ", " of ", "is")


@query("select id, source, sink, category from found qualify row_number() over (partition by source, sink, category order by id) = 1", found="select o_orderkey as id, o_custkey % 30 as source, o_orderkey % 20 as sink, o_orderpriority as category from {orders}")
def finding_dedup(found):
    return security.first_of(found, ["source", "sink", "category"], ["id"])


@query("select * from comments c where not exists (select 1 from comments d where d.path = c.path and d.category = c.category and d.id < c.id and least(c.\"end\", d.\"end\") - greatest(c.start, d.start) + 1 >= 3)", comments=COMMENTS)
def comment_merge(comments):
    return reports.merge_comments(comments)


# Impact and reports


@query("select file, count(*) as symbols, sum(complexity) as total, avg(complexity) as average, sum(complexity) > 10 or count(*) > 20 as risky from symbols group by file", symbols=SYMBOLS)
def file_rollup(symbols):
    return reports.file_rollup(symbols)


DEGREE = "select l_partkey as id, count(distinct l_suppkey) as degree from {lineitem} group by l_partkey"


@query("select s.id, complexity, coalesce(degree, 0) as degree from symbols s left join degree using (id) where complexity > 10 or degree > 10 order by complexity desc, coalesce(degree, 0) desc, s.id limit 50", symbols=SYMBOLS, degree=DEGREE)
def resource_hotspots(symbols, degree):
    return reports.hotspots(symbols, degree)


@query("select regexp_replace(path, '/[^/]*$', '') as folder, count(*) as files, case when count(*) > 10 then 'high' when count(*) > 5 then 'medium' else 'low' end as effort from changed group by all", changed="select project || path as path from (" + PAGES + ") p")
def change_clusters(changed):
    return reports.change_clusters(changed)


@query("select regexp_replace(path, '/[^/]*$', '') as owner from changed group by all order by min(path), owner limit 5", changed="select project || path as path from (" + PAGES + ") p")
def suggested_owners(changed):
    return changed.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("owner")).agg(F.min("path").alias("first")).orderBy("first", "owner").limit(5).select("owner")


MONTHS = "select o_orderpriority as project, year(o_orderdate) * 12 + month(o_orderdate) as month, cast(count(*) as double) as issues from {orders} group by o_orderpriority, year(o_orderdate) * 12 + month(o_orderdate)"


@query(
    "select *, avg(issues) over (partition by project order by month rows between 4 preceding and current row) as mean, case when row_number() over (partition by project order by month desc) <= count(*) over (partition by project) // 2 then 'recent' else 'older' end as half from months",
    months=MONTHS,
)
def rolling_trend(months):
    return reports.rolling(months, "project", "month", "issues", 5)


@query("select id, last_value(case when label = 'Class' then name end ignore nulls) over (partition by file order by id rows unbounded preceding) as owner from symbols", symbols=SYMBOLS)
def method_attach(symbols):
    return reports.attach(symbols, "file", "id", F.col("label") == "Class", "name").select("id", "owner")


@query(
    "select l.event_id, r.value as last_value from l asof left join r on l.user_id = r.user_id and l.ts >= r.ts",
    l="select event_id, user_id, ts from {events} where event_type <> 'purchase'", r="select user_id, ts, max(value) as value from {events} where event_type = 'purchase' group by user_id, ts",
)
def as_of_join(l, r):  # noqa: E741
    return reports.as_of(l, r, "user_id", "ts", "value").select("event_id", F.col("value").alias("last_value"))


@query(
    "select o_orderpriority, o_orderstatus, count(*) as orders, count(distinct o_custkey) as customers, round(sum(o_totalprice), 2) as total from o group by cube (o_orderpriority, o_orderstatus)",
    o="select * from {orders}",
)
def order_cube(o):
    return o.cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "select id, cast(ntile(4) over (partition by file order by complexity, id) as int) as quarter, round(percent_rank() over (partition by file order by complexity), 6) as rank, lead(id) over (partition by file order by complexity, id) as following from symbols",
    symbols=SYMBOLS,
)
def rank_frames(symbols):
    from pyspark.sql import Window

    w = Window.partitionBy("file")
    by = w.orderBy("complexity", "id")
    return symbols.select("id", F.ntile(4).over(by).alias("quarter"), F.round(F.percent_rank().over(w.orderBy("complexity")), 6).alias("rank"), F.lead("id").over(by).alias("following"))


@query(
    """select id, concat_ws(', ', case when direct >= 10 then 'many direct' end, case when indirect >= 20 then 'many indirect' end, case when tests >= 5 then 'many tests' end, case when processes > 0 then 'in a process' end, case when direct + indirect > 30 then 'wide' end) as reasons, n as n_reasons,
    case when n >= 3 then 'high' when n >= 1 then 'medium' else 'low' end as class from (select *, cast((direct >= 10)::int + (indirect >= 20)::int + (tests >= 5)::int + (processes > 0)::int + (direct + indirect > 30)::int as int) as n from counts)""",
    counts="select l_partkey as id, count(distinct l_suppkey) as direct, count(*) as indirect, sum(case when l_returnflag = 'R' then 1 else 0 end) as tests, sum(case when l_quantity > 49 then 1 else 0 end) as processes from {lineitem} group by l_partkey",
)
def risk_rationale(counts):
    return reports.risk(counts)


TESTS = "select l_orderkey as src, l_partkey as dst, case when l_returnflag = 'A' then 'TESTS' else 'CALLS' end as type from {lineitem}"


@query("select src % 100 as name, min(src) as id, count(distinct dst) as targets from edges where type = 'TESTS' and dst in (select id from changed) group by all", edges=TESTS, changed="select p_partkey as id from {part} where p_size = 11")
def affected_tests(edges, changed):
    return reports.affected(edges, changed, "TESTS", F.col("src") % 100)


@query("select name, count(distinct repo) as repos from symbols group by name having count(distinct repo) >= 2", symbols=SYMBOLS)
def shared_contracts(symbols):
    return reports.shared_contracts(symbols)


OLD = "select file as name, label || cast(complexity % 12 as string) as property, max(type) as type from (" + SYMBOLS + ") s where repo < 2 group by file, label || cast(complexity % 12 as string)"
NEW = "select file as name, label || cast(complexity % 12 as string) as property, max(type) as type from (" + SYMBOLS + ") s where repo >= 2 group by file, label || cast(complexity % 12 as string)"
CHANGES = """changes as (select coalesce(a.name, b.name) as name, coalesce(a.property, b.property) as property, case when b.type is null then 'removed' when a.type is null then 'added' else 'changed' end as change,
    case when b.type is null then 'breaking' else 'warning' end as level from before a full join after b on a.name = b.name and a.property = b.property where a.type is distinct from b.type)"""


@query(", " + CHANGES + " select * from changes", before=OLD, after=NEW)
def type_compatibility(before, after):
    return reports.type_compatibility(before, after)


@query(", " + CHANGES + " select repo, count(distinct name) as broken from uses join changes using (name) where level = 'breaking' group by repo", before="select * from (" + OLD + ") o where property <> 'Class'", after=NEW + " having max(type) <> 'PROMO'", uses="select cast(p_partkey % 10 as int) as repo, p_brand as name from {part}")
def breaking_changes(before, after, uses):
    return reports.breaking(reports.type_compatibility(before, after), uses)


@query(
    "select package, b.version as best, string_agg(distinct cast(repo as varchar), ',' order by cast(repo as varchar)) as repos from used u join b using (package) where u.version <> b.version group by all",
    used="select p_name as package, p_partkey % 10 as repo, p_type as version from {part}", b="select p_name as package, max(p_type) as version from {part} group by p_name",
)
def version_alignment(used, b):
    return reports.alignment(used, b)


@query(
    """, parts as (select string_split(path, '/') as p from files where contains(path, '/')), u as (select array_to_string(p[1:k], '/') as folder from (select p, unnest(range(1, len(p))) as k from parts))
    select folder, count(*) as files, case when contains(folder, '/') then regexp_replace(folder, '/[^/]*$', '') end as parent from u group by folder""",
    files="select project || path as path from (" + PAGES + ") p",
)
def folder_paths(files):
    return reports.folders(files)


@query("select id, path from files where not regexp_matches(path, '(/en/|\\.lock$|/[0-9]+$)')", files=PAGES)
def diff_prefilter(files):
    return files.where(~F.col("path").rlike(r"(/en/|\.lock$|/[0-9]+$)")).select("id", "path")


@query(
    """, recursive r as (select id as process, id, 0 as d from starts union select process, dst, d + 1 from r join edges on src = id where d < 3)
    select process, count(distinct id) as steps from r group by process""",
    starts="select cast(n_nationkey as bigint) as id from {nation}", edges="select distinct l_suppkey as src, l_partkey as dst from {lineitem}",
)
def process_extraction(starts, edges):
    """From every start, what is reached in three steps: sets of (start, place) grow by joins, all starts at once."""
    found = starts.select(F.col("id").alias("process"), "id")
    for _ in range(3):
        step = found.join(edges, F.col("id") == F.col("src")).select("process", F.col("dst").alias("id"))
        found = found.unionByName(step).distinct()
    return found.groupBy("process").agg(F.count("*").alias("steps"))
