"""Registered queries of program analysis, ranges, ranks, near names, sketches and code structure, each with its SQL.

A conversation is a function whose turns are its blocks; parts call the parts of the next line of an order; orders are
changes and comments on lines of files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import search_tokens
from ..operators import changes, dataflow, intervals, quality, rank, retrieval, review, sketches, structure, summaries
from .registry import registry

QUERIES, ORACLES, query = registry()

# ---- control and data flow

BLOCKS = "select conv_id as fn, turn as block from {conversations}"
EDGES = f"""select distinct a.fn, a.block as src, b.block as dst from ({BLOCKS}) a join ({BLOCKS}) b on b.fn = a.fn
    and (b.block = a.block + 1 or (a.block % 3 = 0 and b.block = a.block + 2) or (a.block % 4 = 3 and b.block = a.block - 2))"""
DEFS = "select distinct conv_id as fn, turn as block, role as var from {conversations}"
USES = "select distinct conv_id as fn, turn as block, case when role = 'user' then 'assistant' else 'user' end as var from {conversations}"

DOM = """recursive rc as (select fn, block from blocks where block = 0 union select e.fn, e.dst from rc join es e on e.fn = rc.fn and e.src = rc.block),
    recursive wo as (select a.fn, d.block as dom, a.block from rc a join rc d on d.fn = a.fn where a.block = 0 and d.block <> 0 union select w.fn, w.dom, e.dst from wo w join es e on e.fn = w.fn and e.src = w.block where e.dst <> w.dom),
    dom as (select a.fn, a.block, d.block as dom from rc a join rc d on d.fn = a.fn where not exists (select 1 from wo where wo.fn = a.fn and wo.dom = d.block and wo.block = a.block))"""


@query(
    f""", {DOM}, dep as (select fn, block, count(*) - 1 as depth from dom group by all)
    select a.fn, a.block, a.depth, arg_max(d.dom, t.depth) as idom from dep a left join dom d on d.fn = a.fn and d.block = a.block and d.dom <> a.block left join dep t on t.fn = d.fn and t.block = d.dom group by all""",
    blocks=BLOCKS, es=EDGES,
)
def dominator_tree(blocks, es):
    return dataflow.dominator_tree(dataflow.dominator_sets(es, blocks)).select("fn", "block", "depth", "idom")


@query(
    f", {DOM} select distinct a.fn, a.dom as block, e.dst as frontier from dom a join es e on e.fn = a.fn and e.src = a.block where not exists (select 1 from dom s where s.fn = a.fn and s.block = e.dst and s.dom = a.dom and s.dom <> s.block)",
    blocks=BLOCKS, es=EDGES,
)
def dominance_frontier(blocks, es):
    return dataflow.dominance_frontier(es, dataflow.dominator_sets(es, blocks))


DU = """recursive rd as (select d.fn, e.dst as block, d.var, d.block as def_block from defs d join es e on e.fn = d.fn and e.src = d.block
    union select r.fn, e.dst, r.var, r.def_block from rd r join es e on e.fn = r.fn and e.src = r.block where not exists (select 1 from defs k where k.fn = r.fn and k.block = r.block and k.var = r.var)),
    du as (select distinct u.fn, rd.def_block as src, u.block as dst from rd join uses u on u.fn = rd.fn and u.block = rd.block and u.var = rd.var)"""
PDG = (
    DU
    + """, recursive pe as (select fn, block from blocks b where not exists (select 1 from es where es.fn = b.fn and es.src = b.block) union select e.fn, e.src from pe join es e on e.fn = pe.fn and e.dst = pe.block),
    recursive wx as (select p.fn, p.block as post, b.block from pe p join blocks b on b.fn = p.fn and b.block <> p.block where not exists (select 1 from es where es.fn = b.fn and es.src = b.block)
    union select w.fn, w.post, e.src from wx w join es e on e.fn = w.fn and e.dst = w.block where e.src <> w.post),
    pd as (select a.fn, a.block, p.block as post from pe a join pe p on p.fn = a.fn where not exists (select 1 from wx where wx.fn = a.fn and wx.post = p.block and wx.block = a.block)),
    cd as (select distinct e.fn, e.src, p.post as dst from es e join pd p on p.fn = e.fn and p.block = e.dst where not exists (select 1 from pd q where q.fn = e.fn and q.block = e.src and q.post = p.post and q.post <> q.block)),
    pdg as (select fn, src, dst, 'control' as kind from cd union select fn, src, dst, 'data' from du)"""
)
CFG = {"blocks": BLOCKS, "es": EDGES, "defs": DEFS, "uses": USES}


@query(f", {PDG} select * from pdg", **CFG)
def program_dependence(blocks, es, defs, uses):
    return dataflow.program_dependence(es, blocks, defs, uses)


@query(f", {PDG}, recursive sl as (select fn, max(block) as origin, max(block) as block from blocks group by fn union select s.fn, s.origin, p.src from sl s join pdg p on p.fn = s.fn and p.dst = s.block) select * from sl", **CFG)
def backward_slice(blocks, es, defs, uses):
    """All that the last turn of each conversation depends on."""
    last = blocks.groupBy("fn").agg(F.max("block").alias("block"))
    return dataflow.slices(dataflow.program_dependence(es, blocks, defs, uses), last)


@query(f", {PDG}, recursive sl as (select fn, block as origin, block from blocks where block <= 1 union select s.fn, s.origin, p.dst from sl s join pdg p on p.fn = s.fn and p.src = s.block) select * from sl", **CFG)
def forward_slice(blocks, es, defs, uses):
    """All that depends on one of the first two turns of each conversation."""
    return dataflow.slices(dataflow.program_dependence(es, blocks, defs, uses), blocks.where("block <= 1"), "forward")


@query(
    f""", {DU}, m as (select fn, block, bit_or(mask) as mask from clean group by all),
    recursive st as (select fn, block as source, block, 0 as mask from sources union select s.fn, s.source, du.dst, s.mask | coalesce(m.mask, 0) from st s join du on du.fn = s.fn and du.src = s.block left join m on m.fn = s.fn and m.block = du.dst)
    select st.fn, source, k.block as sink, k.kind from st join du on du.fn = st.fn and du.src = st.block join sinks k on k.fn = st.fn and k.block = du.dst where st.mask & k.kind = 0
    union select s.fn, s.block, k.block, k.kind from sources s join sinks k on k.fn = s.fn and k.block = s.block left join m on m.fn = s.fn and m.block = s.block where coalesce(m.mask, 0) & k.kind = 0""",
    es=EDGES, defs=DEFS, uses=USES,
    sources="select distinct conv_id as fn, turn as block from {conversations} where turn % 3 = 0",
    sinks="select distinct conv_id as fn, turn as block, cast(case when (conv_id + turn) % 2 = 0 then 1 else 2 end as int) as kind from {conversations} where turn % 4 <> 1",
    clean="select distinct conv_id as fn, turn as block, cast(1 + (conv_id + turn) % 3 as int) as mask from {conversations} where turn % 2 = 1",
)
def def_use_taint(es, defs, uses, sources, sinks, clean):
    return dataflow.def_use_taint(dataflow.def_use(es, defs, uses), sources, sinks, clean)


# Every pair of neighbouring lines of an order is a call, from the part of the higher class of three to that of the lower. Lines of one number in an order merge their ends, so some calls lie deeper.
NEXT = """select l_orderkey * 10 + l_linenumber as line, l_partkey as a, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as b, l_returnflag as flag, l_linestatus as state,
    cast(l_quantity as int) as q, l_suppkey % 3 as s, l_discount as d from {lineitem}"""
CALLS = f"select line as call, max(case when a % 3 > b % 3 then a else b end) as fn, max(case when a % 3 > b % 3 then b else a end) as callee from ({NEXT}) n where b is not null and a % 3 <> b % 3 group by line"
LINES = f"select line, max(case when a % 3 > b % 3 then a else b end) as fn, max(flag) as flag, max(state) as state, max(q) as q, max(s) as s, max(d) as d from ({NEXT}) n where b is not null and a % 3 <> b % 3 group by line"
FLOWS = f"""select fn, 'param' as src_kind, cast(q % 2 as bigint) as src, 'arg' as dst_kind, line as dst, cast(s % 2 as int) as arg, cast(case flag when 'A' then 1 when 'R' then 2 else 0 end as int) as mask from ({LINES}) x
    union all select p_partkey, 'param', cast(p_size % 2 as bigint), 'return', cast(0 as bigint), cast(0 as int), cast(case when p_size % 4 = 0 then 4 else 0 end as int) from {{part}} where p_partkey % 3 = 0
    union all select fn, 'result', line, 'return', cast(0 as bigint), cast(0 as int), cast(0 as int) from ({LINES}) x where state = 'O'
    union all select fn, 'result', line, 'sink', line, cast(case s when 0 then 1 when 1 then 2 else 4 end as int), cast(0 as int) from ({LINES}) x where q % 5 = 0
    union all select fn, 'source', line, 'arg', line, cast(q % 2 as int), cast(0 as int) from ({LINES}) x where d > 0.03
    union all select p_partkey, 'source', -p_partkey, 'return', cast(0 as bigint), cast(0 as int), cast(0 as int) from {{part}} where p_size % 11 = 0
    union all select p_partkey, 'param', cast(0 as bigint), 'sink', -p_partkey, cast(1 + p_size % 2 as int), cast(0 as int) from {{part}} where p_size % 5 = 0"""


END = "fn, src_kind, src, dst_kind, dst, arg, mask"
# All flows with what passes through calls: a round composes the whole set with itself (level, done: whether it gave nothing new).
COMPOSED = f"""recursive fx as (select 0 as level, false as done, {END} from flows union all select level, done, {END} from (
    with f as (select level, {END} from fx where not done),
    g as (select {END} from f union select a.fn, a.src_kind, a.src, r.dst_kind, r.dst, r.arg, a.mask | t.mask | r.mask from f a join calls c on c.call = a.dst
    join f t on t.fn = c.callee and t.src_kind = 'param' and t.dst_kind = 'return' and t.src = a.arg join f r on r.src_kind = 'result' and r.src = a.dst where a.dst_kind = 'arg')
    select (select max(level) from f) + 1 as level, (select count(*) from g) = (select count(*) from (select distinct {END} from f) x) as done, {END} from g where exists (select 1 from f))),
    f3 as (select distinct {END} from fx where done)"""


@query(
    f""", {COMPOSED},
    mv as (select f.fn, f.src_kind, f.src, 'param' as kind, c.callee as to_fn, cast(f.arg as bigint) as n, mask from f3 f join calls c on c.call = f.dst where f.dst_kind = 'arg'
    union select f.fn, f.src_kind, f.src, 'result', c.fn, c.call, mask from f3 f join calls c on c.callee = f.fn where f.dst_kind = 'return' and f.src_kind <> 'param'),
    recursive st as (select src as origin, kind, to_fn as fn, n, mask from mv where src_kind = 'source' union select s.origin, v.kind, v.to_fn, v.n, s.mask | v.mask from st s join mv v on v.fn = s.fn and v.src_kind = s.kind and v.src = s.n)
    select st.origin as source, f.fn, f.dst as sink, f.arg as kind from st join f3 f on f.fn = st.fn and f.src_kind = st.kind and f.src = st.n where f.dst_kind = 'sink' and (st.mask | f.mask) & f.arg = 0
    union select src, fn, dst, arg from f3 where src_kind = 'source' and dst_kind = 'sink' and mask & arg = 0""",
    flows=FLOWS, calls=CALLS,
)
def summary_taint(flows, calls):
    """Through calls that lie in each other, however deep, as the SQL composes them to its fix point."""
    return summaries.findings(flows, calls)


# ---- ranges

CHANGED = "select o_orderkey as id, 'f' || cast(o_custkey % 50 as string) as file, cast(floor(o_totalprice) as bigint) % 20000 as start, cast(floor(o_totalprice) as bigint) % 20000 + o_orderkey % 40 as `end` from {orders}"
PLACED = "select p_partkey as id, 'f' || cast(p_partkey % 50 as string) as file, (p_partkey * 37) % 20000 as start, (p_partkey * 37) % 20000 + case when p_partkey % 100 = 7 then 15000 else p_size end as `end` from {part}"
@query("select c.id, s.id as symbol from changed c join symbols s on s.file = c.file and s.start <= c.\"end\" and s.\"end\" >= c.start", changed=CHANGED, symbols=PLACED)
def range_overlap(changed, symbols):
    """Symbols whose lines a change touches; one in a hundred symbols is 15,000 lines long."""
    return intervals.overlaps(changed, symbols, ["file"]).select("id", F.col("r_id").alias("symbol"))


@query(
    "select c.* from changed c where not exists (select 1 from symbols s where s.file = c.file and s.start <= c.\"end\" and s.\"end\" >= c.start and (least(c.\"end\", s.\"end\") - greatest(c.start, s.start) + 1) / ((c.\"end\" - c.start + 1) + (s.\"end\" - s.start + 1) - (least(c.\"end\", s.\"end\") - greatest(c.start, s.start) + 1)) > 0.5)",
    changed=CHANGED, symbols=PLACED,
)
def overlap_filter(changed, symbols):
    return quality.without_overlaps(changed, symbols)


REMARKS = """select conv_id * 100 + turn as id, 'c' || cast(conv_id % 25 as string) as path, turn * 3 as start, turn * 3 + conv_id % 7 as `end`,
    case role when 'system' then 'critical' when 'user' then 'high' else 'low' end as severity, substring(text, 1, 24) as content from {conversations}"""
ALIKE = "a.path = b.path and a.id < b.id and a.start <= b.\"end\" and b.start <= a.\"end\" and len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) > 0.7"


@query(
    f""", n as (select *, row_number() over (partition by path order by id) as k, list_distinct(regexp_split_to_array(lower(content), '\\s+')) as w from remarks),
    near as (select b.path, b.k, list(a.k) as before from n a join n b on {ALIKE} group by b.path, b.k),
    recursive run as (select path, cast(0 as bigint) as k, cast([] as bigint[]) as seeds, cast(null as bigint) as seed from (select distinct path from remarks)
    union all select r.path, n.k, case when len(list_intersect(coalesce(near.before, []), r.seeds)) = 0 then list_append(r.seeds, n.k) else r.seeds end, coalesce(list_min(list_intersect(near.before, r.seeds)), n.k)
    from run r join n on n.path = r.path and n.k = r.k + 1 left join near on near.path = n.path and near.k = n.k),
    g as (select s.id as seed, n.id, n.path, n.start, n."end", n.severity, n.content from run r join n on n.path = r.path and n.k = r.k join n s on s.path = r.path and s.k = r.seed)
    select seed, arg_min(id, list_position(['critical', 'high', 'medium', 'low', 'info'], severity)::bigint * 1000000000 + id) as id, path, min(start) as start, max("end") as "end", arg_min(severity, list_position(['critical', 'high', 'medium', 'low', 'info'], severity)) as severity,
    string_agg(content, '; ' order by id) as content, count(*) as merged from g group by seed, path""",
    remarks=REMARKS,
)
def merged_remarks(remarks):
    return review.merge_similar(remarks)


# ---- ranks and names

STEPS = f"select a as src, b as dst, cast(count(*) as double) as weight from ({NEXT}) n where b is not null and a <> b group by a, b"
ROUNDS = 10


def _ranks() -> str:
    parts = ["t as (select src, sum(weight) as total from steps group by src)", "sh as (select steps.src, dst, weight / total as share from steps join t using (src))", "p0 as (select id, cast(1 as double) / (select count(*) from parts) as rank from parts)"]
    for r in range(ROUNDS):
        parts.append(
            f"p{r + 1} as (select parts.id, 0.15e0 / (select count(*) from parts) + 0.85e0 * (coalesce(g.got, 0) + (select coalesce(sum(rank), 0) from p{r} where id not in (select src from t)) / (select count(*) from parts)) as rank"
            f" from parts left join (select dst as id, sum(share * rank) as got from sh join p{r} on p{r}.id = sh.src group by dst) g on g.id = parts.id)"
        )
    return ", ".join(p.replace(" as (", " as materialized (", 1) for p in parts)


IDS = "select p_partkey as id, p_name as name, p_type as type, p_brand as brand, p_size as size from {part}"


@query(f", {_ranks()} select id, round(rank, 9) as rank from p{ROUNDS}", parts=IDS, steps=STEPS)
def page_rank(parts, steps):
    return rank.pagerank(parts, steps, ROUNDS).select("id", F.round("rank", 9).alias("rank"))


ASKED = ["large", "blue", "ring"]
QUOTED = "[" + ", ".join(f"'{w}'" for w in ASKED) + "]"


@query(
    f""", {_ranks()}, w as (select id, name, type, brand, list_filter(regexp_split_to_array(lower(name || ' ' || type), '[^a-z0-9]+'), lambda x: length(x) > 1) as t,
    list_filter(regexp_split_to_array(lower(type || ' ' || brand), '[^a-z0-9]+'), lambda x: length(x) > 1) as g, size from parts),
    q as (select unnest({QUOTED}) as term), tf as (select id, term, len(t) as dl, len(list_filter(t, lambda x: x = term)) as f from w, q), stat as (select count(*) as n, avg(len(t)) as adl from w),
    df as (select term, count(*) as df from tf where f > 0 group by term),
    bm as (select id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / adl))) as score from tf join df using (term), stat where f > 0 group by id),
    mh as (select id, list_transform(range(0, 8), lambda i: list_min(list_transform(list_distinct(t), lambda x: md5(i || ':' || x)))) as s from w),
    mq as (select list_transform(range(0, 8), lambda i: list_min(list_transform({QUOTED}, lambda x: md5(i || ':' || x)))) as s),
    sig as (select w.id, bm.score / (bm.score + 1) as bm25, (select sum(len(list_filter(t, lambda x: x = term))) from q) / (sqrt(list_sum(list_transform(list_distinct(t), lambda x: len(list_filter(t, lambda y: y = x)) ** 2))) * sqrt({len(ASKED)}.0)) as semantic,
    len(list_intersect(g, {QUOTED})) / len(list_distinct(list_concat(g, {QUOTED}))) as signature, case when size > 0 then 0.5 end as ast, ({" + ".join(f"contains(lower(brand || '/' || type), '{w}')::int" for w in ASKED)}) / {len(ASKED)} as module,
    least(10 * rank, 1) as pr, len(list_filter(range(1, 9), lambda i: mh.s[i] = mq.s[i])) / 8 as mh, case when lower(name) = '{" ".join(ASKED[1:])}' then 1.0 else 0.0 end as ex
    from w join p{ROUNDS} using (id) join mh using (id) left join bm using (id) cross join mq),
    sc as (select id, (coalesce(0.2 * bm25, 0) + 0.25 * semantic + 0.1 * signature + 0.1 * ast + 0.05 * module + 0.05 * pr + 0.1 * mh + 0.15 * ex) / (case when bm25 is null then 0 else 0.2 end + 0.8) as score from sig)
    select id, round(score, 6) as score from sc where score >= 0.1""",
    parts=IDS, steps=STEPS,
)
def eight_signals(parts, steps):
    text = F.concat_ws(" ", "name", "type")
    words, sign = search_tokens(text), search_tokens(F.concat_ws(" ", "type", "brand"))
    scores = retrieval.bm25(parts.withColumn("text", text), ASKED, "id").withColumnRenamed("score", "bm25")
    asked = rank.min_hashes(F.array(*[F.lit(w) for w in ASKED]), 8)
    rows = parts.join(scores, "id", "left").join(rank.pagerank(parts, steps, ROUNDS), "id")
    return rank.multi_signal(
        rows.select(
            "id",
            "bm25",
            rank.bag_cosine(ASKED, words).alias("semantic"),
            rank.signature_match(ASKED, sign).alias("signature"),
            F.when(F.col("size") > 0, F.lit("profile")).alias("ast_profile"),
            rank.module_proximity(ASKED, F.concat_ws("/", "brand", "type")).alias("module"),
            F.col("rank").alias("page_rank"),
            rank.agreement(rank.min_hashes(words, 8), asked).alias("min_hash"),
            F.when(F.lower("name") == " ".join(ASKED[1:]), 1.0).otherwise(0.0).alias("exact"),
        )
    ).select("id", F.round("score", 6).alias("score"))


# Names of parts by brand, one letter left out of some, as symbols of repos; a part's type is its route. Parts of one name and brand are one symbol.
SYMBOLS = """select distinct p_brand as repo, case when p_size % 3 = 0 then substring(p_name, 2, 99) when p_size % 7 = 0 then upper(p_name) else p_name end as name, p_brand || '.' || p_name as qname,
    case when p_size % 10 = 0 then '/' || p_type else '' end as route from {part}"""


@query(
    """select a.repo as source_repo, a.qname as source, b.repo as target_repo, b.qname as target, case when a.name = b.name then 'exact_name' when levenshtein(lower(a.name), lower(b.name)) <= 2 then 'similar_name' else 'api_pattern' end as rule,
    cast(case when a.name = b.name then 1.0 when levenshtein(lower(a.name), lower(b.name)) <= 2 then 0.7 else 0.85 end as double) as confidence
    from symbols a join symbols b on a.repo < b.repo where a.name = b.name or levenshtein(lower(a.name), lower(b.name)) <= 2 or (a.route <> '' and a.route = b.route)""",
    symbols=SYMBOLS,
)
def symbol_matches(symbols):
    return changes.match_symbols(symbols)


@query("select a.name as \"left\", b.name as \"right\", levenshtein(a.name, b.name) as distance from (select distinct name from names) a join (select distinct name from names) b on a.name <> b.name and levenshtein(a.name, b.name) <= 2", names="select 'Clerk' || cast(c_custkey * 7919 % 100000 as string) as name from {customer}")
def near_names_by_deletion(names):
    return changes.near_names_by_deletion(names, names).withColumn("distance", F.col("distance").cast("long"))


# ---- sketches and structure


@query(
    """select o_orderpriority, o_orderstatus, cast((o_orderpriority is not null)::int + (o_orderstatus is not null)::int as int) as level, count(*) as n, true as distinct_close, true as median_close from o group by cube (o_orderpriority, o_orderstatus)""",
    o="select o_orderpriority, o_orderstatus, o_custkey, o_totalprice from {orders}",
)
def sketch_cube(o):
    """Cells of a cube from merged sketches, with whether each estimate lies within its error of the exact value."""
    keys = ["o_orderpriority", "o_orderstatus"]
    got = sketches.cube(sketches.cells(o, keys, "o_custkey", "o_totalprice"), keys, (0.5,))
    exact = o.cube(*keys).agg(F.count_distinct("o_custkey").alias("d"), F.percentile("o_totalprice", F.array(F.lit(0.45), F.lit(0.55))).alias("p"))
    exact = exact.select(*[F.col(k).alias(f"x_{k}") for k in keys], "d", "p")
    both = got.join(exact, got[keys[0]].eqNullSafe(exact[f"x_{keys[0]}"]) & got[keys[1]].eqNullSafe(exact[f"x_{keys[1]}"]))
    close = F.abs(F.col("distinct") - F.col("d")) <= F.greatest(F.lit(1.0), 0.08 * F.col("d"))
    return both.select(*keys, F.col("level").cast("int").alias("level"), "n", close.alias("distinct_close"), F.col("q50").between(F.col("p")[0], F.col("p")[1]).alias("median_close"))


# A user's events in order are the lines of a file.
CODE = """select user_id as path, row_number() over (partition by user_id order by ts, event_id) as line, case event_type when 'signup' then 'function f' || cast(event_id as string) || '(a, b) ' || chr(123) when 'click' then 'if (x) ' || chr(123)
    when 'purchase' then chr(125) when 'error' then 'while (y) ' || chr(123) || ' z() ' || chr(125) else chr(125) end as code from {events}"""
DEPTHS = "d as (select path, line, code, len(code) - len(replace(code, '{', '')) - (len(code) - len(replace(code, '}', ''))) as step, sum(len(code) - len(replace(code, '{', '')) - (len(code) - len(replace(code, '}', '')))) over (partition by path order by line) as depth from lines)"


@query(f", {DEPTHS} select path, line, cast(depth as bigint) as depth from d where depth > 2 and step > 0", lines=CODE)
def nesting_depth(lines):
    return structure.nesting(lines, 2).withColumn("depth", F.col("depth").cast("long"))


@query(
    f""", {DEPTHS}, h as (select path, line as start, case when starts_with(code, 'function') then regexp_extract(code, '^function (\\w+)', 1) else regexp_extract(code, '^(\\w+)', 1) end as name, depth - step as level from d where not starts_with(code, '}}')),
    m as (select h.*, (select min(d.line) from d where d.path = h.path and d.line >= h.start + 2 and d.depth = h.level) as stop, (select max(line) from d where d.path = h.path) as last from h),
    recursive k as (select path, start, name, stop, last from m where start = (select min(start) from m x where x.path = m.path)
    union select m.path, m.start, m.name, m.stop, m.last from k join m on m.path = k.path and m.start = (select min(start) from m x where x.path = k.path and x.start > coalesce(k.stop, k.last)))
    select k.path, k.name, k.start, coalesce(stop, last) as "end", coalesce(stop, last) - k.start + 1 as lines, 1 + (select count(*) from d where d.path = k.path and d.line between k.start and coalesce(stop, last) and regexp_matches(code, '^(if|while)')) as complexity, stop is not null as closed from k""",
    lines=CODE,
)
def function_extents(lines):
    return structure.functions(lines).select("path", "name", "start", "end", F.col("lines").cast("long").alias("lines"), F.col("complexity").cast("long").alias("complexity"), "closed")


@query(
    """, e as (select distinct src, dst from edges where src <> dst), b as (select src as id, dst as other from e union select dst, src from e)
    select id, 'coupling' as rule, count(*) as value from b group by id having count(*) > 30 union all select id, 'dead-code', cast(0 as bigint) from nodes where not exported and label <> 'Route' and id not in (select dst from e)
    union all select e.src, 'cycle', e.dst from e join e r on r.src = e.dst and r.dst = e.src where e.src < e.dst""",
    nodes="select p_partkey as id, p_size % 5 = 0 as exported, case when p_size = 1 then 'Route' else 'Function' end as label from {part}", edges=STEPS + " having count(*) > 0",
)
def graph_findings(nodes, edges):
    return structure.graph_findings(nodes, edges, 30)
