"""Communities, ranks, near names, sketches, code structure, line relocation and the streamed index."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import changes, community, dataflow, rank, retrieval, review, sketches, structure
from loomgraph.streaming.reindex import FileIndex


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def q_of(edges, of, gamma=1.0):
    m2 = 2 * sum(w for _, _, w in edges)
    k = {}
    for a, b, w in edges:
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
    inside = sum(2 * w for a, b, w in edges if of[a] == of[b])
    return inside / m2 - gamma * sum((sum(k[n] for n in k if of[n] == c) / m2) ** 2 for c in set(of.values()))


def connected(edges, of):
    for c in set(of.values()):
        own = {n for n in of if of[n] == c}
        seen, todo = set(), [min(own)]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [b for a, b, _ in edges for a, b in ((a, b), (b, a)) if a == n and b in own]
        if seen != own:
            return False
    return True


def test_leiden_is_connected_and_close_to_the_best(spark):
    rnd = random.Random(5)
    small = sorted({(a, b) for a, b in itertools.combinations(range(8), 2) if rnd.random() < 0.75 * ((a < 4) == (b < 4)) + 0.1})
    edges = [(a, b, 1.0) for a, b in small]
    ids = sorted({n for e in small for n in e})

    def partitions(xs):
        if not xs:
            yield []
            return
        for rest in partitions(xs[1:]):
            for i in range(len(rest)):
                yield [*rest[:i], [xs[0], *rest[i]], *rest[i + 1 :]]
            yield [[xs[0]], *rest]

    best = max(q_of(edges, {n: i for i, p in enumerate(ps) for n in p}) for ps in partitions(ids))
    of = {r["id"]: r["community"] for r in community.leiden(spark.createDataFrame(edges, "src long, dst long, weight double")).collect()}
    assert set(of) == set(ids) and connected(edges, of) and q_of(edges, of) >= 0.95 * best
    assert all(c == min(n for n in of if of[n] == c) for c in of.values())
    rings = [(10 * c + i, 10 * c + j, 1.0) for c in range(12) for i, j in itertools.combinations(range(5), 2)] + [(10 * c, 10 * ((c + 1) % 12) + 1, 1.0) for c in range(12)]
    df = spark.createDataFrame(rings, "src long, dst long, weight double")
    of = {r["id"]: r["community"] for r in community.leiden(df).collect()}
    member = spark.createDataFrame(list(of.items()), "id long, community long")
    q = community.modularity(df, member).first()["modularity"]
    assert q == pytest.approx(q_of(rings, of)) and connected(rings, of)
    truth = {n: n // 10 for n in of}
    assert q >= 0.97 * q_of(rings, truth)


def test_refinement_cuts_a_community_that_hangs_by_a_bridge_that_left(spark):
    """Two triangles in one community whose only link is a node of another: the parts are the triangles."""
    edges = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 7), (7, 4)]
    both = community.undirected(spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, dst long, weight double"))
    member = spark.createDataFrame([(n, 9 if n < 7 else 7) for n in range(1, 8)], "id long, community long")
    parts = {r["id"]: r["part"] for r in community._refine(both, member, 40, 1.0).collect()}
    assert not {parts[n] for n in (1, 2, 3)} & {parts[n] for n in (4, 5, 6)}
    assert len({parts[n] for n in (1, 2, 3)}) < 3


def test_pagerank_is_the_power_iteration(spark):
    rnd = random.Random(3)
    nodes = list(range(30))
    edges = [(rnd.choice(nodes[:25]), rnd.choice(nodes), float(rnd.randint(1, 3))) for _ in range(80)] + [(99, 1, 1.0)]
    want = {n: 1 / 30 for n in nodes}
    out = {n: sum(w for s, d, w in edges if s == n and d in nodes) for n in nodes}
    for _ in range(7):
        stuck = sum(want[n] for n in nodes if not out[n])
        want = {n: 0.15 / 30 + 0.85 * (sum(want[s] * w / out[s] for s, d, w in edges if d == n and s in out) + stuck / 30) for n in nodes}
    got = {r["id"]: r["rank"] for r in rank.pagerank(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "src long, dst long, weight double"), rounds=7, write_every=3).collect()}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(1)


def test_signals_that_are_missing_take_no_part(spark):
    df = spark.createDataFrame([(1, 3.0, 0.5, None, "x", 0.02, 1.0), (2, None, None, 0.0, None, 0.9, 0.0), (3, None, None, 0.0, None, 0.0, 0.0)], "id long, bm25 double, semantic double, signature double, ast_profile string, page_rank double, exact double")
    got = {r["id"]: r["score"] for r in rank.multi_signal(df).collect()}
    one = (0.2 * 0.75 + 0.25 * 0.5 + 0.1 * 0.5 + 0.05 * 0.2 + 0.15) / (0.2 + 0.25 + 0.1 + 0.05 + 0.15)
    assert got == pytest.approx({1: one, 2: 0.05 / 0.3})


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def test_communities_in_one_task_are_those_of_the_joins(spark, monkeypatch):
    from loomgraph.operators import settle

    ids = [0, 1, -5, 77, 1 << 40, 123456789012345]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    for r in (0, 7):
        assert settle.turns(np.array(ids), r).tolist() == [x[0] for x in df.select(F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0).collect()]
    rnd = random.Random(11)
    made = sorted({(a, b) for a, b in itertools.combinations(range(60), 2) if rnd.random() < (0.5 if a // 10 == b // 10 else 0.03)} | {(k, k + 1) for k in range(59)})
    edges = spark.createDataFrame([(a, b, float(rnd.randint(1, 3))) for a, b in made] + [(4, 4, 2.0)], "src long, dst long, weight double")
    tables = []

    def counted(df, name="step", keep=community.written):
        tables.append(name)
        return keep(df, name)

    monkeypatch.setattr(community, "written", counted)
    for method in (community.louvain, community.leiden):
        del tables[:]
        monkeypatch.setattr(community, "EDGES_IN_TASK", 10_000)
        want = rows(method(edges), "id", "community")
        assert "state" not in tables and len(want) == 60  # no rounds of joins
        monkeypatch.setattr(community, "EDGES_IN_TASK", 400)  # the first level by joins, what is merged in a task
        assert rows(method(edges), "id", "community") == want and "state" in tables and tables[-1] != "state"
    # Components settle each by itself, small ones dealt together; a large one among them by joins.
    far = edges.unionByName(spark.createDataFrame([(1000 + 10 * c + i, 1000 + 10 * c + j, 1.0) for c in range(9) for i, j in itertools.combinations(range(4), 2)], "src long, dst long, weight double"))
    of = {r["id"]: r["community"] for r in community.leiden(far).collect()}
    assert len(of) == 96 and all(of[1000 + 10 * c + i] == 1000 + 10 * c for c in range(9) for i in range(4))


def test_near_names_by_deletion_are_all_pairs(spark):
    rnd = random.Random(7)
    names = {"", "a", "ab", "abc"} | {"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 6))) for _ in range(30)}
    for n in (22, 23, 24, 25, 26, 40):
        base = "".join(rnd.choice("abcd") for _ in range(n))
        names |= {base, base[1:], base[:-2], base[:5] + "zz" + base[7:], base[:5] + base[6:] + "q", base + "xyz", base[2:]}
    a = spark.createDataFrame([(n,) for n in sorted(names)] + [(None,)], "name string")
    want = {(x, y, distance(x, y)) for x in names for y in names if 0 < distance(x, y) <= 2}
    assert rows(changes.near_names_by_deletion(a, a), "left", "right", "distance") == want


def test_near_names_are_shuffled_and_never_broadcast(spark):
    names = spark.createDataFrame([(f"Clerk{n}",) for n in range(20)], "name string")
    plan = changes.near_names_by_deletion(names, names)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_symbols_match_by_the_first_rule(spark):
    made = [("r1", "Get", "a.Get", "/x"), ("r2", "Get", "b.Get", "/x"), ("r2", "get", "b.get", ""), ("r2", "Gets", "b.Gets", "/x"), ("r3", "fetchAll", "c.fetchAll", "/x"), ("r1", "other", "a.other", None), ("r3", "z", "c.z", "")]
    got = rows(changes.match_symbols(spark.createDataFrame(made, "repo string, name string, qname string, route string")), "source", "target", "rule")
    want = set()
    for a in made:
        for b in made:
            if a[0] < b[0]:
                rule = "exact_name" if a[1] == b[1] else "similar_name" if distance(a[1].lower(), b[1].lower()) <= 2 else "api_pattern" if a[3] and a[3] == b[3] else None
                want |= {(a[2], b[2], rule)} if rule else set()
    assert got == want and {r for _, _, r in got} == {"exact_name", "similar_name", "api_pattern"}


def test_sketches_merge_up_a_cube_within_their_error(spark):
    df = spark.range(60_000).selectExpr("id % 3 as a", "id % 5 as b", "id % 20011 as user", "cast(id % 1000 as double) as v", "id % 2 as part")
    stored = sketches.cells(df.where("part = 0"), ["a", "b"], "user", "v").unionByName(sketches.cells(df.where("part = 1"), ["a", "b"], "user", "v"))
    got = sketches.cube(stored, ["a", "b"]).collect()
    true = {(r["a"], r["b"]): r for r in df.cube("a", "b").agg(*map(F.expr, ["count(*) as n", "count(distinct user) as d", "percentile(v, 0.95) as q"])).collect()}
    assert len(got) == len(true) == 24
    for r in got:
        t = true[r["a"], r["b"]]
        assert r["n"] == t["n"] and abs(r["distinct"] - t["d"]) <= 5 * 0.0163 * t["d"] and abs(r["q95"] - t["q"]) <= 30


CODE = """export function outer(a, b) {
  if (a) {
    while (b) {
      for (;;) { x({ y: { z: { } } }) }
    }
  }
  function inner(c) {
    return 1
  }
}
const short = wide(a, b, c, d, e, f) => 1

const later = async (x) => {
  switch (x) { case 1: case 2: default : }
}
function open(p) {
  if (p) { catch (e) { }
"""


def plain_functions(lines):
    out, inside, start, depth, name = [], False, 0, 0, ""
    for i, line in enumerate(lines):
        heads = [re.search(p, line.strip()) for p in structure.BEGINS]
        head = next((h for h in heads if h), None)
        if head and not inside:
            inside, start, depth, name = True, i, 0, head[1]
        if inside:
            depth += line.count("{") - line.count("}")
            if depth == 0 and i > start + 1:
                out.append((name, start + 1, i + 1, True))
                inside = False
    return out + ([(name, start + 1, len(lines), False)] if inside else [])


def test_functions_and_nesting(spark):
    rnd = random.Random(4)
    pieces = ["function f%d(a) {", "}", "if (x) {", "x = { }", "y", "} else if (z) {", "const g%d = (a, b) => {", "", "run(1) {"]
    files = {"code": CODE.split("\n"), "none": ["x"]} | {f"p{k}": [(p % i if "%d" in (p := rnd.choice(pieces)) else p) for i in range(40)] for k in range(12)}
    lines = spark.createDataFrame([(p, i, c) for p, ls in files.items() for i, c in enumerate(ls, 1)] + [("null", 1, None)], "path string, line long, code string")
    got = {p: sorted((r["name"], r["start"], r["end"], r["closed"]) for r in rs) for p, rs in itertools.groupby(sorted(structure.functions(lines).collect(), key=lambda r: r["path"]), lambda r: r["path"])}
    for p, ls in files.items():
        assert got.get(p, []) == sorted(plain_functions(ls)), p
    code = {r["name"]: r for r in structure.functions(lines).where("path = 'code'").collect()}
    assert code["outer"]["complexity"] == 4 and code["outer"]["lines"] == 10
    deep = rows(structure.nesting(lines.where("path = 'code'"), 3), "line", "depth")
    depth, want = 0, set()
    for i, line in enumerate(CODE.split("\n"), 1):
        step = line.count("{") - line.count("}")
        depth += step
        want |= {(i, depth)} if depth > 3 and step > 0 else set()
    assert deep == want
    assert ("code", 11, "max-params", 6) in rows(structure.structural_findings(lines), "path", "line", "rule", "value")


def lis(pairs):
    best = []
    for i, (a, b) in enumerate(pairs):
        best.append(max((best[j] for j in range(i) if pairs[j][1] < b), key=len, default=[]) + [(a, b)])
    return max(best, key=len, default=[])


def test_lines_align_along_rising_unique_lines(spark):
    rnd = random.Random(11)
    olds, news = {}, {}
    for k in range(12):
        old = [f"l{rnd.randint(0, 25)}" if rnd.random() < 0.8 else "}" for _ in range(20)]
        new = list(old)
        for _ in range(rnd.randint(0, 6)):
            at = rnd.randrange(len(new))
            new[at : at + rnd.randint(0, 2)] = [f"n{rnd.randint(0, 3)}"] * rnd.randint(0, 2)
        if rnd.random() < 0.4:
            new = new[10:] + new[:10]
        olds[f"p{k}"], news[f"p{k}"] = old, new or ["x"]
    frame = lambda x: spark.createDataFrame([(p, i, t) for p, ls in x.items() for i, t in enumerate(ls, 1)], "path string, line long, text string")
    got = {}
    for r in review.align_lines(frame(olds), frame(news), rounds=1).collect():
        got.setdefault(r["path"], []).append((r["old"], r["new"]))
    for p, old in olds.items():
        new, pairs = news[p], sorted(got.get(p, []))
        assert all(old[a - 1] == new[b - 1] for a, b in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
        unique = [(i + 1, new.index(t) + 1) for i, t in enumerate(old) if old.count(t) == 1 and new.count(t) == 1]
        anchors = lis(unique)
        assert len([x for x in pairs if x in unique]) >= len(anchors)
        run = 0
        while run < min(len(old), len(new)) and old[run] == new[run]:
            run += 1
        if not unique:
            assert {(i, i) for i in range(1, run + 1)} <= set(pairs)


def test_comments_follow_their_lines(spark):
    old = ["import a", "", "def total_price(order):", "    return order.net + order.tax", "", "def gone(x):", "    pass"]
    new = ["import a", "import b", "", "def total_price(order):", "    return order.net + order.tax + order.shipping", "", "tail"]
    frame = lambda p, ls: spark.createDataFrame([(p, i, t) for i, t in enumerate(ls, 1)], "path string, line long, text string")
    comments = spark.createDataFrame([(1, "f", 3), (2, "f", 4), (3, "f", 7), (4, "away", 1), (5, "f", 1)], "id long, path string, line long")
    got = {r["id"]: (r["new_line"], r["confidence"]) for r in review.relocate(comments, frame("f", old).unionByName(frame("away", ["x"])), frame("f", new)).collect()}
    assert got == {1: (4, "high"), 2: (5, "medium"), 3: (None, "lost"), 4: (None, "lost"), 5: (1, "high")}


def test_a_batch_run_again_leaves_the_same_tables(spark, tmp_path):
    index = FileIndex(spark, f"file://{tmp_path}/index")
    events = [
        [("a.py", "def one():\n  pass", 1), ("b.py", "class Two: one", 1), ("a.py", "def uno():\n  pass", 2)],
        [("b.py", "class Two: one", 3), ("c.js", "function three(a) {}", 3)],
        [("a.py", None, 4), ("c.js", "function four(a) {}", 4), ("never.py", None, 4)],
    ]
    folder = tmp_path / "events"
    state = lambda: (rows(index.current("symbols"), "path", "label", "name", "line"), rows(index.current("postings"), "path", "term", "tf"))
    assert state() == (set(), set())
    kind = "path string, text string, at long"
    seen = []
    for k, batch in enumerate(events):
        spark.createDataFrame(batch, kind).coalesce(1).write.parquet(f"file://{folder}/{k}")
        stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"file://{folder}")
        index.follow(stream, f"file://{tmp_path}/checkpoint").awaitTermination()
        seen.append(state())
    assert seen[0][0] == {("a.py", "def", "uno", 1), ("b.py", "class", "Two", 1)}
    assert seen[2][0] == {("b.py", "class", "Two", 1), ("c.js", "function", "four", 1)} and not any(p == "a.py" for p, _, _ in seen[2][1])
    skipped = spark.read.parquet(f"file://{tmp_path}/index/files/batch=1")
    assert {r["path"] for r in skipped.collect()} == {"c.js"}
    # The last batch again, and once more after it was cut off before its list of files.
    index.apply(spark.createDataFrame(events[2], kind), 2)
    assert state() == seen[2]
    index._path("x").getFileSystem(spark._jsc.hadoopConfiguration()).delete(index._path("files", "batch=2"), True)
    assert state() == seen[1]
    index.apply(spark.createDataFrame(events[2], kind), 2)
    assert state() == seen[2]
    small = index.compact(f"file://{tmp_path}/small")
    assert rows(small.current("symbols"), "path", "label", "name", "line") == seen[2][0]
    small.apply(spark.createDataFrame([("c.js", "x", 9)], kind), 3)
    assert rows(small.current("symbols"), "path", "name") == {("b.py", "Two")}


FLOW = """start
if (a) {
  b
} else if (c) {
  return d
} else {
  e
}
while (f) {
  if (g) {
    break
  }
  continue
}
switch (h) {
  case 1:
    i
    break
  default:
    j
}
try {
  k
} catch (l) {
  m
}
end"""


def test_control_flow_of_lines(spark):
    want = {
        (0, 1, "next"), (1, 2, "next"), (2, 3, "true"), (2, 4, "false"), (4, 5, "true"), (5, 28, "next"), (4, 6, "false"), (6, 7, "next"), (3, 9, "next"), (7, 9, "next"),
        (9, 10, "true"), (10, 11, "true"), (10, 13, "false"), (13, 9, "back"), (9, 15, "false"), (11, 15, "next"),
        (15, 16, "case"), (16, 17, "next"), (17, 18, "next"), (15, 19, "default"), (19, 20, "next"), (18, 22, "next"), (20, 22, "next"),
        (22, 23, "next"), (22, 24, "throw"), (24, 25, "next"), (23, 27, "next"), (25, 27, "next"), (27, 28, "next"),
    }
    files = spark.createDataFrame([("f", FLOW), ("none", None), ("odd", "} }\nbreak\n{\n}")], "path string, text string")
    got = structure.control_flow(files)
    assert rows(got.where("fn = 'f'"), "src", "dst", "kind") == want
    assert rows(got.where("fn = 'none'"), "src", "dst") == {(0, 2)}
    assert got.where("fn = 'odd'").count() > 0
    blocks = spark.createDataFrame([("f", i) for i in range(29)], "fn string, block long")
    tree = {r["block"]: r["idom"] for r in dataflow.dominator_tree(dataflow.dominator_sets(got, blocks)).where("fn = 'f'").collect()}
    assert tree[9] == 2 and tree[15] == 9 and tree[22] == 15 and tree[28] == 2 and tree[27] == 22


def test_only_missing_documents_are_embedded(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "xyz"), (3, None)], "doc_id long, text string")
    got = retrieval.embed_missing(docs, spark.createDataFrame([(1,), (1,)], "id long"), 16)
    assert {r["id"] for r in got.collect()} == {2}


def test_names_that_differ_in_two_places_meet_once(spark):
    names = [f"Clerk{k:03d}" for k in range(0, 1000, 3)]
    a = spark.createDataFrame([(n,) for n in names], "name string")
    got = [(r["left"], r["right"]) for r in changes._substituted(a, a, 2).collect()]
    apart = lambda x, y: sum(p != q for p, q in zip(x, y))
    assert len(got) == len(set(got)) and set(got) == {(x, y) for x in names for y in names if apart(x, y) == 2}
