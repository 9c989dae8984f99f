"""Operators on small hand-made inputs: exact results and invariants."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import predicates, scalars
from loomgraph.graph import PropertyGraph
from loomgraph.operators import changes, community, dataflow, quality, rules, traverse
from loomgraph.operators.components import components
from loomgraph.operators.pattern import Pattern
from loomgraph.sources import files
from loomgraph.streaming import windows


@pytest.fixture(scope="module")
def calls(spark):
    nodes = spark.createDataFrame([(1, "Function", "funcA", 5), (2, "Function", "funcB", 15), (3, "Class", "MyClass", 8), (4, "Function", "funcC", 3), (5, "Function", "handler", 25)], "id long, label string, name string, complexity int")
    edges = spark.createDataFrame([(1, 2, "CALLS", 1.0), (1, 4, "CALLS", 1.0), (2, 3, "CALLS", 1.0)], "src long, dst long, type string, weight double")
    return PropertyGraph(nodes, edges)


def names(df, col="name"):
    return sorted(r[col] for r in df.collect())


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_call_graph(spark, calls):
    assert names(calls.scan(where=F.col("complexity") > 10)) == ["funcB", "handler"]
    assert names(calls.scan(["Function"], "func*")) == ["funcA", "funcB", "funcC"]
    seed = spark.createDataFrame([(1,)], "id long")
    assert rows(traverse.bfs(calls.hops(), seed, 2).select("id", "distance")) == [(1, 0), (2, 1), (3, 2), (4, 1)]
    assert names(calls.roots()) == ["funcA", "handler"]
    assert names(calls.prune_isolated([])) == ["MyClass", "funcA", "funcB", "funcC"]
    assert rows(calls.degree()) == [(1, 2), (2, 2), (3, 1), (4, 1)]
    assert rows(traverse.reverse_impact(calls.hops(), spark.createDataFrame([(3,)], "id long"), 3, ["CALLS"])) == [(1, 2, "CALLS"), (2, 1, "CALLS")]
    assert traverse.shortest_path(calls.hops(None, "both"), 4, 3, 9).first()["path"] == [4, 1, 2, 3]
    assert traverse.shortest_path(calls.hops(), 3, 1, 9).count() == 0
    assert rows(traverse.topological_levels(calls.edges, calls.nodes)) == [(1, 0), (2, 1), (3, 2), (4, 1), (5, 0)]
    less = calls.remove(spark.createDataFrame([(2,)], "id long"))
    assert less.edges.count() == 1 and less.nodes.count() == 4
    more = calls.upsert(spark.createDataFrame([(9, "Function", "funcA", 50), (10, "Class", "New", 1)], calls.nodes.schema))
    assert more.nodes.where("name = 'funcA'").first()["id"] == 1 and more.nodes.count() == 6


def test_patterns(calls):
    p = Pattern(calls)
    assert rows(p.node("a").hop("CALLS").node("b").select("a.name as x", "b.name as y")) == [("funcA", "funcB"), ("funcA", "funcC"), ("funcB", "MyClass")]
    assert rows(p.node("a").where("a.name = 'funcA'").hop(low=1, high=2).node("b").select("b.name as y", "a_b.hops as h")) == [("MyClass", 2), ("funcB", 1), ("funcC", 1)]
    assert rows(p.node("a", "Function").hop("CALLS", optional=True).node("b", "Class").select("a.name as x", "count(b.id) as n")) == [("funcA", 0), ("funcB", 1), ("funcC", 0), ("handler", 0)]
    assert rows(p.node("a", name="funcB").hop("CALLS", direction="in").node("b").select("b.name as y")) == [("funcA",)]
    with pytest.raises(ValueError):
        p.node("a").node("b")


def test_predicates(spark):
    df = spark.createDataFrame([("a_b",), ("axb",), (None,), ("src/x/y.ts",)], "s string")
    got = lambda c: [r[0] for r in df.select(c).collect()]
    assert got(predicates.glob(F.col("s"), "A_*")) == [True, False, False, False]
    assert got(predicates.path_glob(F.col("s"), "src/*/y")) == [False, False, False, True]
    assert got(predicates.path_glob(F.col("s"), "src/*.ts")) == [False, False, False, False]
    assert got(predicates.path_glob(F.col("s"), "src/**.ts")) == [False, False, False, True]
    assert got(predicates.regex(F.col("s"), "(")) == [False] * 4
    assert got(F.col("s").rlike(predicates.file_pattern("**/*.ts")))[3] is True


def test_scalars(spark):
    one = spark.range(1)
    got = lambda c: one.select(c).first()[0]
    assert got(scalars.name_tokens(F.lit("parseHTTPRequest_v2.x-y"))) == ["parse", "http", "request", "v2", "x", "y"]
    assert tuple(got(scalars.version(F.lit("^1.20.3-rc")))) == (1, 20, 3) and tuple(got(scalars.version(F.lit("2")))) == (2, 0, 0)
    assert got(scalars.iou(F.lit(1), F.lit(10), F.lit(6), F.lit(15))) == pytest.approx(5 / 15)
    assert got(scalars.route(F.lit("https://h.x/api/{id}/?q=1"))) == "/api/:p"
    assert got(scalars.snippet(F.lit("x" * 60 + "Term" + "y" * 60), "term")) == "..." + "x" * 40 + "<<Term>>" + "y" * 40 + "..."
    assert got(scalars.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert got(scalars.ngrams(F.array(*[F.lit(c) for c in "abcd"]), 3)) == ["a b c", "b c d"] and got(scalars.ngrams(F.array(F.lit("a")), 3)) == []


def test_components_of_random_links(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(None, 4)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for i in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cycles_and_paths(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 1), (3, 4), (4, 4)], "src long, dst long")
    assert rows(traverse.two_cycles(e)) == [(1, 2)]
    assert sorted(tuple(r["path"]) for r in traverse.bounded_cycles(e, 4).collect()) == [(1, 2), (1, 2, 3)]
    one = lambda i: spark.createDataFrame([(i,)], "id long")
    assert sorted(tuple(r["path"]) for r in traverse.simple_paths(e, one(1), one(4), 5).collect()) == [(1, 2, 3, 4)]


def test_communities(spark):
    clique = lambda lo: [(i, j, 1.0) for i in range(lo, lo + 6) for j in range(i + 1, lo + 6)]
    e = spark.createDataFrame(clique(0) + clique(10) + clique(20) + [(5, 10, 1.0), (15, 20, 1.0)], "src long, dst long, weight double")
    for method in (community.louvain, community.leiden):
        member = method(e)
        of = {r["id"]: r["community"] for r in member.collect()}
        assert len(of) == 18 and len({of[i] for i in range(6)}) == 1 and len(set(of.values())) == 3
        q = community.modularity(e, member).first()[0]
        assert 0.5 < q < 1
    alone = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("community", F.col("id"))
    assert -0.5 <= community.modularity(e, alone).first()[0] < 0


def test_dataflow(spark):
    """A diamond with a loop: 0 -> 1 -> (2 | 3) -> 4 -> 1, 4 -> 5; 9 is not reached."""
    edges = spark.createDataFrame([("f", a, b) for a, b in [(0, 1), (1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, 5), (9, 5)]], "fn string, src int, dst int")
    blocks = spark.createDataFrame([("f", b) for b in (0, 1, 2, 3, 4, 5, 9)], "fn string, block int")
    defs = spark.createDataFrame([("f", 0, "x"), ("f", 2, "x"), ("f", 3, "y"), ("f", 5, "z")], "fn string, block int, var string")
    uses = spark.createDataFrame([("f", 4, "x"), ("f", 5, "y")], "fn string, block int, var string")
    at = lambda df, *c: sorted(tuple(r[k] for k in c) for r in df.collect())
    assert at(dataflow.unreachable(edges, blocks), "block") == [(9,)]
    doms = dataflow.dominators(edges, blocks)
    want = {0: {0}, 1: {0, 1}, 2: {0, 1, 2}, 3: {0, 1, 3}, 4: {0, 1, 4}, 5: {0, 1, 4, 5}}
    assert at(doms, "block", "dom") == sorted((b, d) for b, ds in want.items() for d in ds)
    assert at(dataflow.immediate_dominators(doms), "block", "idom") == [(1, 0), (2, 1), (3, 1), (4, 1), (5, 4)]
    assert at(dataflow.back_edges(edges, doms), "src", "dst") == [(4, 1)]
    assert at(dataflow.def_use(edges, defs, uses), "var", "def_block", "use_block") == [("x", 0, 4), ("x", 2, 4), ("y", 3, 5)]
    assert at(dataflow.dead_stores(edges, defs, uses), "block", "var") == [(5, "z")]
    assert {(2, 1), (3, 1)} <= set(at(dataflow.control_dependence(edges.where("src <> 9"), blocks.where("block <> 9")), "block", "on"))
    gen = spark.createDataFrame([("f", 1, "a+b"), ("f", 2, "c")], "fn string, block int, expr string")
    kill = spark.createDataFrame([("f", 3, "a+b")], "fn string, block int, expr string")
    assert at(dataflow.available_expressions(edges, gen, kill, blocks), "block", "expr") == [(2, "a+b"), (3, "a+b")]
    seeds = spark.createDataFrame([("s", "f", 0)], "source string, fn string, param int")
    calls = spark.createDataFrame([("f", 0, "g", 1), ("g", 1, "h", 0), ("h", 0, "f", 0)], "fn string, param int, to_fn string, to_param int")
    assert rows(dataflow.interprocedural_taint(seeds, calls, spark.createDataFrame([("h", 0)], "fn string, param int"))) == [("s", "h", 0)]


def test_near_names_against_all_pairs(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 8)))
    a, b = [(word(),) for _ in range(60)], [(word(),) for _ in range(60)]
    left, right = spark.createDataFrame(a, "name string"), spark.createDataFrame(b, "name string")
    want = left.distinct().crossJoin(right.distinct().withColumnRenamed("name", "right")).where("levenshtein(name, right) between 1 and 2")
    assert rows(changes.near_names(left, right).select("left", "right")) == rows(want)


def test_changes(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "path string, checksum string")
    after = spark.createDataFrame([("a", "1"), ("b", "9"), ("e", "3"), ("f", "7")], "path string, checksum string")
    assert sorted(tuple(r)[:2] for r in changes.change_set(before, after).collect()) == [("a", "unchanged"), ("b", "modified"), ("d", "deleted"), ("e", "renamed"), ("f", "added")]
    uses = spark.createDataFrame([("r1", "p", "1.2.0"), ("r2", "p", "1.10.0"), ("r1", "q", "1.0.0")], "repo string, package string, version string")
    assert rows(changes.version_conflicts(uses)) == [("p", 2, "minor", "1.10.0")]
    assert [r["package"] for r in changes.version_matrix(uses).collect()] == ["p"]
    assert [r[0] for r in uses.select(changes.upgrade_safety(F.col("version"), "1.5.0")).collect()] == [True, False, True]


def test_quality(spark):
    found = spark.createDataFrame([(1, "f", 1, 10), (2, "f", 2, 11), (3, "f", 50, 60), (4, "g", 1, 5)], "id long, file string, start int, end int")
    truth = spark.createDataFrame([(7, "f", 1, 10), (8, "f", 3, 12)], "id long, file string, start int, end int")
    assert rows(quality.greedy_matches(found, truth)) == [(1, 7), (2, 8)]
    assert [r["truth_id"] for r in quality.range_matches(found, truth).orderBy("id").collect()] == [7, 7]
    assert names(quality.without_overlaps(found, truth), "id") == [3, 4]
    scored = spark.createDataFrame([(i, 1 if i % 4 else 0) for i in range(400)], "id long, ok int")
    low, high = quality.bootstrap_interval(scored, "ok", "id", 300).first()
    assert low < 0.75 < high and high - low < 0.12


def test_rules(spark):
    docs = spark.createDataFrame([(1, "# A\nx = eval(y)\n## B\nif (a) { while (b) { } }\n"), (2, None)], "doc_id long, text string")
    found = rules.line_findings(docs, [rules.Rule("eval", "security", "critical", r"\beval\("), rules.Rule("none", "style", "low", "zzz")])
    assert rows(found) == [(1, 2, "eval", "security", "critical")]
    assert [tuple(r) for r in rules.sections(docs).orderBy("start").collect()] == [(1, "A", 1, 1, 2), (1, "B", 2, 3, 5)]
    assert rows(rules.complexity(docs.where("doc_id = 1"))) == [(1, 3, 2, 5)]


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/b.min.js").write_text("y")
    (tmp_path / "empty.md").write_text("")
    got = files.discover(spark, str(tmp_path), ["*.min.js"]).select("path", "language", "size")
    assert rows(got) == [("src/a.py", "python", 6)]
    conf = spark.createDataFrame([("f", "# c\n[s]\na.b = 1\nk: v w\n")], "path string, text string")
    assert rows(files.config_entries(conf)) == [("f", 3, "a.b", "1"), ("f", 4, "k", "v w")]
    flat = files.json_entries(spark.createDataFrame([(1, '{"a": {"b": 2}, "c": "x"}')], "id long, j string"), "id", "j", 3)
    assert rows(flat) == [(1, "a.b", "2"), (1, "c", "x")]
    diff = "diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -1,3 +1,3 @@\n one\n-two\n+TWO\n three"
    lines = files.diff_lines(spark.createDataFrame([(1, diff)], "id long, text string"))
    assert rows(lines.select("kind", "line", "text")) == [("added", 2, "TWO"), ("context", 1, "one"), ("context", 3, "three"), ("removed", 1, "two")]
    assert rows(files.diff_stats(lines)) == [(1, "f", 1, 1)]


def test_graph_export(spark, calls, tmp_path):
    files.export_graph(calls, str(tmp_path))
    back, bad = files.import_graph(spark, str(tmp_path))
    assert rows(back.nodes) == rows(calls.nodes) and all(r["n"] == 0 for r in bad.collect())


def test_windows_against_a_loop(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    seen = sorted((r["user_id"], r["ts"].timestamp(), r["event_id"]) for r in events.collect())
    used, state, want = defaultdict(list), {}, []
    for user, t, i in seen:
        recent = [x for x in used[user] if x > t - 43200]
        used[user].append(t)
        ok, state[user] = windows.take_token(state.get(user), t, 1 / 7200, 3.0, 1.0)
        want.append((i, len(recent) + 1 <= 3, ok))
    limit = {r["event_id"]: r["allowed"] for r in windows.rate_limit(events, "user_id", "ts", 43200, 3).collect()}
    assert [limit[i] for i, _, _ in want] == [a for _, a, _ in want]
    bucket = sorted((r["user_id"], r["ts"].timestamp(), r["allowed"]) for r in windows.token_bucket(events, "user_id", "ts", 1 / 7200, 3.0).collect())
    assert [b[2] for b in bucket] == [ok for _, _, ok in want]


def stream_of(spark, df, tmp_path):
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def run_stream(spark, df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"select * from {name}")


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = stream_of(spark, events, tmp_path)
    batch = windows.tumbling_counts(events, "ts", "1 day", ["event_type"])
    got = run_stream(spark, windows.tumbling_counts(stream, "ts", "1 day", ["event_type"]), "daily", "complete")
    assert rows(got) == rows(batch)
    closed = run_stream(spark, windows.debounce_stream(stream, "user_id", "ts", "1 hour", "1 minute", "event_type"), "bursts", "append")
    assert 0 < closed.count() <= windows.debounce(events, "user_id", "ts", 3600).count()
    tokens = run_stream(spark, windows.token_bucket_stream(stream, "user_id", "ts", 1 / 7200, 3.0), "tokens", "append")
    assert tokens.where("allowed").count() == windows.token_bucket(events, "user_id", "ts", 1 / 7200, 3.0).where("allowed").count()
