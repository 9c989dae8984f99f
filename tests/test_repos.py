"""Impact and cross-repository operators on small graphs against plain versions."""

import random

import pytest

from loomgraph.operators import crossrepo, impact, traverse


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_dataflow_paths_go_only_where_a_sink_is_near_enough(spark, monkeypatch):
    made = {}

    def counted(df, name="step", keep=impact.written):
        out = keep(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(impact, "written", counted)
    edges = [(0, 1), (1, 2), (2, 3), (3, 4), (1, 4)] + [(0, k) for k in range(100, 140)] + [(k, k + 100) for k in range(100, 140)] + [(2, k) for k in range(300, 340)]
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "id long")
    got = {(r["source"], r["sink"], *r["path"]) for r in impact.dataflow_paths(spark.createDataFrame(edges, "src long, dst long"), ids(0), ids(4, 3), ids(), 3).collect()}
    assert got == {(0, 4, 0, 1, 4), (0, 3, 0, 1, 2, 3)}
    assert made["met"] == 4  # nodes 1, 2 and the two sinks of 125 that are reached


def test_dataflow_paths_are_first_shortest_paths(spark):
    rnd = random.Random(5)
    edges = {(rnd.randrange(14), rnd.randrange(14)) for _ in range(30)}
    sources, sinks, clean = [0, 1, 3], {5, 9, 3}, {2, 9, 7}
    want = set()
    for s in sources:
        level, seen = {s: (s,)}, {s}
        for _ in range(4):
            step = {}
            for path in sorted(level.values()):
                for a, b in edges:
                    if a == path[-1] and a != b and b not in seen:
                        step[b] = min(step.get(b, (99,)), path) if b in step else path
            level = {b: (*p, b) for b, p in step.items()}
            seen |= set(level)
            for b in sinks & set(level):
                dirty = not set(level[b][1:]) & clean
                score = min(10 * len(level[b]), 50) + 50
                want.add((s, b, level[b], not dirty, score if dirty else score // 2))
            level = {b: p for b, p in level.items() if b not in sinks}
    ids = lambda xs: spark.createDataFrame([(x,) for x in sorted(xs)], "id long")
    got = impact.dataflow_paths(spark.createDataFrame(sorted(edges), "src long, dst long"), ids(sources), ids(sinks), ids(clean), 4)
    assert {(r["source"], r["sink"], tuple(r["path"]), r["sanitized"], r["risk"]) for r in got.collect()} == want and want
    none = impact.dataflow_paths(spark.createDataFrame([], "src long, dst long"), ids(sources), ids(sinks), ids(clean))
    assert none.count() == 0


def test_routes_processes_and_tests(spark):
    nodes = spark.createDataFrame(
        [(1, "Route", "r1", "q.r1", None, "/a"), (2, "Route", "r2", "q.r2", "POST", "/b"), (3, "Function", "f", "q.f", None, None), (4, "Function", "g", "q.g", None, None), (5, "Process", "p", "q.p", None, None), (6, "Process", "p2", "q.p2", None, None), (7, "Route", "r3", "q.r3", "GET", "/a")],
        "id long, label string, name string, qname string, method string, path string",
    )
    edges = spark.createDataFrame([(3, 2, "HANDLES_ROUTE"), (4, 7, "HANDLES_ROUTE"), (2, 4, "CALLS"), (2, 99, "CALLS"), (5, 3, "STEP_IN_PROCESS"), (6, 3, "STEP_IN_PROCESS"), (6, 4, "STEP_IN_PROCESS"), (4, 3, "TESTS"), (5, 3, "TESTS")], "src long, dst long, type string")
    changed = spark.createDataFrame([(1,), (3,), (4,), (6,)], "id long")
    got = {(r["method"], r["path"]): (r["handler"], r["consumers"]) for r in impact.affected_routes(nodes, edges, changed).collect()}
    assert got == {("GET", "/a"): ("q.r1", []), ("POST", "/b"): ("q.f", ["node-99", "q.g"])}
    got = {r["process"]: (r["severity"], r["steps"]) for r in impact.affected_processes(nodes, edges, changed).collect()}
    assert got == {"p": ("degraded", ["f"]), "p2": ("blocked", ["f", "g"])}
    assert rows(impact.affected_tests(nodes, edges, changed), "test", "symbol", "impact") == {(4, 3, "direct"), (5, 3, "indirect")}


def test_blast_radius_and_chains(spark):
    edges = spark.createDataFrame([(1, 2, 10), (1, 3, 4), (2, 4, 1), (4, 1, 1), (3, 4, 7), (4, 5, 1), (6, 5, 10)], "src long, dst long, weight int")
    start = spark.createDataFrame([(1,)], "id long")
    assert rows(crossrepo.blast_radius(edges, start), "repo", "depth", "kind", "severity", "critical") == {(2, 1, "direct", "critical", True), (3, 1, "direct", "medium", False), (4, 2, "transitive", "high", False), (5, 3, "transitive", "critical", False)}
    got = {(tuple(r["path"]), r["criticality"]) for r in crossrepo.dependency_chains(edges, start).collect()}
    assert got == {((1, 2, 4, 5), "critical"), ((1, 3, 4, 5), "critical")}
    line = spark.createDataFrame([(i, i + 1, 1) for i in range(6)], "src long, dst long, weight int")
    with pytest.raises(RuntimeError):
        crossrepo.dependency_chains(line, spark.createDataFrame([(0,)], "id long"), most_depth=3)
    with pytest.raises(RuntimeError):
        traverse.topological_levels(line, spark.createDataFrame([(i,) for i in range(7)], "id long"), most=3)


def test_exact_jaccard_is_all_pairs(spark):
    rnd = random.Random(2)
    sets = [(i, sorted({rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 9))})) for i in range(60)]
    got = rows(crossrepo.exact_jaccard(spark.createDataFrame(sets, "id long, items array<string>"), 0.6), "a", "b")
    want = {(i, j) for i, x in sets for j, y in sets if i < j and x and y and len({*x} & {*y}) >= 0.6 * len({*x} | {*y})}
    assert got == want and want


def test_copies_of_files_are_one_row_for_two_repositories(spark):
    made = [(r, f"{r}{k}", "Function", n) for r in ("x", "y", "z") for k in range(4) for n in ("a", "b", "c", "d")] + [("y", "odd", "Function", n) for n in ("a", "b", "c", "d", "e")] + [("x", "none", None, None), ("z", "none", None, None)]
    got = rows(crossrepo.cross_repo_duplicates(spark.createDataFrame(made, "repo string, file string, label string, name string")), "repo_a", "file_a", "files_a", "repo_b", "file_b", "files_b", "similarity")
    copies = {("x", "x0", 4, "y", "y0", 4, 1.0), ("x", "x0", 4, "z", "z0", 4, 1.0), ("y", "y0", 4, "z", "z0", 4, 1.0)}
    assert got == copies | {("x", "x0", 4, "y", "odd", 1, 0.8), ("y", "odd", 1, "z", "z0", 4, 0.8), ("x", "none", 1, "z", "none", 1, 1.0)}


def test_breaking_changes_tell_renames(spark):
    kind = "symbol string, params array<string>, required int, returns string, body string"
    before = spark.createDataFrame([("a", ["x"], 1, "int", "1"), ("b", ["x"], 1, "int", "2"), ("c", ["x", "y"], 1, "int", "3"), ("d", ["x"], 1, None, "4"), ("e", ["x"], 1, "int", "5")], kind)
    after = spark.createDataFrame([("a2", ["x"], 1, "int", "1"), ("a1", ["x"], 1, "int", "1"), ("c", ["x", "z"], 2, "int", "9"), ("d", ["x"], 1, "str", "4"), ("e", ["q"], 1, "int", "5")], kind)
    uses = spark.createDataFrame([("a", "r1"), ("a", "r2"), ("c", "r1"), ("d", "r1"), ("a", "r1")], "symbol string, repo string")
    assert rows(crossrepo.breaking_changes(before, after, uses), "symbol", "change", "new_name", "repos") == {
        ("a", "renamed", "a1", 2), ("b", "removed", None, 0), ("c", "signature_changed", None, 1), ("c", "parameter_added_required", None, 1), ("c", "parameter_removed", None, 1), ("d", "signature_changed", None, 1), ("d", "return_type_changed", None, 1),
    }


def test_routes_by_rules_and_traces(spark):
    rules = [crossrepo.RouteRule("web", ("js",), r"\b(?:app|router)\.(get|post)\(\s*['\"]([^'\"]+)['\"]", 2, 1), crossrepo.RouteRule("marked", ("py",), r"@route\(['\"]([^'\"]*)['\"]\)", 1, method="any")]
    files = spark.createDataFrame([("a.js", "js", "x\napp.get('/u', f); router.post(\"v\")"), ("b.py", "py", "@route('')\n@route('/w')"), ("c.js", "js", None)], "file string, language string, text string")
    assert rows(crossrepo.detect_routes(files, rules), "file", "line", "framework", "method", "path") == {("a.js", 2, "web", "GET", "/u"), ("a.js", 2, "web", "POST", "/v"), ("b.py", 1, "marked", "ANY", "/"), ("b.py", 2, "marked", "ANY", "/w")}
    nodes = spark.createDataFrame([(1, "A", "m.Run", "run"), (2, "B", "n.go", "go"), (3, "C", "o.end", "end"), (4, "A", "m.x", "x")], "id long, repo string, qname string, name string")
    edges = spark.createDataFrame([(1, 2, "CROSS_REPO_CALLS"), (2, 3, "CROSS_REPO_USES"), (2, 1, "CALLS"), (1, 4, "CROSS_REPO_CALLS"), (2, 99, "CROSS_REPO_CALLS")], "src long, dst long, type string")
    seeds = spark.createDataFrame([("A", "RUN")], "repo string, symbol string")
    assert rows(crossrepo.trace_symbol(nodes, edges, seeds), "source", "target", "kind", "depth") == {("m.Run", "n.go", "CROSS_REPO_CALLS", 1), ("m.Run", "o.end", "transitive_CROSS_REPO_USES", 2)}
    assert rows(crossrepo.trace_symbol(nodes, edges, seeds, ["A", "B"]), "target") == {("n.go",)}
