"""Dominators, slices, taint and summaries on small programs against plain versions."""

import random

from loomgraph.operators import dataflow, security, summaries


def made_cfgs(seed, fns=12):
    rnd = random.Random(seed)
    blocks, edges = [], set()
    for f in range(fns):
        n = rnd.randint(1, 9)
        blocks += [(f, b) for b in range(n)]
        edges |= {(f, b, b + 1) for b in range(n - 1) if rnd.random() < 0.8}
        edges |= {(f, rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randint(0, 2 * n))}
    # A block that is settled late at the head of a loop: its dominator's own chain shrinks first.
    blocks += [(99, b) for b in range(7)]
    edges |= {(99, 0, 1), (99, 1, 2), (99, 2, 3), (99, 3, 4), (99, 4, 3), (99, 0, 5), (99, 5, 6), (99, 6, 2)}
    return blocks, sorted(edges)


def doms_of(blocks, edges):
    out = set()
    for f in {b[0] for b in blocks}:
        own = [b for g, b in blocks if g == f]
        next_ = {b: [d for g, s, d in edges if g == f and s == b] for b in own}

        def seen(without=None):
            found, todo = set(), [0] if without != 0 else []
            while todo:
                b = todo.pop()
                if b not in found and b != without:
                    found.add(b)
                    todo += next_[b]
            return found

        inside = seen()
        out |= {(f, b, d) for d in inside for b in inside if b not in seen(d)}
    return out


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_dominator_sets_tree_and_frontier(spark):
    blocks, edges = made_cfgs(4)
    b, e = spark.createDataFrame(blocks, "fn long, block long"), spark.createDataFrame(edges, "fn long, src long, dst long")
    want = doms_of(blocks, edges)
    doms = dataflow.dominator_sets(e, b)
    assert rows(doms, "fn", "block", "dom") == want == rows(dataflow.dominators(e, b), "fn", "block", "dom")
    tree = {(r["fn"], r["block"]): r for r in dataflow.dominator_tree(doms).collect()}
    strict = {(f, x): {d for g, y, d in want if (g, y) == (f, x) and d != x} for f, x, _ in want}
    for (f, x), above in strict.items():
        idom = [d for d in above if all(o == d or o in strict[f, d] for o in above)]
        assert tree[f, x]["idom"] == (idom[0] if idom else None) and tree[f, x]["depth"] == len(above)
        assert tree[f, x]["children"] == sorted(y for (g, y), r in tree.items() if g == f and r["idom"] == x)
    front = {(f, d, t) for f, s, t in edges for g, x, d in want if (g, x) == (f, s) and d not in strict[f, t]}
    assert rows(dataflow.dominance_frontier(e, doms), "fn", "block", "frontier") == front


def test_slices(spark):
    dep = [(1, 0, 1, "control"), (1, 1, 2, "data"), (1, 2, 1, "data"), (1, 3, 2, "control"), (2, 0, 1, "data")]
    df = spark.createDataFrame(dep, "fn long, src long, dst long, kind string")
    at = spark.createDataFrame([(1, 2), (2, 1)], "fn long, block long")
    assert rows(dataflow.slices(df, at), "fn", "origin", "block") == {(1, 2, 2), (1, 2, 1), (1, 2, 0), (1, 2, 3), (2, 1, 1), (2, 1, 0)}
    assert rows(dataflow.slices(df, at, kinds=["data"]), "fn", "origin", "block") == {(1, 2, 2), (1, 2, 1), (2, 1, 1), (2, 1, 0)}
    assert rows(dataflow.slices(df, at, "forward"), "fn", "origin", "block") == {(1, 2, 2), (1, 2, 1), (2, 1, 1)}


def test_def_use_taint_keeps_what_is_least_neutralised(spark):
    rnd = random.Random(2)
    for case in range(1):
        flows = {(f, rnd.randrange(7), rnd.randrange(7)) for f in range(6) for _ in range(10)}
        sources = {(f, rnd.randrange(7)) for f in range(6)}
        sinks = {(f, rnd.randrange(7), 1 << rnd.randrange(3)) for f in range(6) for _ in range(4)}
        clean = {(f, rnd.randrange(7), rnd.randrange(8)) for f in range(6) for _ in range(2)}
        mask = {}
        for f, b, m in clean:
            mask[f, b] = mask.get((f, b), 0) | m
        states, todo = set(), [(f, b, b, 0) for f, b in sources]
        while todo:
            s = todo.pop()
            if s not in states:
                states.add(s)
                todo += [(s[0], s[1], u, s[3] | mask.get((s[0], u), 0)) for f, d, u in flows if (f, d) == (s[0], s[2])]
        want = {(f, o, u, k) for f, o, p, m in states for g, d, u in flows if (g, d) == (f, p) for h, b, k in sinks if (h, b) == (f, u) and not m & k}
        want |= {(f, b, b, k) for f, b in sources for h, c, k in sinks if (h, c) == (f, b) and not mask.get((f, b), 0) & k}
        frame = lambda x, s: spark.createDataFrame(sorted(x), s)
        got = dataflow.def_use_taint(frame(flows, "fn long, def_block long, use_block long"), frame(sources, "fn long, block long"), frame(sinks, "fn long, block long, kind int"), frame(clean, "fn long, block long, mask int"))
        assert rows(got, "fn", "source", "sink", "kind") == want, case


def solved(flows, calls):
    """All masks, not the least only, to the fix point."""
    callee = {c: g for c, _, g in calls}
    every = set(flows)
    while True:
        back = {(f, s, m) for f, sk, s, dk, _, _, m in every if (sk, dk) == ("param", "return")}
        new = {(f, sk, s, ek, e, ea, m | n | o) for f, sk, s, dk, d, a, m in every if dk == "arg" for g, p, n in back if (callee.get(d), a) == (g, p) for h, rk, r, ek, e, ea, o in every if (rk, r) == ("result", d)}
        if new <= every:
            break
        every |= new
    states = set()
    todo = [(s, ("source", f, s), 0) for f, sk, s, *_ in every if sk == "source"]
    found = set()
    while todo:
        o, (kind, fn, n), m = todo.pop()
        if (o, kind, fn, n, m) in states:
            continue
        states.add((o, kind, fn, n, m))
        for f, sk, s, dk, d, a, w in every:
            if (f, sk, s) != (fn, kind, n):
                continue
            if dk == "sink" and not (m | w) & a:
                found.add((o, fn, d, a))
            if dk == "arg" and d in callee:
                todo.append((o, ("param", callee[d], a), m | w))
            if dk == "return" and kind != "param":
                todo += [(o, ("result", g, c), m | w) for c, g, h in calls if h == fn]
    return found


FLOWS = "fn long, src_kind string, src long, dst_kind string, dst long, arg int, mask int"


def test_a_value_returned_by_a_callee_reaches_the_callers_sink(spark):
    flows = [(1, "source", 7, "arg", 10, 0, 0), (1, "result", 10, "sink", 50, 1, 0), (2, "param", 0, "return", 0, 0, 2), (1, "result", 10, "sink", 51, 2, 0), (3, "result", 30, "sink", 52, 1, 0)]
    calls = [(10, 1, 2), (30, 3, 2)]
    got = rows(summaries.findings(spark.createDataFrame(flows, FLOWS), spark.createDataFrame(calls, "call long, fn long, callee long")), "source", "fn", "sink", "kind")
    # What goes into the callee of one call does not come out of another; kind 2 is neutralised inside it.
    assert got == {(7, 1, 50, 1)} == solved(flows, calls)


def test_summaries_on_made_programs(spark):
    rnd = random.Random(12)
    for case in range(1):
        calls = [(100 + c, rnd.randrange(6), rnd.randrange(6)) for c in range(9)]
        flows = set()
        for c, f, _ in calls:
            flows |= {(f, "param", rnd.randrange(2), "arg", c, rnd.randrange(2), rnd.choice([0, 0, 1, 2]))}
            flows |= {(f, "result", c, *rnd.choice([("return", 0, 0), ("sink", 900 + c, 1), ("sink", 900 + c, 2), ("arg", rnd.choice([x for x, g, _ in calls if g == f]), rnd.randrange(2))]), rnd.choice([0, 0, 4, 1]))}
        flows |= {(f, "param", rnd.randrange(2), "return", 0, 0, rnd.choice([0, 1, 2])) for f in range(6) for _ in range(2)}
        flows |= {(f, "param", rnd.randrange(2), "sink", 800 + f, rnd.choice([1, 2]), 0) for f in range(3)}
        flows |= {(f, "source", 700 + f, "arg", c, rnd.randrange(2), 0) for c, f, _ in calls[:4]} | {(5, "source", 790, "return", 0, 0, 1), (4, "source", 791, "sink", 891, 1, 0), (4, "source", 792, "sink", 892, 1, 1)}
        got = rows(summaries.findings(spark.createDataFrame(sorted(flows), FLOWS), spark.createDataFrame(calls, "call long, fn long, callee long")), "source", "fn", "sink", "kind")
        assert got == solved(flows, calls) and got, case


def test_sources_are_followed_only_towards_sinks(spark, monkeypatch):
    flows = [(1, "source", 7, "arg", 10, 0, 0), (2, "param", 0, "sink", 50, 1, 0)] + [(1, "source", 7, "arg", 100 + k, 0, 0) for k in range(30)] + [(200 + k, "param", 0, "arg", 300 + k, 0, 0) for k in range(30)]
    calls = [(10, 1, 2)] + [(100 + k, 1, 200 + k) for k in range(30)] + [(300 + k, 200 + k, 500) for k in range(30)]
    made = {}

    def counted(df, name="step", keep=summaries.written):
        out = keep(df, name)
        if "origin" in out.columns:
            made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(summaries, "written", counted)
    got = rows(summaries.findings(spark.createDataFrame(flows, FLOWS), spark.createDataFrame(calls, "call long, fn long, callee long")), "source", "fn", "sink", "kind")
    assert got == {(7, 2, 50, 1)} == solved(flows, calls)
    assert sum(made.values()) == 1  # the other 60 places of the source lead nowhere


def test_propagation_from_seeds_with_masks(spark):
    seeds = spark.createDataFrame([(0, 0, 3), (0, 0, 1), (0, 0, 2)], "origin long, place long, mask int")
    flows = spark.createDataFrame([(0, 1, 0), (1, 0, 4)], "src long, dst long, mask int")
    assert rows(security.propagate(seeds, flows), "place", "mask") == {(0, 1), (0, 2), (1, 1), (1, 2)}


def test_propagation_along_a_long_chain(spark):
    flows = spark.createDataFrame([(i, i + 1, 1 << (i % 3)) for i in range(16)], "src long, dst long, mask int")
    got = rows(security.propagate(spark.createDataFrame([(0, 0)], "origin long, place long"), flows), "place", "mask")
    assert got == {(i, (1 << min(i, 3)) - 1) for i in range(17)}


def test_summary_taint_composes_as_deep_as_calls_lie(spark):
    import duckdb

    from loomgraph.plans.programs import COMPOSED, summary_taint

    flows, calls = [], []
    for first, deep in ((100, 3), (200, 4)):  # a source's value comes back through calls that lie in each other
        flows += [(first, "source", first, "arg", first, 0, 0), (first, "result", first, "sink", first, 1, 0), (first + deep, "param", 0, "return", 0, 0, 0)]
        for k in range(deep):
            calls.append((first + k, first + k, first + k + 1))
            if k:
                flows += [(first + k, "param", 0, "arg", first + k, 0, 0), (first + k, "result", first + k, "return", 0, 0, 0)]
    con = duckdb.connect()
    con.execute("create table flows (fn bigint, src_kind varchar, src bigint, dst_kind varchar, dst bigint, arg int, mask int)")
    con.execute('create table calls ("call" bigint, fn bigint, callee bigint)')
    con.executemany("insert into flows values (?, ?, ?, ?, ?, ?, ?)", flows)
    con.executemany("insert into calls values (?, ?, ?)", calls)
    flows = spark.createDataFrame(flows, "fn long, src_kind string, src long, dst_kind string, dst long, arg int, mask int")
    calls = spark.createDataFrame(calls, "call long, fn long, callee long")
    # Both to the fix point; three rounds would leave out the one that lies four calls deep.
    assert sorted(con.execute(f"with {COMPOSED} select src from f3 where src_kind = 'source' and dst_kind = 'sink'").fetchall()) == [(100,), (200,)]
    assert sorted(r["source"] for r in summary_taint(flows, calls).collect()) == [100, 200]
    assert sorted(r["source"] for r in summaries.findings(flows, calls).collect()) == [100, 200]


def test_a_bounded_graph_settles_in_tasks_as_by_joins(spark, monkeypatch):
    rnd = random.Random(3)
    made = sorted({(rnd.randrange(40), rnd.randrange(40), rnd.choice([0, 1, 2, 4, 5])) for _ in range(90)} | {(900, 901, 0)})
    flows = spark.createDataFrame(made, "src long, dst long, mask int")
    seeds = spark.createDataFrame([(o, o % 45, o % 3 % 2 * 2) for o in range(150)] + [(3, 7, 1), (3, 3, 0)], "origin long, place long, mask int")
    tables = []

    def counted(df, name="step", keep=security.written):
        tables.append(name)
        return keep(df, name)

    monkeypatch.setattr(security, "written", counted)
    got = sorted(tuple(r) for r in security.propagate(seeds, flows).collect())
    assert "states" not in tables  # no rounds of joins
    monkeypatch.setattr(security, "FLOWS_IN_TASK", 0)
    assert got == sorted(tuple(r) for r in security.propagate(seeds, flows).collect()) and "states" in tables
    assert (44, 44, 0) in got and len(got) > 1000


def test_origins_of_one_state_travel_as_bits(spark, monkeypatch):
    tables = {}

    def counted(df, name="step", keep=security.written):
        out = keep(df, name)
        tables.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(security, "written", counted)
    seeds = spark.createDataFrame([(o, 0) for o in range(128)] + [(7, 2), (None, 1)], "origin long, place long")
    flows = spark.createDataFrame([(k, k + 1, k % 2) for k in range(4)] + [(0, 4, 0)], "src long, dst long, mask int")
    got = {tuple(r) for r in security.propagate(seeds, flows).collect()}
    want = {(o, p, m) for o in range(128) for p, m in ((0, 0), (1, 0), (2, 1), (3, 1), (4, 0))}
    want = want - {(7, 2, 1), (7, 3, 1)} | {(7, 2, 0), (7, 3, 0), (None, 1, 0), (None, 2, 1), (None, 3, 1), (None, 4, 1)}
    assert got - {(None, 4, 0)} == want - {(None, 4, 0)}
    assert sum(tables["states"]) < 40  # 650 states, 64 origins to a row
