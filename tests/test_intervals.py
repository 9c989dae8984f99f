"""Joins of ranges against all pairs."""

import random

from loomgraph.operators import intervals, quality, reports, resolution, review


def made(n, seed, hot=0.4):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        start = rnd.choice([rnd.randint(-50, 400), rnd.randint(0, 200_000)])
        rows.append((i, "hot" if rnd.random() < hot else f"f{rnd.randint(0, 5)}", start, start + rnd.choice([0, 3, 31, 32, 33, rnd.randint(0, 3000)])))
    return rows + [(n, "hot", 5, 100_004), (n + 1, "hot", None, 4), (n + 2, None, 1, 9), (n + 3, "hot", 9, 2), (n + 4, "hot", 3, None), (n + 5, "f1", 0, 0), (n + 6, "hot", 0, 1 << 22)]


SCHEMA = "id long, file string, start long, end long"
good = lambda r: None not in r and r[2] <= r[3]


def test_overlaps_are_all_pairs(spark):
    a, b = made(250, 1), made(200, 2)
    got = sorted((r["id"], r["r_id"]) for r in intervals.overlaps(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), ["file"]).collect())
    want = sorted((x[0], y[0]) for x in a for y in b if good(x) and good(y) and x[1] == y[1] and x[2] <= y[3] and x[3] >= y[2])
    assert got == want and len(got) > 1000


def test_blocks_hold_each_place_once(spark):
    cases = [(0, 0), (5, 100_004), (-70, 2000), (31, 32), (0, 1 << 21), (1023, 1024), (32, 1055)]
    df = spark.createDataFrame(cases, "a long, b long")
    for (a, b), r in zip(cases, df.select(intervals.blocks(df["a"], df["b"]).alias("x")).collect()):
        width = [32, 1024, 32768]
        spans = sorted((x["bin"] * width[x["level"]], (x["bin"] + 1) * width[x["level"]]) for x in r["x"])
        assert all(p[1] == q[0] for p, q in zip(spans, spans[1:])) and spans[0][0] <= a < spans[0][0] + 32 and spans[-1][1] - 32 <= b < spans[-1][1]
        assert len(spans) < 200


def test_callers_take_the_first_symbol_and_no_reversed_one(spark):
    symbols = made(150, 3)
    refs = [(i, f, s) for i, f, s, _ in made(300, 4)]
    got = {r["id"]: r["caller"] for r in resolution.callers(spark.createDataFrame(refs, "id long, file string, line long"), spark.createDataFrame(symbols, "id long, file string, line_start long, line_end long")).collect()}
    want = {}
    for i, f, line in refs:
        held = [(s[2], s[0]) for s in symbols if good(s) and line is not None and s[1] == f and s[2] <= line <= s[3]]
        if held:
            want[i] = min(held)[1]
    assert got == want


def iou(a, b):
    shared = max(0, min(a[3], b[3]) - max(a[2], b[2]) + 1)
    return shared / ((a[3] - a[2] + 1) + (b[3] - b[2] + 1) - shared)


def test_greedy_matches_are_the_sequential_ones(spark):
    rnd = random.Random(6)
    some = lambda n, k: [(i, f"f{i % 3}", s, s + rnd.randint(3, 12)) for i in range(n) for s in [rnd.randint(0, k)]]
    found, truth = some(120, 60), some(90, 60)
    free, want = dict((t[0], t) for t in truth), {}
    for d in found:
        best = max(((iou(d, t), -k) for k, t in free.items() if t[1] == d[1] and iou(d, t) >= 0.5), default=None)
        if best:
            want[d[0]] = -best[1]
            del free[-best[1]]
    got = {r["id"]: r["truth_id"] for r in quality.greedy_matches(spark.createDataFrame(found, SCHEMA), spark.createDataFrame(truth, SCHEMA)).collect()}
    assert got == want and len(want) > 60
    kept = {r["id"] for r in quality.without_overlaps(spark.createDataFrame(found, SCHEMA), spark.createDataFrame(truth, SCHEMA)).collect()}
    assert kept == {d[0] for d in found if not any(d[1] == t[1] and iou(d, t) > 0.5 for t in truth)}


def test_comments_that_share_lines_with_an_earlier_one(spark):
    rows = [(i, f"p{i % 2}", f"c{i % 3}", s, None if e is None else e) for i, _, s, e in made(150, 7)]
    got = {r["id"] for r in reports.merge_comments(spark.createDataFrame(rows, "id long, path string, category string, start long, end long")).collect()}
    ok = lambda r: None not in r
    want = {r[0] for r in rows if not (ok(r) and any(ok(q) and q[0] < r[0] and q[1:3] == r[1:3] and min(q[4], r[4]) - max(q[3], r[3]) + 1 >= 3 for q in rows))}
    assert got == want


def test_greedy_merge_is_the_sequential_one(spark):
    """Similarity is not transitive: a takes b, so c, which is like b only, is a seed of its own."""
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(12)]
    rows = [(1, "f", 1, 9, "low", "a b c d e f g h i j"), (2, "f", 5, 12, "high", "a b c d e f g h i k"), (3, "f", 6, 20, "info", "a b c d e f g h l k"), (4, "f", 1, 9, "critical", None), (5, "f", 2, 3, "low", "")]
    base = [rnd.sample(words, 10) for _ in range(6)]
    for i in range(10, 160):
        text = list(rnd.choice(base))
        text[rnd.randrange(10)] = rnd.choice(words)
        s = rnd.randint(1, 40)
        rows.append((i, f"f{i % 3}", s, s + rnd.randint(0, 9), rnd.choice(review.SEVERITIES), " ".join(text)))
    rows += [(i + 200, *r[1:]) for i, r in enumerate(rows[8:30])]
    bag = lambda t: set((t or "").lower().split()) or {""}
    alike = lambda a, b: a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3] and len(bag(a[5]) & bag(b[5])) / len(bag(a[5]) | bag(b[5])) > 0.7
    used, want = set(), []
    for i, a in enumerate(rows):
        if i in used:
            continue
        group = [a] + [rows[j] for j in range(i + 1, len(rows)) if j not in used and alike(a, rows[j])]
        used |= {rows.index(g) for g in group}
        top = min(group, key=lambda g: (review.SEVERITIES.index(g[4]), g[0]))
        want.append((a[0], top[0], min(g[2] for g in group), max(g[3] for g in group), len(group)))
    df = spark.createDataFrame(rows, "id long, path string, start long, end long, severity string, content string")
    got = sorted((r["seed"], r["id"], r["start"], r["end"], r["merged"]) for r in review.merge_similar(df).collect())
    assert got == sorted(want)
    assert any(w[4] > 1 for w in want)


def test_exploded_ranges_are_not_sent_through_the_driver(spark):
    points = spark.range(100).selectExpr("id % 3 as k", "id as at")
    ranges = spark.range(100).selectExpr("id % 3 as k", "id as start", "id + 5 as `end`", "id as r")
    plan = intervals.stab(points, ranges, ["k"], "at")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
