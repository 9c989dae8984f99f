"""Operators of retrieval, taint and reports on small rows."""

import random

from pyspark.sql import functions as F

from loomgraph.operators import quality, reports, retrieval, security, similarity


def test_index_is_the_scan_and_is_refreshed(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma"), (3, "delta alphabet"), (4, "")], "doc_id long, text string")
    index = retrieval.build_index(docs)
    query = ["alpha", "beta", "beta"]
    many = retrieval.build_index(docs, parts=5)
    assert {r["id"]: r["hits"] for r in retrieval.prefix_search(spark, many, ["al", "be"]).collect()} == {1: 3}
    score = lambda df: {r["id"]: round(r["score"], 9) for r in df.collect()}
    assert score(retrieval.index_search(spark, index, query)) == score(retrieval.bm25(docs, query)) != {}
    assert {r["id"]: r["hits"] for r in retrieval.prefix_search(spark, index, ["al", "be"]).collect()} == {1: 3}
    changed = spark.createDataFrame([(2, "beta"), (5, "alpha")], "doc_id long, text string")
    after = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta"), (4, ""), (5, "alpha")], "doc_id long, text string")
    new = retrieval.refresh_index(index, changed, spark.createDataFrame([(3,)], "id long"))
    assert score(retrieval.index_search(spark, new, query)) == score(retrieval.bm25(after, query))
    new = retrieval.refresh_index(many, changed, spark.createDataFrame([(3,)], "id long"))
    assert score(retrieval.index_search(spark, new, query)) == score(retrieval.bm25(after, query))
    assert new.parts == 5 and not {r["id"] for r in spark.read.parquet(f"{new.folder}/postings").collect()} & {3}


def test_propagation_keeps_what_is_least_neutralised(spark):
    seeds = spark.createDataFrame([(0, 0)], "origin long, place long")
    flows = spark.createDataFrame([(0, 1, 1), (0, 2, 0), (2, 1, 2), (1, 3, 0), (3, 1, 4)], "src long, dst long, mask int")
    got = {(r["place"], r["mask"]) for r in security.propagate(seeds, flows).collect()}
    assert {(0, 0), (1, 1), (1, 2), (2, 0), (3, 1), (3, 2)} == got
    sinks = spark.createDataFrame([(3, 1), (3, 2), (3, 4)], "place long, kind int")
    assert {r["kind"] for r in security.findings(security.propagate(seeds, flows), sinks).collect()} == {1, 2, 4}


def test_near_clones_against_all_pairs(spark):
    words = [f"w{k}" for k in range(40)]
    rows = [(k, words[: 40 - k % 4] + [f"x{k % 7}"]) for k in range(12)] + [(90, []), (91, []), (92, ["a"])]
    got = {(r["a"], r["b"]) for r in similarity.similar_pairs(spark.createDataFrame(rows, "id long, items array<string>"), 0.9, 18, 7).collect()}
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x and y and len({*x} & {*y}) >= 0.9 * len({*x} | {*y})}
    assert want - got == set() == got - want


def test_near_clones_of_copies_are_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "COPIES", 2, raising=False)  # so that a class of five is three parts
    words = [f"w{k}" for k in range(40)]
    rows = [(k, words[::-1] if k % 2 else words) for k in (4, 1, 9, 7, 2)] + [(k, words[:-1] + ["x"]) for k in (3, 8, 5)] + [(6, ["y"])]
    got = [tuple(r) for r in similarity.similar_pairs(spark.createDataFrame(rows, "id long, items array<string>"), 0.9, 18, 7).collect()]
    want = {(a, b, len({*x} & {*y}) / len({*x} | {*y})) for a, x in rows for b, y in rows if a < b and 6 not in (a, b)}
    assert sorted(got) == sorted(want) and len(want) == 28


def test_ids_of_one_signature_all_meet(spark):
    rows = [(1, [1, 2, 3, 4]), (2, [1, 2, 3, 4]), (3, [1, 2, 3, 4]), (4, [1, 2, 9, 9]), (5, [1, 2, 9, 9]), (6, [7, 7, 7, 7])]
    got = [tuple(r) for r in similarity.band_pairs(spark.createDataFrame(rows, "id long, signature array<long>"), 2, 2).collect()]
    assert sorted(got) == [(a, b) for a in range(1, 6) for b in range(a + 1, 6)]


def test_files_are_matched_in_tasks_as_by_joins(spark, monkeypatch):
    rnd = random.Random(4)
    ranges = lambda n, wide: [(k * 7 % 1000, f"f{rnd.choice([0, 1, 1, 2])}", s, s + rnd.randint(1, wide)) for k in range(n) for s in [rnd.randrange(60)]]
    found = spark.createDataFrame(ranges(120, 12) + [(2000, None, 1, 5), (2001, "f0", 9, 2), (2002, "alone", 1, 5)], "id long, file string, start long, end long")
    truth = spark.createDataFrame(ranges(60, 14) + [(3000, "f9", 1, 5)], "id long, file string, start long, end long")
    tables = []

    def counted(df, name="step", keep=quality.written):
        tables.append(name)
        return keep(df, name)

    monkeypatch.setattr(quality, "written", counted)
    got = sorted(tuple(r) for r in quality.greedy_matches(found, truth, 0.4).collect())
    assert "pairs" not in tables and len(got) > 30
    for most in (0, 1500):  # all files by joins, then the largest only
        monkeypatch.setattr(quality, "PAIRS_AT_ONCE", most, raising=False)
        assert sorted(tuple(r) for r in quality.greedy_matches(found, truth, 0.4).collect()) == got and "pairs" in tables
        del tables[:]


def test_as_of_and_merge(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t long")
    right = spark.createDataFrame([("a", 1, 10), ("a", 6, 20)], "k string, t long, v long")
    assert {(r["k"], r["t"], r["v"]) for r in reports.as_of(left, right, "k", "t", "v").collect()} == {("a", 5, 10), ("a", 1, 10), ("b", 9, None)}
    comments = spark.createDataFrame([(1, "f", "c", 1, 4), (2, "f", "c", 2, 8), (3, "f", "c", 7, 9), (4, "f", "d", 1, 4)], "id long, path string, category string, start long, end long")
    assert {r["id"] for r in reports.merge_comments(comments).collect()} == {1, 3, 4}


def test_signatures_hash_each_item_once(spark):
    rows = [(k, [f"w{j}" for j in range(k)]) for k in range(6)] + [(7, ["a", None]), (8, None), (9, ["x" * 9 + str(j) for j in range(40000)])]
    df = spark.createDataFrame(rows, "id long, items array<string>")
    got = {r["id"]: r["signature"] for r in similarity.minhash(df, 5).collect()}
    plain = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda s: F.coalesce(F.array_min(F.transform("items", lambda x: F.xxhash64(x, s))), F.lit((1 << 63) - 1)))
    assert got == {r["id"]: r["s"] for r in df.select("id", plain.alias("s")).collect()}
    assert "ArrowEvalPython" in similarity.minhash(df, 5)._jdf.queryExecution().executedPlan().toString()
