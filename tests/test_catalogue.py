"""Each registered query of the catalogue against its SQL in another engine."""

import math
import struct
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph.functions import scalars
from loomgraph.operators import retrieval

from loomgraph.plans import analysis, catalogue, derive, measures, programs, repos
from loomgraph.streaming import windows

PLANS = [catalogue, analysis, programs, repos, measures]
QUERIES = {k: q for plan in PLANS for k, q in plan.QUERIES.items()}
ORACLES = {k: q for plan in PLANS for k, q in plan.ORACLES.items()}

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 4)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(v) for _, v in sorted(zip(names, r))) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(v) for _, v in sorted(zip(df.columns, r))) for r in df.collect()), key=repr)
    assert got == want


# ---- queries without SQL


def collected(spark, name):
    return QUERIES[name](spark, SF).collect()


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_every_query_without_sql_has_a_test_here():
    assert set(QUERIES) - set(ORACLES) == {"louvain", "leiden", "hashed_ngram_embedding", "minhash_signature", "near_clone", "detection_match", "bootstrap_ci", "token_bucket"}


def test_communities_cover_the_graph_and_are_good(spark):
    edges = derive.copart(spark, SF).edges.select("src", "dst", "weight").collect()
    nodes = {r["src"] for r in edges} | {r["dst"] for r in edges}
    k, m2 = Counter(), 0.0
    for a, b, w in edges:
        k[a], k[b], m2 = k[a] + w, k[b] + w, m2 + 2 * w
    near = defaultdict(set)
    for a, b, _ in edges:
        near[a].add(b)
        near[b].add(a)
    value = {}
    for name in ("louvain", "leiden"):
        of = {r["id"]: r["community"] for r in collected(spark, name)}
        assert set(of) == nodes
        all_ = Counter()
        for n, c in of.items():
            all_[c] += k[n]
        value[name] = sum(2 * w for a, b, w in edges if of[a] == of[b]) / m2 - sum((x / m2) ** 2 for x in all_.values())
        assert value[name] > 0
        if name == "leiden":
            for c in set(of.values()):
                own = {n for n in of if of[n] == c}
                seen, todo = set(), [min(own)]
                while todo:
                    n = todo.pop()
                    if n not in seen:
                        seen.add(n)
                        todo += near[n] & own
                assert seen == own and c == min(own)
    assert value["leiden"] >= 0.95 * value["louvain"]


def test_hashed_embeddings(spark):
    got = defaultdict(dict)
    for r in collected(spark, "hashed_ngram_embedding"):
        got[r["id"]][r["bucket"]] = r["value"]
    for r in table(spark, "documents").where("doc_id % 20 = 0").collect():
        padded = "  " + r["text"].lower() + "  "
        sums = Counter()
        for i in range(len(padded) - 2):
            h = xxhash.xxh64_intdigest(padded[i : i + 3].encode(), seed=42)
            signed = h - (1 << 64) if h >> 63 else h
            sums[signed % 256] += 1 if (h >> 32) % 2 == 0 else -1
        norm = math.sqrt(sum(v * v for v in sums.values()))
        assert got[r["doc_id"]] == pytest.approx({b: v / norm for b, v in sums.items()})


def test_minhash_signatures(spark):
    got = {r["id"]: r["signature"] for r in collected(spark, "minhash_signature")}
    parts = table(spark, "part").select("p_partkey", scalars.name_tokens("p_name").alias("items")).collect()
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for r in parts:
        want = [min(signed(xxhash.xxh64_intdigest(struct.pack("<i", s), seed=xxhash.xxh64_intdigest(x.encode(), seed=42))) for x in r["items"]) for s in range(16)]
        assert list(got[r["p_partkey"]]) == want
    assert len(got) == len(parts)


def test_near_clones_are_real_and_most_are_found(spark):
    sets = {r["id"]: set(r["items"]) for r in table(spark, "documents").select(F.col("doc_id").alias("id"), scalars.ngrams(scalars.code_tokens(F.col("text")), 5).alias("items")).collect()}
    got = {(r["a"], r["b"]): r["similarity"] for r in collected(spark, "near_clone")}
    ids = sorted(sets)
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert set(got) <= set(want) and all(got[p] == pytest.approx(want[p]) for p in got)
    assert len(got) >= 0.9 * len(want) > 0


def test_detection_matches_are_the_sequential_ones(spark):
    found, truth = ([tuple(r) for r in df.select("id", "file", "start", "end").collect()] for df in catalogue._ranges(spark, SF))
    by_file = defaultdict(dict)
    for t in truth:
        by_file[t[1]][t[0]] = t
    want = {}
    for d in sorted(found):
        best = None
        for t in by_file[d[1]].values():
            shared = max(0, min(d[3], t[3]) - max(d[2], t[2]) + 1)
            share = shared / ((d[3] - d[2] + 1) + (t[3] - t[2] + 1) - shared)
            if share >= 0.5 and (best is None or (share, -t[0]) > best):
                best = (share, -t[0])
        if best:
            want[d[0]] = -best[1]
            del by_file[d[1]][-best[1]]
    assert {r["id"]: r["truth_id"] for r in collected(spark, "detection_match")} == want and want


def test_bootstrap_interval_is_that_of_the_mean(spark):
    values = [r["right1"] for r in catalogue._eval(spark, SF).collect()]
    mean = sum(values) / len(values)
    (row,) = collected(spark, "bootstrap_ci")
    half = 1.96 * math.sqrt(mean * (1 - mean) / len(values))
    assert row["low"] < mean < row["high"] and 0.6 * 2 * half < row["high"] - row["low"] < 1.5 * 2 * half


def test_token_bucket_is_the_loop(spark):
    state, want = {}, []
    for r in sorted(table(spark, "events").collect(), key=lambda r: (r["user_id"], r["ts"], r["event_id"])):
        ok, state[r["user_id"]] = windows.take_token(state.get(r["user_id"]), r["ts"].timestamp(), 1 / 7200, 3.0, 1.0)
        want.append((r["user_id"], r["ts"], ok))
    assert sorted(tuple(r[c] for c in ("user_id", "ts", "allowed")) for r in collected(spark, "token_bucket")) == sorted(want)


def test_the_index_follows_the_files(spark, tmp_path):
    folder = str(tmp_path)
    for text in ("the the and", "of the sea"):
        spark.createDataFrame([(1, text), (2, "the end of it")], "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        got = {r["id"]: r["score"] for r in QUERIES["bm25_topk"](spark, folder).collect()}
        want = {r["id"]: round(r["score"], 6) for r in retrieval.bm25(spark.read.parquet(f"{folder}/documents.parquet"), catalogue.WORDS).collect()}
        assert got == pytest.approx(want)
