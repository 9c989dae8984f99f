"""Exact dedup by content sort against brute force."""

import hashlib
import random

import pytest

from loomgraph.llm import content_dedup
from loomgraph.llm.content_dedup import content_dedup as dedup

LOWER = str.maketrans(content_dedup.UPPER, content_dedup.LOWER)


def want(rows, best):
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(d)
    out = []
    for text, ids in groups.items():
        known = [d for d in ids if d is not None]
        top = best(known) if known else None
        kept = False
        for d in ids:
            here = d == top and not kept
            kept |= here
            out.append((d, top, len(ids), here, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


@pytest.mark.parametrize("keep, best", [("smallest", min), ("largest", max)])
def test_hard_rows(hard, empty, keep, best):
    assert got(dedup(hard, keep)) == want([(r["doc_id"], r["text"]) for r in hard.collect()], best)
    assert got(dedup(empty, keep)) == []


def test_case_of_other_letters_stays(spark):
    rows = [(1, "ÀB"), (2, "àb"), (3, "àB"), (4, "ÀB"), (5, "İx"), (6, "i̇x"), (7, "ab\x00"), (8, "AB"), (9, "ab")]
    assert got(dedup(spark.createDataFrame(rows, "doc_id long, text string"), "largest")) == want(rows, max)


def test_large_groups_are_dealt_into_parts_and_meet_again(spark):
    rnd = random.Random(5)
    long_start = "the same beginning " * 20
    rows = [(i, rnd.choice(["Copied TEXT", "copied text"]) if i % 3 == 0 else long_start + str(rnd.randrange(400)) if i % 3 == 1 else None if i % 7 else f"own {i}") for i in range(3000)]
    rows += [(None, "copied text"), (None, "copied text"), (2997, "copied text"), (0, "Copied text"), (None, "none knows its id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    many = content_dedup._many_copies(df.selectExpr("xxhash64(lower(text)) as tie").where("tie is not null"), 8, len(rows)).collect()
    assert max(r["parts"] for r in many) > 8
    for keep, best in (("smallest", min), ("largest", max)):
        assert got(dedup(df, keep, parts=8)) == want(rows, best)


def test_one_exchange_of_texts_and_no_python(docs):
    rows = docs.select("doc_id", content_dedup.normalised(docs["text"]).alias("norm"))
    plan = dedup(rows.withColumnRenamed("norm", "text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
