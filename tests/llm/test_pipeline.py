"""Each stage of the pipeline on its own input, and the whole."""

import random

import corpus_pipeline as cp
from loomgraph.llm.ngram_join import ngram_join

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs):
    from loomgraph.storage import written

    rows = docs
    for name, stage in cp.STAGES[:-1]:
        before = {r["doc_id"]: r for r in rows.collect()}
        rows = written(stage(spark, rows, SF), name)
        assert rows.columns == cp.COLUMNS == docs.columns and rows.dtypes == docs.dtypes
        after = {r["doc_id"]: r for r in rows.collect()}
        assert set(after) <= set(before) and all(r["n_chars"] == len(r["text"]) for r in after.values())
        assert all(after[d]["lang"] == before[d]["lang"] and after[d]["source"] == before[d]["source"] for d in after)
        if name in ("line_dedup", "substring_dedup"):
            assert set(after) == set(before) and all(len(after[d]["text"]) <= len(before[d]["text"]) for d in after)
    assert ngram_join(rows.where("length(text) > 0")).where("doc_id <> component_id").count() == 0
    out = cp.STAGES[-1][1](spark, rows, SF).collect()
    assert {r["doc_id"] for r in out} == set(after)


def test_whole_run(spark):
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_odd_ids_stay(spark, docs):
    odd = docs.limit(3).unionByName(docs.limit(1)).unionByName(spark.createDataFrame([(None, "some words of no id", "en", "s", 19), (9999, None, None, None, None)], docs.schema))
    for _, stage in cp.STAGES[1:4]:
        out = stage(spark, odd, SF)
        assert out.where("doc_id is null").count() == 1 and out.where("doc_id = 9999").count() == 1


def test_near_copies_by_five_words(spark, docs):
    """Against brute force at five words and 0.8: copies whose three-word Jaccard is below 0.9 go too."""
    rnd = random.Random(6)
    texts = []
    for n in range(44, 62):
        base = [f"w{rnd.randrange(10_000)}" for _ in range(n)]
        for changes in (0, 1, 3):
            copy = list(base)
            for k in range(changes):
                copy[10 + 12 * k] = f"x{rnd.randrange(10_000)}"
            texts.append(" ".join(copy))

    def likeness(a, b, n):
        x, y = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (a.split(), b.split()))
        return len(x & y) / len(x | y)

    links = [(a, b) for b in range(len(texts)) for a in range(b) if likeness(texts[a], texts[b], 5) >= 0.8]
    assert any(likeness(texts[a], texts[b], 3) < 0.9 for a, b in links)
    rows = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in enumerate(texts)], docs.schema)
    # No chains here: a text is linked to its own base alone, so the later one of each link goes.
    assert {r["doc_id"] for r in cp.drop_near_copies(spark, rows, SF).collect()} == set(range(len(texts))) - {b for _, b in links}
