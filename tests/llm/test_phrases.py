"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import phrases
from loomgraph.llm.content_dedup import LOWER, UPPER
from loomgraph.llm.words import U

TABLE = str.maketrans(UPPER, LOWER)
NAMES = "lang rank phrase a l r n score".split()


def plain(rows, least=10, cover=50, most=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(TABLE)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = {}
    for (lang, *w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        longer = [f[lang, *v] for (other, *v) in f if other == lang and len(v) == 3 and len(w) == 2 and (v[:2] == w or v[1:] == w) and f[other, *v] >= least]
        if not any(100 * x >= cover * a for x in longer):
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return [(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, found in sorted(out.items()) for i, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1)]


def mined(df, **limits):
    return sorted(tuple(r[c] for c in NAMES) for r in phrases.collocations(df, **limits).collect())


def made(spark, seed=3, size=120):
    rnd = random.Random(seed)
    pool = ["The", "the", "neural", "net", "Été", "x y", "中文", "of", "\x1cz", "q" * 300, *(f"w{k}" for k in range(12))]
    fixed = ["new york", "New York City", "once upon a time", "of the"]
    gap = [" ", "  ", "\t", ", ", ".", "\n", " \x0b", "; ", "\r\n", "!"]

    def text():
        return "".join(rnd.choice([rnd.choice(pool), rnd.choice(fixed)]) + rnd.choice(gap if rnd.random() < 0.4 else [" "]) for _ in range(rnd.randint(0, 60)))

    rows = [(i if i % 9 else None, rnd.choice(["en", "de", None, "und", ""]), rnd.choice([None, "", " \t."]) if i % 11 == 0 else text(), "a", "f") for i in range(size)]
    return spark.createDataFrame(rows + rows[:20], "doc_id long, lang string, text string, phrase string, f string")


def test_made_texts(spark):
    df = made(spark).repartition(3)
    rows = [(r["lang"], r["text"]) for r in df.collect()]
    assert mined(df) == plain(rows)
    assert len(plain(rows)) > 80
    assert mined(df, least=4, cover_percent=80, most=7) == plain(rows, 4, 80, 7)


def test_hard_and_empty(hard, empty):
    assert mined(hard, least=1) == plain([(r["lang"], r["text"]) for r in hard.collect()], 1)
    assert mined(empty) == []


def test_small_runs(spark, monkeypatch):
    """Tasks that flush their runs again and again give the same counts."""
    rows = [(r["lang"], r["text"]) for r in made(spark, 4, 40).collect()]
    monkeypatch.setattr(phrases, "RUN", 64)
    runs = phrases.Runs(2)
    rnd = np.random.default_rng(1)
    total = Counter()
    for _ in range(9):
        a, b = rnd.integers(0, 5, 50).astype(U), rnd.integers(0, 5, 50).astype(U)
        total.update(zip(a.tolist(), b.tolist()))
        runs.add([a, b], np.ones(50, np.int64))
        if runs.full():
            runs.fold()
    columns, n = runs.fold()
    assert dict(zip(zip(*(c.tolist() for c in columns)), n.tolist())) == total and sorted(total) == list(zip(*(c.tolist() for c in columns)))

    batches = [phrases.pa.RecordBatch.from_pydict({"lang": [x[0] for x in part], "text": [x[1] for x in part]}) for part in (rows[:20], rows[20:])]
    found = Counter()
    for batch in phrases._count_words(0)(iter(batches)):
        for _, lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            found[lang, word] += n
    want = Counter()
    for lang, text in rows:
        for w in re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", (text or "").translate(TABLE)):
            want["und" if lang is None else lang, w] += 1
            want["und" if lang is None else lang, None] += 1
    assert found == want


def test_radix_order_is_the_order_of_packed_bytes():
    rnd = np.random.default_rng(2)
    columns = [rnd.integers(0, 1 << 63, 3000).astype(U) * U(2) for _ in range(3)]
    columns[0][:2000] = columns[0][0]
    columns[1][:1000] = columns[1][0]
    order = phrases.radix_order(columns)
    raw = [x.tobytes() for x in phrases.packed(columns)]
    assert [raw[i] for i in order] == sorted(raw)


def test_words_that_share_a_code_lead_to_another_draw(spark, monkeypatch):
    true = phrases.Codes.__init__

    def narrow(self, data, at, seeds, draw):
        true(self, data, at, seeds, draw)
        if draw < 2:
            self.code &= U(0xF)

    df = spark.createDataFrame([("en", f"word{i} and") for i in range(40)], "lang string, text string")
    rows = df.rdd.map(tuple).collect()
    batch = phrases.pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "text": [r[1] for r in rows]})
    monkeypatch.setattr(phrases.Codes, "__init__", narrow)
    flags = [sum(x < 0 for b in phrases._count_words(d)(iter([batch])) for x in b.column(3).to_pylist()) for d in range(3)]
    assert flags == [1, 1, 0]


@pytest.mark.parametrize("draw", [1, 2])
def test_draws_hash_words_anew(draw):
    data = np.frombuffer(b"one two one", np.uint8)
    w = phrases.Words(data, np.array([0, 11]), lower=True)
    a, b = phrases.word_hashes(w, 0), phrases.Words(data, np.array([0, 11]), lower=True)
    b = phrases.word_hashes(b, draw)
    assert not set(a.tolist()) & set(b.tolist()) and b[0] == b[2] != b[1]
