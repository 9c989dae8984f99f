"""Alignment of two tokenizers against the libraries, token by token."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from loomgraph.llm import alignment
from loomgraph.llm.tokens import byte_letters

ALPHABET = [" ", "  ", "\n", "\t", "a", "b", "'s", "é", "1", ",", ".", "\x1c", "漢", "\U0001f600", "ll", "A", "　", "\xa0", "\x85", "İ", "<s>", "<0x41>", "<|endoftext|>", "the", "tion", "▁", "\x00", "é", "9²"]
NAMES = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


class Libraries:
    def __init__(self):
        self.a = Tokenizer.from_file(alignment.byte_bpe_path())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=alignment.piece_path())
        self.bytes_of = {c: b for b, c in byte_letters().items()}

    def groups(self, text):
        """Groups of (A ids, B ids) of a text; none if it has no tokens."""
        if not text:
            return []
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        names = [bytes(self.bytes_of[c] for c in self.a.id_to_token(i)) for i in a], [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [self.b.id_to_piece(i)]]
        if any(b"".join(n) != (" " + text).encode() for n in names):
            return []
        out, i, j, x, y = [([], [])], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if x <= y:
                x += len(names[0][i])
                out[-1][0].append(a[i])
                i += 1
            else:
                y += len(names[1][j])
                out[-1][1].append(b[j])
                j += 1
            if x == y:
                out.append(([], []))
        return out[:-1]


@pytest.fixture(scope="module")
def libs():
    return Libraries()


def want(rows, libs, rule="ends"):
    found = [(d, libs.groups(t)) for d, t in rows]
    pairs = [[(a[-1], b[-1])] if rule == "ends" else [(x, y) for x in a for y in b] for _, g in found for a, b in g]
    count = Counter(p for link in pairs for p in link)
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out, k = [], 0
    for d, g in found:
        own = [p for link in pairs[k : k + len(g)] for p in link]
        k += len(g)
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(own), sum(count[p] == top[p[1]] for p in own), sum(count[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


def got(df, **how):
    return sorted((tuple(r[c] for c in NAMES) for r in alignment.link_counts(df, **how).collect()), key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 12))) for _ in range(1500)] + ["a" * 5000, " " * 300, "no▁text", "\n b", " ", "  x", "x ", "x　 y"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_odd_hard_and_empty(spark, hard, empty, odd, libs):
    for df in (hard, odd):
        assert got(df) == want([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], libs)
    assert got(empty) == []


def test_documents_and_rare_pairs(docs, libs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(docs) == want(rows, libs)
    assert got(docs, head=100) == want(rows, libs)
    assert got(docs, head=0) == want(rows, libs)


def test_all_ids_of_a_group(hard, libs):
    assert got(hard, links="group") == want([(r["doc_id"], r["text"]) for r in hard.collect()], libs, "group")


def test_ranges(odd, libs):
    for r, text in zip(alignment.align(odd).orderBy("doc_id").collect(), [r["text"] for r in odd.orderBy("doc_id").collect()]):
        groups, a, b = libs.groups(text), 0, 0
        assert len(r["cuts"]) == len(groups) and (not groups or r["cuts"][-1] == len(text.encode()) + 1)
        for (x, y), i, j in zip(groups, r["a_ends"], r["b_ends"]):
            assert r["a_ids"][a:i] == x and r["b_ids"][b:j] == y
            a, b = i, j


def test_rank():
    rnd = np.random.default_rng(1)
    mark = rnd.random(1003) < 0.3
    at = np.arange(1003)
    assert alignment.rank(np.packbits(mark), at).tolist() == np.cumsum(mark).tolist()
