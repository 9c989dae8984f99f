"""Byte-level BPE, token shards and packing against the tokenizer libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

from loomgraph.llm import bpe, packing, sstable, tokens

ALPHABET = " \n\t  ab'sé1,.  \x1c漢\U0001f600'llA 　İΣH̱|#9²"


def by_id(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def gpt():
    return tiktoken.Encoding("own", pat_str=bpe.word_pattern(), mergeable_ranks=bpe.load_ranks(bpe.rank_path()), special_tokens={})


@pytest.fixture(scope="module")
def words():
    t = Tokenizer.from_file(tokens.word_bpe_path())
    t.encode_special_tokens = True
    return t


def le(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_bpe_round_trip(hard, docs, gpt):
    for df in (hard, docs):
        want = sorted(((r["doc_id"], len(i := gpt.encode_ordinary(r["text"] or "")), hashlib.sha256(le(i)).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in df.select("doc_id", "text").collect()), key=repr)
        assert by_id(bpe.digests(df), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_bpe_encode_then_decode(hard):
    back = {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.decode(bpe.encode(hard)).collect()}
    assert back == {r["doc_id"]: r["text"] or "" for r in hard.collect()}


def test_bpe_odd_spaces(gpt):
    enc, rnd = bpe.ByteEncoder(bpe.rank_path(), bpe.word_pattern()), random.Random(3)
    for _ in range(5000):
        text = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 14)))
        assert enc.encode(text.encode()) == le(gpt.encode_ordinary(text)), repr(text)


def test_bpe_native_form_agrees(spark, docs):
    few = docs.where("doc_id < 12")
    assert by_id(bpe.encode_native(few), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == by_id(bpe.digests(few), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def test_word_encoder_is_the_library(words):
    enc, rnd = tokens.WordEncoder(tokens.word_bpe_path()), random.Random(4)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 14))) for _ in range(5000)]
    for text, got in zip(texts, enc.encode([t.encode() for t in texts])):
        assert got == le(words.encode(text, add_special_tokens=False).ids), repr(text)


def shards_want(rows, words):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = words.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(le(ids))))
        start += len(ids)
    return sorted(out, key=repr)


def test_shards_hold_all_documents(hard, docs, words):
    for df in (hard, docs):
        got = by_id(sstable.read_sstables(sstable.write_sstables(df)), "doc_id", "start", "n_tokens", "ids_crc32")
        assert got == shards_want([(r["doc_id"], r["text"]) for r in df.collect()], words)


def test_shard_look_up(docs, words):
    found = {}
    for r in sstable.write_sstables(docs, n_shards=3).collect():
        shard = sstable.ShardReader(r["uri"])
        for d in range(0, 200, 7):
            if (ids := shard.get(d)) is not None:
                found[d] = ids.tolist()
        assert shard.get(10**12) is None
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert found == {d: words.encode(texts[d], add_special_tokens=False).ids + [2] for d in range(0, 200, 7)}


def test_keys_sort_as_ids():
    ids = [None, -(1 << 63), -5, -1, 0, 1, 7, 1 << 40, (1 << 63) - 1]
    keys = [sstable.key_of(i) for i in ids]
    assert keys == sorted(keys) and [sstable.id_of(k) for k in keys] == ids


def test_no_documents(empty):
    assert sstable.read_sstables(sstable.write_sstables(empty)).count() == 0
    assert packing.pack(empty).count() == 0
    assert bpe.digests(empty).count() == 0


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))]
        assert sum(n for _, n in b) <= capacity
    return len(bins)


def test_packing_places_every_piece(hard, docs, words):
    for df in (hard, docs):
        rows = packing.pack(df).collect()
        want = []
        for r in df.collect():
            ids = words.encode(r["text"] or "", add_special_tokens=False).ids + [1]
            want += [(r["doc_id"], k, a, len(ids[a : a + 4096]), zlib.crc32(le(ids[a : a + 4096]))) for k, a in enumerate(range(0, len(ids), 4096))]
        assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr) == sorted(want, key=repr)
        n = check_packing(rows, 4096)
        assert n <= -(-sum(w[3] for w in want) // 4096) * 1.03 + 1


def test_packing_in_rounds_of_many_partitions(docs):
    rows = packing.pack(docs.repartition(23, "doc_id"), fan_in=3).collect()
    # Partitions of about nine documents leave little to choose from; whole partitions are held to 3 % above.
    assert check_packing(rows, 4096) <= -(-sum(r["length"] for r in rows) // 4096) * 1.08 + 1


def test_packing_hands_on_all_underfull_bins(spark):
    """Partitions of many items over half a sequence, and others of one small item: each small one fills a bin of the former."""
    rows = [(k, "of " * 40) for k in range(300)] + [(1000 + k, "of " * 22) for k in range(12)]
    df = spark.createDataFrame(rows[:300], "doc_id long, text string").repartition(3)
    for r in rows[300:]:
        df = df.unionByName(spark.createDataFrame([r], "doc_id long, text string").coalesce(1))
    assert check_packing(packing.pack(df, capacity=64, most=400).collect(), 64) == 300
    half = spark.createDataFrame(rows[:300], "doc_id long, text string").repartition(9)
    assert check_packing(packing.pack(half, capacity=64, fan_in=2, most=50).collect(), 64) == 300


def test_best_fit():
    assert packing.best_fit([5, 4, 3, 3, 3, 2], 10) == [[0, 1], [2, 3, 4], [5]]
    assert packing.best_fit([6, 5, 4, 3], 10) == [[0, 2], [1, 3]]
    assert packing.best_fit([], 10) == []
    assert packing.best_fit([10, 10], 10) == [[0], [1]]



def test_long_words_fold_alike():
    ranks = bpe.load_ranks(bpe.rank_path())
    whole = tiktoken.Encoding("own", pat_str=bpe.word_pattern(), mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(5)
    for n in (129, 500, 20_000):
        for letters in (b"a", b"ab", b"etaoinshr", bytes(range(256))):
            word = bytes(rng.choice(list(letters), n).tolist())
            assert bpe.fold(word, ranks) == whole._encode_single_piece(word)
