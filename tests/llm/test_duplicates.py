"""Near-duplicate operators against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import embedding_dedup, fingerprint, line_dedup, ngram_join, sketch, substring_dedup
from loomgraph.llm.words import Words, sequence_ids, sliding_min


def union(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def made_texts(seed=1):
    """Groups of near copies of many sizes, short texts, and passages that texts share."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6)))
    passage = [word() for _ in range(60)]
    texts = []
    for n in (1, 2, 3, 4, 5, 8, 11, 13, 22, 24, 33, 45, 60, 120, 300):
        base = [word() for _ in range(n)]
        for _ in range(5):
            copy = list(base)
            for _ in range(rnd.randint(0, 1 + n // 50)):
                copy[rnd.randrange(n)] = word()
            if rnd.random() < 0.3:
                copy.append(word())
            texts.append(" ".join(copy))
    for _ in range(8):
        own = [word() for _ in range(rnd.randint(0, 40))]
        k = rnd.randint(0, len(own))
        texts.append("\t".join(own[:k]) + " \n" + "  ".join(passage[rnd.randint(0, 5) :]) + " " + " ".join(own[k:]))
    return list(enumerate(texts, 1)) + [(500, None), (501, ""), (502, " \n "), (503, texts[3].upper())]


def jaccard_want(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    pairs = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    return {d: (len(sets[d]), c) for d, c in union(ids, pairs).items()}


@pytest.mark.parametrize("light", [None, 0, 12, 30])
def test_ngram_join(spark, monkeypatch, light):
    rows = made_texts()
    if light is not None:
        monkeypatch.setattr(ngram_join, "boundary", lambda *a: light)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard_want(rows)


def test_ngram_join_hard(hard, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(hard).collect()}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3) and got[4] == (1, 4) and got[9] == (1, 9)
    assert got[5] == got[6] == got[7] == (2, 5) and None in got
    assert ngram_join.ngram_join(empty).count() == 0


@pytest.mark.parametrize("light", [None, 0])
def test_ngram_join_only_pair(spark, monkeypatch, light):
    """The only near pair of a table lies in two classes of sizes, so no round of centres finds it."""
    if light is not None:
        monkeypatch.setattr(ngram_join, "boundary", lambda *a: light)
    words = [f"w{k}" for k in range(12)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, "some other words of no near copy at all")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard_want(rows) == {1: (10, 1), 2: (11, 1), 3: (7, 3)}


def test_boundary_is_cheapest():
    sizes = {s: 100 for s in range(1, 60)}
    assert ngram_join.boundary(sizes, 0.0, 90) <= ngram_join.boundary(sizes, 50.0, 90)
    for s in range(1, 40):
        for t in range(s, ngram_join.largest_partner(s, 90) + 1):
            need = next(o for o in range(1, s + 1) if 100 * o >= 90 * (s + t - o)) if 10 * s >= 9 * t else None
            if need:
                assert max(ngram_join.least_overlap(s, 90), ngram_join.least_overlap(t, 90)) <= need
                assert ngram_join.least_overlap(t, 90) in ngram_join.subset_sizes(s, 90)


def substring_want(rows, window=50):
    seen, out = {}, {}
    for d, t in sorted(rows):
        w = (t or "").encode().split()
        keep, new = [True] * len(w), set()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            new.add(k)
            if k in seen:
                keep[i : i + window] = [False] * window
        for k in new:
            seen.setdefault(k, d)
        kept = b" ".join(x for x, y in zip(w, keep) if y)
        out[d] = (len(w), len(w) - sum(keep), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("bits", [None, 4])
def test_substring_dedup(spark, bits):
    """Also with a sketch so small that nearly all windows pass it: the result is the same."""
    rows = made_texts(2)
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), width_bits=bits)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()} == substring_want(rows)


def test_substring_dedup_hard(hard, empty):
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(hard, window=3, anchor=2, carry=("lang", "kept")).collect()}
    assert (got[1]["n_words"], got[1]["kept"]) == (0, "") and got[4]["n_removed"] == 0
    assert got[5]["n_removed"] == 0 and got[6]["n_removed"] == got[7]["n_removed"] == 4 and None in got
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_sketch_never_falls_below_the_count():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 200, 5000).astype(np.uint64)
    part = sketch.Partial(2, 6, compact_at=700)
    for k in range(0, 5000, 500):
        part.add(keys[k : k + 500])
    part._compact()
    rows = [dict(zip(p[0][0].tolist(), p[0][1].tolist())) for p in part.parts]
    for key in range(200):
        cells = sketch.cells(np.array([key], np.uint64), 2, 6)
        assert min(r[int(c[0])] for r, c in zip(rows, cells)) >= min(sketch.LIMIT, (keys == key).sum())


def test_words():
    data = np.frombuffer(b" Ab c\x0b\x0cdd" + b"Ab" + b"", dtype=np.uint8)
    w = Words(data, np.array([0, 9, 11, 11]), lower=True)
    assert [w.text(k) for k in range(len(w.start))] == [b"ab", b"c", b"dd", b"ab"] and w.counts.tolist() == [3, 1, 0]
    h = w.hashes()
    assert h[0] == h[3] and len(set(h.tolist())) == 3
    assert w.hashes(longest=1)[2] != h[2]
    assert len(set(sequence_ids(h, w.first).tolist())) == 3
    x = np.random.default_rng(0).integers(0, 99, 40)
    assert sliding_min(x, 7).tolist() == [x[i : i + 7].min() for i in range(34)]


def normal(x):
    return b" ".join(x.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()).decode()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def line_pairs(rows):
    """All pairs of distinct lines by their full edit distance alone, without SimHash, and where each line stands."""
    places = defaultdict(list)
    for d, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            if normal(x):
                places[normal(x)].append((d, k))
    names = sorted(places)
    bags = [Counter(x) for x in names]
    pairs = []
    for i, a in enumerate(names):
        for j in range(i):
            most = math.floor(0.2 * max(len(a), len(names[j])) + 1e-9)
            if abs(len(a) - len(names[j])) <= most and max((bags[i] - bags[j]).total(), (bags[j] - bags[i]).total()) <= most and edits(a, names[j]) <= most:
                pairs.append((names[j], a))
    return pairs, places


def made_lines(seed=5, groups=25, copies=5):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7)))
    bases, rows = [[word() for _ in range(rnd.randint(1, 30))] for _ in range(groups)], []
    for d in range(40):
        out = []
        for _ in range(copies):
            line = list(rnd.choice(bases))
            if rnd.random() < 0.5:
                line[rnd.randrange(len(line))] = word()
            out.append(rnd.choice([" ", "  "]).join(line).title() if rnd.random() < 0.3 else " ".join(line))
        rows.append((d, "\n".join(out)))
    return rows


def test_line_dedup(spark):
    """Every result follows from links, every link is one by edit distance, and of all such pairs nine in ten are joined."""
    rows = made_lines() + [(90, None), (91, ""), (92, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, places = line_pairs(rows)
    seen, groups = line_dedup.line_links(df)
    name = {}
    for r in seen.collect():
        name[r["line_id"]] = normal(dict(rows)[r["doc_id"]].split("\n")[r["place"]])
    component = {name[r["id"]]: r["component"] for r in groups.collect()}
    joined = [(a, b) for a, b in want if a in component and component[a] == component.get(b)]
    assert len(joined) >= 0.9 * len(want) > 100
    real = union(places, want)
    assert all(real[a] == real[b] for a in component for b in component if component[a] == component[b])
    first = {}
    for x, at in places.items():
        first[component.get(x, x)] = min([first.get(component.get(x, x), (math.inf, 0)), *at])
    gone = {p for x, at in places.items() for p in at if p != first[component.get(x, x)]}
    got = line_dedup.line_dedup(df).collect()
    assert {(r["doc_id"], r["kept"]) for r in got} == {(d, "\n".join(x for k, x in enumerate((t or "").split("\n")) if (d, k) not in gone)) for d, t in rows}
    assert sum(r["n_removed"] for r in got) == len(gone) > 50


def test_line_recall_on_documents(docs):
    """Of the pairs of lines of documents with edit similarity 0.8, all candidates by blocks: at least nine in ten."""
    rows = [(r["doc_id"], "\n".join(x for x in r["text"].split("\n") if len(x) <= 250)) for r in docs.collect()]
    want, places = line_pairs(rows)
    names = sorted({x for p in want for x in p})
    raw = [x.encode() for x in names]
    values, lines = line_dedup.block_values(Words(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))), lower=True))
    blocks = defaultdict(set)
    for v, k in zip(values.tolist(), lines.tolist()):
        blocks[names[k]].add(v)
    assert len(want) >= 15 and sum(bool(blocks[a] & blocks[b]) for a, b in want) >= 0.9 * len(want)


def test_distance_within():
    rnd = random.Random(8)
    for _ in range(300):
        a = "".join(rnd.choice("abé") for _ in range(rnd.randint(0, 20)))
        b = "".join(rnd.choice("abé") for _ in range(rnd.randint(0, 20))) if rnd.random() < 0.5 else a[: rnd.randint(0, 20)] + rnd.choice(["", "x", "ab"]) + a[rnd.randint(0, 20) :]
        d = edits(a, b)
        assert [line_dedup.distance_within(a, b, m) for m in range(d + 3)] == [m >= d for m in range(d + 3)]
        assert [line_dedup.distance_within(list(a), list(b), m) for m in range(d + 3)] == [m >= d for m in range(d + 3)]
        x, y = a.replace("b", " "), b.replace("b", " ")
        assert line_dedup.similar(x, y, 0.8) == (edits(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9)


def test_line_dedup_hard(hard, empty):
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(hard, carry=("lang", "score", "kept")).collect()}
    assert got[1]["kept"] == "" and got[3]["kept"] == "  \n\t " and got[5]["n_removed"] == 0 and got[6]["kept"] == got[7]["kept"] == ""
    assert got[None]["kept"] == "a text of no document id" and got[6]["lang"] == "de"
    assert line_dedup.line_dedup(empty).count() == 0


def test_fingerprints(docs, hard, empty):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = {r["doc_id"]: r for r in fingerprint.compare_with_next(docs).collect()}
    marks = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(docs).collect()}
    for k, (d, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        changed = t[: len(t) - q] + after[:q]
        r = got[d]
        a, b, c = (fingerprint.fingerprint(fingerprint.code_points(x.encode())) for x in (t, changed, after))
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert r["fingerprint"] == marks[d] == fingerprint.text_of(a) and r["edited_fingerprint"] == fingerprint.text_of(b)
        assert r["near_edited"] == pytest.approx((a == b).mean()) and r["near_next"] == pytest.approx((a == c).mean())
    long = [d for d, t in rows if len(t) > 400]
    assert np.mean([got[d]["near_edited"] for d in long]) > 0.2 > 0.1 > np.mean([got[d]["near_next"] for d in long])
    same = {r["doc_id"]: r for r in fingerprint.compare_with_next(hard).collect()}
    assert len(same) == 10 and same[5]["fingerprint"] == same[6]["fingerprint"] and same[5]["near_next"] == 1.0 and same[1]["near_next"] == 1.0
    assert fingerprint.compare_with_next(empty).count() == 0


def test_fingerprint_falls_with_edits_and_order():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 110, 3000).astype(np.uint32)
    mark = fingerprint.fingerprint(text)
    alike = []
    for share in (0.0, 0.01, 0.05, 0.3, 1.0):
        other = text.copy()
        hit = rng.random(3000) < share
        other[hit] = rng.integers(97, 110, hit.sum())
        alike.append(fingerprint.likeness(mark, fingerprint.fingerprint(other)))
    assert alike[0] == 1.0 and alike == sorted(alike, reverse=True) and alike[-1] < 0.1
    moved = np.concatenate([text[1500:], text[:1500]])
    assert fingerprint.likeness(mark, fingerprint.fingerprint(moved)) < 0.8
    blocks = np.tile(text[:50], 2000)
    assert fingerprint.likeness(fingerprint.fingerprint(blocks), fingerprint.fingerprint(blocks.copy())) == 1.0


@pytest.mark.parametrize("k_mers", [64, 256, 1024, 8192])
def test_fingerprint_across_powers_of_two(k_mers):
    """Texts of 2**k and of one more k-mers are as alike as texts on one side of it."""
    rng = np.random.default_rng(k_mers)
    text = rng.integers(97, 123, k_mers + fingerprint.K + 2).astype(np.uint32)
    marks = {n: fingerprint.fingerprint(text[: n + fingerprint.K - 1]) for n in range(k_mers - 3, k_mers + 4)}
    for n in range(k_mers - 3, k_mers + 3):
        assert fingerprint.likeness(marks[n], marks[n + 1]) > 0.8


def test_sorted_k_mers():
    h = np.random.default_rng(3).integers(0, 9, 500).astype(np.uint64) << np.uint64(40)
    for x, y in zip(fingerprint._sorted(h), fingerprint._sorted(h, most=0)):
        assert x.tolist() == y.tolist()


def made_vectors(spark, seed=4):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for label in (0, 1):
        for _ in range(60):
            base = rng.normal(size=16)
            for _ in range(rng.integers(1, 12)):
                rows.append((n, [float(np.float32(v)) for v in base + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.2])], label))
                n += 1
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, rows[0][1], None), (n + 4, rows[0][1], 1), (n + 5, [1.0, None] * 8, 0), (n + 6, [1.0, 2.0], 0)]
    return rows


def test_embedding_dedup_recall(spark):
    rows = made_vectors(spark)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(df, leaf=16).collect()}
    good = [(i, np.array(v, dtype=float), k) for i, v, k in rows if v and k is not None and None not in v and np.isfinite(v).all() and any(v)]
    pairs = [(a, b) for a, x, k in good for b, y, m in good if a < b and k == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93]
    links = defaultdict(int)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    assert len(got) == len(rows) and all(got[i]["n_links"] <= links[i] for i in got)
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * 2 * len(pairs)
    want = union(got, pairs)
    assert sum(got[i]["component_id"] == want[i] for i in got) >= 0.97 * len(got)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert all(got[i]["n_links"] == 0 for i in list(got)[-7:] if i not in links)


def test_embedding_dedup_dense_groups(spark):
    """A near group of a third of the rows, one around another's border, and a wide label of the same width: exact, in several blocks."""
    rng = np.random.default_rng(11)
    base, side = rng.normal(size=32), rng.normal(size=32)
    x = [base + rng.normal(size=32) * 0.22 for _ in range(500)]
    x += [base + 0.45 * side + rng.normal(size=32) * 0.22 for _ in range(300)]
    x += list(rng.normal(size=(700, 32)))
    x += x[:40]
    label = [0] * len(x) + [1] * 300
    x += [base + rng.normal(size=32) * 0.25 for _ in range(300)]
    rows = [(i, [float(np.float32(v)) for v in e], k) for i, (e, k) in enumerate(zip(x, label))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    vectors = df.select(F.col("vec_id").alias("id"), "embedding", "label")
    assert len(embedding_dedup.dense_groups(vectors, leaf=16)) == 2
    u = embedding_dedup.unit([r[1] for r in rows])
    near = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None, :])
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(df, leaf=16, block=100).collect()}
    found, want = np.array([got[i]["n_links"] for i in range(len(rows))]), near.sum(axis=1)
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum()
    parts = union(got, [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b])
    assert sum(got[i]["component_id"] == parts[i] for i in got) >= 0.99 * len(got)


def test_embedding_dedup_empty(spark):
    assert embedding_dedup.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int, dim string, a long")).count() == 0


def test_short_lines_all_join(spark):
    """Lines of up to 14 characters, each with its edits, against all pairs; digits make many near neighbours."""
    rnd = random.Random(21)
    lines = {"p. 1", "a", "ab", "abc", "abcd", "Éte", "Étés 12"}
    for _ in range(120):
        base = "".join(rnd.choice("abc 12é") for _ in range(rnd.randint(3, 14)))
        for _ in range(2):
            at = rnd.randrange(len(base))
            lines |= {base, base[:at] + rnd.choice("abcx") + base[at + 1 :], base[:at] + base[at + 1 :], base[:at] + "z" + base[at:]}
    lines = sorted({" ".join(x.split()).lower() for x in lines if x.split() and len(" ".join(x.split())) <= 14})
    rows = [(i, x) for i, x in enumerate(lines)]
    seen, groups = line_dedup.line_links(spark.createDataFrame(rows, "doc_id long, text string"))
    of = {r["id"]: r["component"] for r in groups.collect()}
    got = {r["doc_id"]: of.get(r["line_id"], r["line_id"]) for r in seen.collect()}

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    want = union([i for i, _ in rows], [(i, j) for i, a in rows for j, b in rows if i < j and distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)])
    assert len(set(want.values())) < len(rows)
    for i, _ in rows:
        for j, _ in rows:
            assert (want[i] == want[j]) == (got[i] == got[j]), (rows[i], rows[j])


def test_counts_of_neighbours_never_rule_out_a_near_pair():
    rnd = random.Random(3)
    for _ in range(3000):
        a = "".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(0, 60)))
        b = list(a)
        edits = rnd.randint(0, 12)
        for _ in range(edits):
            at = rnd.randint(0, len(b))
            b[at : at + rnd.randint(0, 1)] = rnd.choice(["", "x", "a"])
        assert not line_dedup.too_far(a, "".join(b), edits)


def test_distances_of_many_pairs():
    """Edit distances of all pairs at once, over several words of 64 bits and texts of other lengths, against one pair at a time."""
    rnd = random.Random(12)
    xs, ys = [], []
    for _ in range(150):
        x = "".join(rnd.choice("abé 中\U0001f600") for _ in range(rnd.choice([0, 1, 63, 64, 65, 130, rnd.randint(1, 200)])))
        y = list(x)
        for _ in range(rnd.randint(0, 60)):
            at = rnd.randint(0, len(y))
            y[at : at + rnd.randint(0, 2)] = rnd.choice(["", "q", "ab"])
        xs.append(x)
        ys.append("".join(y))
    for x, y, d in zip(xs, ys, line_dedup.distances(xs, ys).tolist()):
        assert line_dedup.distance_within(x, y, d) and (not d or not line_dedup.distance_within(x, y, d - 1))
    assert line_dedup.similar_pairs(xs, ys, 0.8).tolist() == [line_dedup.similar(x, y, 0.8) for x, y in zip(xs, ys)]
    assert line_dedup.similar_pairs([], [], 0.8).tolist() == []


def test_a_large_near_group_is_not_compared_in_all_pairs(spark, monkeypatch):
    """Lines that are mostly too far from the most frequent one, but join through others: some comparisons each, not one with each other."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(60)]
    rows = []
    for i in range(900):
        line = list(base)
        for at in rnd.sample(range(60), rnd.randint(8, 9)):
            line[at] = word()
        rows.append((i, " ".join(line)))
    compared, compare = [], line_dedup._compare
    monkeypatch.setattr(line_dedup, "_compare", lambda pairs, *rest: (compared.append(pairs.count()), compare(pairs, *rest))[1])
    groups = line_dedup.line_links(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2))[1].collect()
    assert len(groups) > 890 and len({r["component"] for r in groups}) == 1
    assert sum(compared) < 80 * 900
