"""Near-duplicate vectors of one label: a forest of random-projection trees with spill.

A tree splits vectors by a random direction at the median; those near the median go to both sides
(spill). The upper levels of all trees are fitted on a bounded sample and broadcast; every vector is
routed by them. A leaf that still has many vectors is split on in the same way by its task. In each
leaf all vectors of one label are compared, in double precision, and the pairs of all trees united.
Equal vectors are one vector from the start. Only pairs that reach the threshold are links; with the
default trees more than nine in ten of those are found.

A group of near vectors that is larger than some leaves would be cut by split after split. Such groups
are seen in the sample and taken out before the forest: a group's own vectors lie within the threshold's
angle of its centre, and all that can link with them within twice that angle, so both together are
compared exactly, block against block. Of those comparisons come counts and spanning links, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from ..operators.components import components

THRESHOLD = 0.93
TREES = 10
LEAF = 256
SPILL = 0.06
SAMPLE_ROWS = 20_000
#: A dense group has at least this many of the sampled vectors, and what would be four leaves of all vectors.
DENSE_ROWS = 32
#: Vectors of a dense group that one task compares with as many others.
BLOCK = 8192
SEED = 17


def _direction(dim: int, *seed: int) -> np.ndarray:
    x = np.random.default_rng((SEED, dim, *seed)).standard_normal(dim)
    return x / np.linalg.norm(x)


class Tree:
    """Upper levels of one tree: for each node, numbered as in a heap from 1, the cuts of its two sides."""

    def __init__(self, dim: int, number: int, depth: int):
        self.dim, self.number, self.depth = dim, number, depth
        self.cuts: dict[int, tuple[float, float]] = {}

    def fit(self, x: np.ndarray) -> Tree:
        places = [(1, x)]
        for _ in range(self.depth):
            after = []
            for node, rows in places:
                p = rows @ _direction(self.dim, self.number, node)
                if not len(p):
                    continue
                low, high = np.quantile(p, [0.5 - SPILL, 0.5 + SPILL])
                self.cuts[node] = (float(low), float(high))
                after += [(2 * node, rows[p <= high]), (2 * node + 1, rows[p >= low])]
            places = after
        return self

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaves; a row that spills is in several."""
        rows, nodes = np.arange(len(x)), np.ones(len(x), dtype=np.int64)
        for _ in range(self.depth):
            new_rows, new_nodes = [], []
            for node in np.unique(nodes):
                own = rows[nodes == node]
                cut = self.cuts.get(int(node))
                if cut is None:
                    new_rows.append(own)
                    new_nodes.append(np.full(len(own), node))
                    continue
                p = x[own] @ _direction(self.dim, self.number, int(node))
                for side, mine in ((2 * node, p <= cut[1]), (2 * node + 1, p >= cut[0])):
                    new_rows.append(own[mine])
                    new_nodes.append(np.full(int(mine.sum()), side))
            rows, nodes = np.concatenate(new_rows), np.concatenate(new_nodes)
        return rows, nodes


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _links(ids: np.ndarray, x: np.ndarray, threshold: float, leaf: int, seed: tuple[int, ...]) -> Iterator[np.ndarray]:
    """Pairs of ids at or above the threshold among vectors of one leaf, which is split on while it is large."""
    if len(ids) > 4 * leaf and len(seed) < 40:
        p = x @ _direction(x.shape[1], *seed)
        low, high = np.quantile(p, [0.5 - SPILL, 0.5 + SPILL])
        left, right = p <= high, p >= low
        if left.sum() < len(ids) and right.sum() < len(ids):
            yield from _links(ids[left], x[left], threshold, leaf, (*seed, 0))
            yield from _links(ids[right], x[right], threshold, leaf, (*seed, 1))
            return
    for i in range(0, len(ids), 1024):
        a, b = np.nonzero(x[i : i + 1024] @ x[i:].T >= threshold)
        up = b > a
        pair = np.stack([ids[i + a[up]], ids[i + b[up]]], 1)
        if len(pair):
            yield np.sort(pair, axis=1)


def _sample(vectors: DataFrame, dim: int) -> pd.DataFrame:
    """At most SAMPLE_ROWS rows of one width, by a hash of the id."""
    return vectors.where(F.size("embedding") == dim).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("label", "embedding").toPandas()


def _centres(x: np.ndarray, threshold: float, least: int) -> np.ndarray:
    """Means of the groups of at least ``least`` rows within the threshold of a row, most neighbours first."""
    found, left = [], x
    while len(left) >= least:
        near = np.concatenate([(left[i : i + 1024] @ left.T >= threshold).sum(axis=1) for i in range(0, len(left), 1024)])
        order = np.argsort(-near, kind="stable")[: int((near >= least).sum())]
        taken = np.zeros(len(left), dtype=bool)
        before = len(found)
        for i in order:
            if not taken[i]:
                own = (left @ left[i] >= threshold) & ~taken
                if own.sum() >= least:
                    c = left[own].mean(axis=0)
                    c /= np.linalg.norm(c)
                    found.append(c)
                    taken |= own | (left @ c >= threshold)
        if len(found) == before:
            break
        left = left[~taken]
    return np.array(found).reshape(-1, x.shape[1])


def dense_groups(vectors: DataFrame, threshold: float = THRESHOLD, leaf: int = LEAF) -> dict[tuple, tuple[int, np.ndarray]]:
    """By (width, label): the number of the first centre, and the centres of groups too large for the forest's leaves."""
    out: dict[tuple, tuple[int, np.ndarray]] = {}
    n = 0
    for r in vectors.groupBy(F.size("embedding").alias("dim")).count().collect():  # one row for each width of vectors
        least = max(DENSE_ROWS, int(4 * leaf * min(1.0, SAMPLE_ROWS / r["count"])))
        if r["count"] < least:
            continue
        for label, rows in _sample(vectors, r["dim"]).groupby("label"):
            if len(rows) >= least:
                c = _centres(unit(rows["embedding"].tolist()), threshold, least)
                if len(c):
                    out[r["dim"], label] = (n, c)
                    n += len(c)
    return out


def _placed(vectors: DataFrame, groups: dict, threshold: float) -> DataFrame:
    """``vectors`` with the group each belongs to (home, null for most) and all groups it is to be compared in (around)."""
    shared = vectors.sparkSession.sparkContext.broadcast(groups)
    wide = 2 * threshold * threshold - 1 - 1e-6

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            home: list = [None] * len(pdf)
            around: list = [[] for _ in range(len(pdf))]
            of = pdf.groupby([pdf["embedding"].map(len).rename("dim"), "label"]).indices
            for key, at in of.items():
                first, c = shared.value.get(key, (0, None))
                if c is None:
                    continue
                near = unit(pdf["embedding"].iloc[at].tolist()) @ c.T
                best = near.argmax(axis=1)
                for k, i in enumerate(at):
                    if near[k, best[k]] >= threshold:
                        home[i] = first + int(best[k])
                    around[i] = (first + np.nonzero(near[k] >= wide)[0]).tolist()
            yield pdf.assign(home=pd.array(home, dtype="Int64"), around=around)

    kind = dict(vectors.dtypes)
    return vectors.mapInPandas(place, f"id long, label {kind['label']}, embedding {kind['embedding']}, n long, home long, around array<long>")


def _joined(root: np.ndarray, members: np.ndarray) -> None:
    """Give all rows whose roots the members have the least of those roots."""
    own = root[members]
    low = own.min()
    if own.max() != low:
        root[np.isin(root, np.unique(own))] = low


def _dense_links(placed: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b, m): b is the least vector that a hangs together with in the two blocks compared, m the rows that link with a.

    A pair counts in the group that is home to one of its ends: there for that end, and for the other
    end if it has no home. So each end counts a pair once, whatever groups both lie around.
    """
    wide = placed.select("id", "embedding", "n", "home", F.explode("around").alias("group"))
    blocks = wide.groupBy("group").agg(F.ceil(F.count("*") / block).alias("blocks"))
    own = F.pmod(F.xxhash64("id", F.lit(SEED)), F.col("blocks"))
    dealt = wide.join(F.broadcast(blocks), "group").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    kind = F.when(F.col("home") == F.col("group"), 2).when(F.isnull("home"), 1).otherwise(0)
    dealt = dealt.select("group", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "embedding", "n", kind.alias("kind"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        x, ids, n, kind = unit(pdf["embedding"].tolist()), pdf["id"].to_numpy(), pdf["n"].to_numpy(), pdf["kind"].to_numpy()
        low, high = pdf["low"].iloc[0], pdf["high"].iloc[0]
        left = np.nonzero(pdf["own"].to_numpy() == low)[0]
        right = np.nonzero(pdf["own"].to_numpy() == high)[0]
        m, root = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        for i in range(0, len(left), 512):
            rows = left[i : i + 512]
            linked = (x[rows] @ x[right].T >= threshold) & ((kind[rows] == 2)[:, None] | (kind[right] == 2)[None, :])
            linked &= rows[:, None] != right[None, :]
            m[rows] += np.where(kind[rows] == 2, linked @ n[right], np.where(kind[rows] == 1, (linked & (kind[right] == 2)) @ n[right], 0))
            if low != high:
                m[right] += np.where(kind[right] == 2, n[rows] @ linked, np.where(kind[right] == 1, n[rows] @ (linked & (kind[rows] == 2)[:, None]), 0))
            for k, row in enumerate(rows):
                if linked[k].any():
                    _joined(root, np.append(right[linked[k]], row))
        return pd.DataFrame({"a": ids, "b": ids[root], "m": m})

    return dealt.groupBy("group", "low", "high").applyInPandas(compare, "a long, b long, m long")


def forest_links(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """vectors: (id, label, embedding), no nulls, distinct within a label. Pairs (a, b) of ids found at or above the threshold."""
    spark = vectors.sparkSession
    sizes = vectors.groupBy("label", F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()  # one row for each width of vectors
    models: dict[int, list[Tree]] = {}
    for r in sizes:
        depth = max(0, int(np.ceil(np.log2(max(1, r["n"]) / leaf))))
        depth = min(depth, int(np.log2(SAMPLE_ROWS / 16)))
        some = _sample(vectors, r["dim"])["embedding"].tolist() if depth else []
        x = unit(some) if some else np.zeros((0, r["dim"]))
        models[r["dim"]] = [Tree(r["dim"], t, depth).fit(x) for t in range(trees)]
    shared = spark.sparkContext.broadcast(models)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            dims = pdf["embedding"].map(len).to_numpy()
            for dim in np.unique(dims):
                some = pdf[dims == dim].reset_index(drop=True)
                x = unit(some["embedding"].tolist())
                for tree in shared.value[int(dim)]:
                    rows, nodes = tree.leaves(x)
                    yield some.iloc[rows].assign(dim=int(dim), tree=tree.number, leaf=nodes)[["dim", "tree", "leaf", "id", "label", "embedding"]]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        seed = (1_000_003, int(pdf["tree"].iloc[0]), int(pdf["leaf"].iloc[0]))
        found = list(_links(pdf["id"].to_numpy(), unit(pdf["embedding"].tolist()), threshold, leaf, seed))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype=np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    kind = dict(vectors.dtypes)
    routed = vectors.select("id", "label", "embedding").mapInPandas(route, f"dim int, tree int, leaf long, id long, label {kind['label']}, embedding {kind['embedding']}")
    return routed.groupBy("label", "dim", "tree", "leaf").applyInPandas(compare, "a long, b long").distinct()


def embedding_dedup(rows: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """Per row of ``rows`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Only vectors of equal, non-null labels and of one width are compared. Null and zero vectors, and
    those that hold null or non-finite components, link with nothing, and so does a null vec_id,
    whose component is null and which is not kept. n_links counts other rows; equal vectors link.
    Rows with equal vec_id are vectors of their own in the counts but one in components. An empty
    table gives an empty table. Other columns are ignored.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    finite = "not exists(embedding, x -> isnull(x) or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)"
    ok = rows.where("isnotnull(vec_id) and isnotnull(label) and isnotnull(embedding)").where(finite)
    same = written(ok.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "distinct")
    # An id may have several vectors; links run between vectors, so each has a number of its own.
    same = same.withColumn("vector", F.xxhash64("label", "embedding"))
    counts = same.select("vector", "id", "n")
    vectors = same.select(F.col("vector").alias("id"), "label", "embedding", "n")
    dense = dense_groups(vectors, threshold, leaf)
    if dense:
        vectors = written(_placed(vectors, dense, threshold), "placed")
        compared = written(_dense_links(vectors.where("size(around) > 0"), threshold, block), "compared")
        vectors = vectors.where("isnull(home)")
    links = written(forest_links(vectors.select("id", "label", "embedding"), threshold, trees, leaf), "links")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ends.join(counts.select(F.col("vector").alias("b"), F.col("n").alias("m")), "b").select("a", "m")
    if dense:
        others = others.unionByName(compared.select("a", "m"))
        links = links.unionByName(compared.where("a <> b").select("a", "b"))
    others = others.groupBy("a").agg(F.sum("m").alias("m"))
    groups = components(links)
    known = counts.join(groups.withColumnRenamed("id", "vector"), "vector", "left").withColumn("component", F.coalesce("component", "vector")).join(others.withColumnRenamed("a", "vector"), "vector", "left")
    lowest = known.groupBy("component").agg(F.min("id").alias("component_id"))
    by_vector = known.join(lowest, "component").select("vector", "component_id", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))
    usable = F.expr(f"isnotnull(vec_id) and isnotnull(label) and isnotnull(embedding) and coalesce({finite}, false)")
    out = rows.withColumn("vector", F.when(usable, F.xxhash64("label", "embedding"))).drop("embedding", "label").join(by_vector, "vector", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
