"""Learned scores: held-out accuracy, and odd rows."""

import numpy as np
import pytest

from loomgraph.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def large(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def accuracy(scored, labels, column):
    rows = scored.where("held_out").join(labels, "doc_id").select("score", "predicted", column).toPandas()
    y, p = rows[column].to_numpy(), rows["predicted"].to_numpy()
    rank = rows["score"].rank().to_numpy()
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / max(1, (y == 1).sum() * (y == 0).sum())
    return (y == p).mean(), auc


def test_toxicity_held_out(large):
    acc, auc = accuracy(toxicity.toxicity(*large), large[1], "toxic")
    assert acc > 0.96 and auc > 0.94


def test_quality_held_out(large):
    acc, auc = accuracy(quality.quality(*large), large[1], "quality")
    assert acc > 0.95 and auc > 0.98


@pytest.mark.parametrize("score", [toxicity.toxicity, quality.quality])
def test_hard_rows(spark, hard, empty, labels, score):
    rows = score(hard, labels).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[1] == by[2] and by[5] == by[6] and not next(r for r in rows if r["doc_id"] is None)["held_out"]
    assert score(empty, labels).count() == 0
    assert score(hard, labels.limit(0)).count() == 10


def pair_rows(seed=0, n=4000):
    """Rows by terms 0 to 60: positive are those of term 0 (a severe word) and those of terms 1 and 2 together."""
    rng = np.random.default_rng(seed)
    x = (rng.random((n, 61)) < 0.2).astype(np.float32)
    x[:, 0] = rng.random(n) < 0.1
    return x, ((x[:, 0] == 1) | ((x[:, 1] == 1) & (x[:, 2] == 1))).astype(int)


def test_pairs_of_neutral_terms_are_chosen():
    x, y = pair_rows()
    terms = lambda x: [np.flatnonzero(r) for r in x]
    assert {1, 2} <= set(toxicity.paired(terms(x), x.shape[1], y).tolist()) <= {0, 1, 2}
    rng = np.random.default_rng(1)
    assert not len(toxicity.paired(terms(x[:, 3:]), 58, rng.integers(0, 2, len(x))))
    assert not len(toxicity.paired([], 0, np.zeros(0, int)))


def test_factors_learn_pairs():
    """The label is 1 only where both of two terms stand: a sum of weights alone cannot say so."""
    x, y = pair_rows()
    model = toxicity.fit(x[:, :6], y, np.arange(1, 7, dtype=np.uint64) << np.uint64(60))
    one = model.bias + max(model.weights[1], model.weights[2])
    both = model.bias + model.weights[1] + model.weights[2] + model.factors[1] @ model.factors[2]
    assert one < 0 < both and model.bias + model.weights[0] > 0


@pytest.mark.parametrize("fillers, n", [(60, 6000), (1200, 6000)])
def test_neutral_second_term_counts(spark, fillers, n):
    """Insult and group mention are positive together only; a third of the clean rows mention the group. Any number of other words is as frequent."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(n):
        severe, insult, group = (rng.random(3) < (0.10, 0.20, 0.30)).tolist()
        words = ["severe"] * severe + ["insult"] * insult + ["group"] * group + [f"w{j:04d}" for j in rng.integers(0, fillers, fillers // 5)]
        rows.append((k, " ".join(words), int(severe or (insult and group))))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scored = toxicity.toxicity(df, df.select("doc_id", "toxic"))
    acc, _ = accuracy(scored, df, "toxic")
    assert acc > 0.97


def test_gradients_are_those_of_the_loss():
    """Against differences of the loss, term by term, of a plain sum over pairs."""
    rng = np.random.default_rng(3)
    x, y = (rng.random((30, 5)) < 0.4).astype(float), rng.integers(0, 2, 30).astype(float)
    weight = rng.random(30)
    params = [rng.normal(size=1), rng.normal(size=5), rng.normal(size=(5, toxicity.FACTORS))]

    def loss():
        total = 0.0
        for row, label, k in zip(x, y, weight):
            z = params[0][0] + row @ params[1] + sum(row[i] * row[j] * (params[2][i] @ params[2][j]) for i in range(5) for j in range(i))
            total += k * (np.log1p(np.exp(z)) - label * z)
        return total + toxicity.L2_WEIGHT / 2 * (params[1] ** 2).sum() + toxicity.L2_FACTOR / 2 * (params[2] ** 2).sum()

    for p, g in zip(params, toxicity.gradients(x, y, weight, params)):
        for at in np.ndindex(p.shape):
            p[at] += 1e-5
            up = loss()
            p[at] -= 2e-5
            down = loss()
            p[at] += 1e-5
            assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def test_class_prior():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.7, 0.9):
        p, u = rng.normal(2, 1, 4000), np.concatenate([rng.normal(2, 1, int(4000 * share)), rng.normal(-2, 1, int(4000 * (1 - share)))])
        assert abs(quality.class_prior(p, u) - share) < 0.06


def test_filter_keeps_all_columns(hard, labels):
    kept = toxicity.toxicity_filter(hard, labels)
    assert kept.columns == hard.columns and kept.count() == 10
