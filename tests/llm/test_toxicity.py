import random

import numpy as np

from pathloom.llm import toxicity as tx
from pathloom.llm.queries import op5_toxicity

LABELS = "doc_id long, quality int, toxic int"


def corpus(n, seed):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(r.randint(20, 80))]
        toxic, low = r.random() < 0.2, r.random() < 0.2
        if toxic:
            for w in r.sample(["zonk", "zapfen", "quax", "vurm"], 2):
                words.insert(r.randint(0, len(words)), w)
        text = " ".join(words)
        rows.append((i, text.replace(" ", " ### ") if low else text))
        labels.append((i, int(not low), int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, make):
    rows, labels = corpus(800, 1)
    chain = tx.fit(make(rows), spark.createDataFrame(labels, LABELS), tx.CATEGORIES, sample=400)
    known = {i: (q, t) for i, q, t in labels}
    scored = tx.score(make(rows), chain).collect()
    assert np.mean([(r.p_toxic >= 0.5) == bool(known[r.doc_id][1]) for r in scored]) > 0.97
    assert np.mean([(r.p_low_quality < 0.5) == bool(known[r.doc_id][0]) for r in scored]) > 0.97
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1  # the later model sees the earlier category


def test_later_categories_use_earlier_ones():
    rng = np.random.default_rng(0)
    x = tx.Rows(np.zeros(0, np.int64), np.zeros(0, np.int64), 0, np.concatenate([rng.normal(size=(500, 1)), np.ones((500, 1))], 1))
    first = (x.dense[:, 0] > 0).astype(float)
    weights = tx.train_chain(x, [first, first], np.arange(500) % tx.FOLDS)
    assert weights[1][1] > 0.1
    w = tx.logistic(x, first)
    assert np.mean((x.times(w) > 0) == first) > 0.98
    assert tx.logistic(x, np.zeros(500))[-1] == -30


def test_edges(spark, make):
    rows, labels = corpus(60, 2)
    rows += [(None, None), (5000, ""), (5001, "word " * 100_000), (3, rows[3][1])]
    labels += [(None, 1, 0), (1, None, None), (3, 1, 0), (3, 1, 0), (9999, 1, 1)]
    docs = make(rows)
    out = tx.toxicity(docs, spark.createDataFrame(labels, LABELS))
    assert out.count() == len(rows) and out.filter("p_toxic IS NULL OR p_low_quality IS NULL").count() == 0
    none = tx.toxicity(docs, spark.createDataFrame([], LABELS)).collect()
    assert {r.toxic for r in none} == {0}
    assert tx.toxicity(docs.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0
    odd = docs.selectExpr("doc_id", "text", "1 AS _id", "2 AS p", "lang AS _fold")
    assert tx.toxicity(odd, spark.createDataFrame(labels, LABELS), keep=("doc_id", "_id", "_fold")).columns == ["doc_id", "_id", "_fold", "p_low_quality", "p_toxic", "toxic"]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = [(labels[r.doc_id], r.toxic) for r in op5_toxicity(spark, sf).collect() if r.doc_id in labels]
    assert sum(a == b for a, b in found) >= 0.99 * len(found)


def test_out_of_fold_probabilities_know_nothing_of_their_fold():
    """Random labels can't be foretold; without folds 200 columns would fit them."""
    rng = np.random.default_rng(4)
    n, width = 1000, 200
    row, column = np.nonzero(rng.random((n, width)) < 0.1)
    x = tx.Rows(row, column, width, np.ones((n, 1)))
    y = (rng.random(n) < 0.5).astype(float)
    earlier = tx.out_of_fold(x, y, np.arange(n) % tx.FOLDS, [np.ones(width, bool)] * tx.FOLDS)
    assert abs(np.corrcoef(earlier, y)[0, 1]) < 0.1
    assert np.corrcoef(tx.sigmoid(x.times(tx.logistic(x, y))), y)[0, 1] > 0.4


def plain_logistic(x, y, shrink=0.3, l2=1e-5):
    """The same minimum by many plain proximal steps on a dense matrix."""
    w, n = np.zeros(x.shape[1]), len(y)
    if y.min() == y.max():
        w[-1] = 30 if y[0] else -30
        return w
    step = 1 / (np.linalg.norm(x, 2) ** 2 / (4 * n) + l2)
    z, t = w, 1.0
    for _ in range(8000):
        new = z - step * (x.T @ (1 / (1 + np.exp(-np.clip(x @ z, -30, 30))) - y) / n + l2 * z)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * shrink / n, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w


def test_chain_against_a_plain_one(spark, make):
    rows, labels = corpus(150, 5)
    fold = {r._id: r.f for r in make(rows).selectExpr("doc_id AS _id", f"CAST(pmod(xxhash64(text), {tx.FOLDS}) AS INT) AS f").collect()}
    texts, folds = [t for _, t in rows], np.array([fold[i] for i, _ in rows])
    ys = [np.array([1.0 - q for _, q, _ in labels]), np.array([float(t) for _, _, t in labels])]
    sets = [tx.words(t) for t in texts]

    def vocabulary(mask):
        out = {}
        for y in ys:
            rate, z = y[mask].mean(), []
            for w in sorted(set().union(*(s for s, m in zip(sets, mask, strict=True) if m))):
                has = np.array([w in s for s in sets]) & mask
                if has.sum() >= tx.LEAST:
                    z.append((-abs(y[has].sum() - has.sum() * rate) / np.sqrt(has.sum() * max(rate * (1 - rate), 1e-9)), w))
            out.update(dict.fromkeys(w for _, w in sorted(z)[: tx.WORDS]))
        return list(out)

    def design(words, earlier):
        return np.array([[*(float(w in s) for w in words), *tx.figures(t), *e, 1.0] for s, t, e in zip(sets, texts, earlier, strict=True)])

    oof = np.zeros(len(rows))
    for f in range(tx.FOLDS):
        x = design(vocabulary(folds != f), [()] * len(rows))
        oof[folds == f] = 1 / (1 + np.exp(-(x @ plain_logistic(x[folds != f], ys[0][folds != f]))[folds == f]))
    words = vocabulary(np.ones(len(rows), bool))
    x = design(words, [()] * len(rows))
    p0 = 1 / (1 + np.exp(-x @ plain_logistic(x, ys[0])))
    p1 = 1 / (1 + np.exp(-design(words, p0[:, None]) @ plain_logistic(design(words, oof[:, None]), ys[1])))
    chain = tx.fit(make(rows), spark.createDataFrame(labels, LABELS), tx.CATEGORIES)
    got = np.array([chain.score(t) for t in texts])
    assert set(words) == set(chain.vocabulary)
    assert np.abs(got - np.stack([p0, p1], 1)).max() < 0.05


def test_kept_columns_give_way_to_results(spark, make):
    rows, labels = corpus(60, 2)
    docs = make(rows).selectExpr("*", "0.5D AS p_toxic", "1 AS TOXIC")
    out = tx.toxicity(docs, spark.createDataFrame(labels, LABELS), keep=("doc_id", "p_toxic", "TOXIC"))
    assert out.columns == ["doc_id", "p_low_quality", "p_toxic", "toxic"] and out.count() == 60
