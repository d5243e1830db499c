import random
import re

import numpy as np
import pytest

from pathloom.llm import decontaminate as dc
from pathloom.llm.queries import op9_decontaminate


def words(text):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))


def items_of(rows):
    df, total = {}, 0
    for _, q, a in rows:
        h = np.concatenate([dc.word_hashes(q), dc.word_hashes(a)])
        total += len(h)
        for t in np.unique(h).tolist():
            df[t] = df.get(t, 0) + 1
    return dc.Index(rows, df, len(rows), total / len(rows))


@pytest.mark.parametrize("block", [1, 4])
def test_wand_finds_all_above_the_threshold(monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK", block)
    r = random.Random(block)
    vocabulary = [f"v{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    rows = [(k, " ".join(r.choices(vocabulary, weights, k=r.randint(1, 25))), " ".join(r.choices(vocabulary, weights, k=r.randint(0, 6)))) for k in range(50)]
    index = items_of(rows)
    for _ in range(100):
        terms = np.unique(index.columns(dc.word_hashes(" ".join(r.choices(vocabulary, weights, k=r.randint(1, 60))))))
        terms = terms[terms >= 0]
        scores = np.zeros(len(index.ids))
        for t in terms:
            scores[index.item[index.start[t] : index.end[t]]] += index.impact[index.start[t] : index.end[t]]
        found = dict(index.wand(index.lists(terms, 0, len(index.ids))))
        assert set(found) == set(np.flatnonzero(scores >= 1 - 1e-9).tolist())
        assert all(np.isclose(scores[k], s) for k, s in found.items())


def test_planted(spark, make):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 5)))
    items = [(k, " ".join(word() for _ in range(r.choice((12, 40, 90)))) + ". " + " ".join(word() for _ in range(r.choice((1, 3, 12)))) + ".") for k in range(60)]
    rows, expected = [], set()
    for i in range(120):
        body = [word() for _ in range(r.randint(0, 400))]
        if i % 3 == 0:
            k = r.randrange(60)
            planted = items[k][1].upper() if i % 2 else re.sub(r"\s", "\n", items[k][1]) + "***"
            at = r.randint(0, len(body))
            body[at:at] = [planted]
            expected.add((i, k))
        rows.append((i, " ".join(body)))
    rows += [(200, None), (201, ""), (None, items[0][1]), (202, "x " * 50_000 + items[1][1]), (202, "x " * 50_000 + items[1][1])]
    benchmark = spark.createDataFrame([*items, (99, None), (98, ""), (None, "no id at all but some words here. yes.")], "item_id long, text string")
    found = dc.contaminated(make(rows), benchmark).collect()
    assert {(x.doc_id, x.item_id) for x in found} == expected | {(None, 0), (202, 1)}
    assert sum(x.doc_id == 202 for x in found) == 2
    clean = dc.decontaminate(make(rows), benchmark)
    assert clean.columns == make(rows).columns
    assert sorted(x.doc_id for x in clean.collect()) == sorted({i for i, _ in rows if i is not None} - {i for i, _ in expected} - {202})
    assert dc.contaminated(make(rows), benchmark.limit(0)).count() == 0 and dc.decontaminate(make(rows), benchmark.limit(0)).count() == len(rows)
    assert dc.contaminated(make(rows).limit(0), benchmark).count() == 0
    odd = make(rows).selectExpr("doc_id", "text", "lang AS score", "1 AS _text")
    assert dc.contaminated(odd, benchmark, keep=("doc_id", "_text")).count() == len(found)


def test_shards_and_question_answer_columns(spark, make, monkeypatch):
    monkeypatch.setattr(dc, "SHARD_ITEMS", 2)
    qa = [(k, f"what is the {w} of the matter in question here", f"the answer to it is {w} {w}x") for k, w in enumerate(("alpha", "beta", "gamma", "delta", "eps"))]
    docs = make([(1, f"intro {qa[3][1]} then {qa[3][2]} end"), (2, f"only {qa[2][1]}"), (3, "nothing")])
    found = dc.contaminated(docs, spark.createDataFrame(qa, "item_id long, question string, answer string")).collect()
    assert [(x.doc_id, x.item_id) for x in found] == [(1, 3)]


def test_query(spark, sf):
    docs = {r.doc_id: " " + " ".join(words(r.text)) + " " for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: " " + " ".join(words(r.text)) + " " for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    assert {(r.doc_id, r.item_id) for r in op9_decontaminate(spark, sf).collect()} >= {(i, k) for i, t in docs.items() for k, x in items.items() if x in t}


def brute(docs, items):
    """(doc, item): best (score, question share, answer share) of each verified pair, by plain BM25 of every passage and item."""
    split = {i: tuple(words(x) for x in dc.question_and_answer(t or "")) for i, t in items}
    lengths = {i: len(q) + len(a) for i, (q, a) in split.items()}
    mean, df = sum(lengths.values()) / len(split), {}
    for q, a in split.values():
        for w in set(q + a):
            df[w] = df.get(w, 0) + 1

    def impact(i, w):
        n, tf = len(split), (split[i][0] + split[i][1]).count(w)
        return np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (dc.K1 + 1) / (tf + dc.K1 * (1 - dc.B + dc.B * lengths[i] / mean))

    impacts = {i: {w: impact(i, w) for w in set(q + a)} for i, (q, a) in split.items() if q + a}
    grams = lambda ws, n: {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}
    out = {}
    for d, text in docs:
        ws = words(text)
        for i, own in impacts.items():
            half = 64
            while half < lengths[i]:
                half *= 2
            for start in range(0, max(1, -(-len(ws) // half) - 1) * half, half):
                passage = ws[start : start + 2 * half]
                score = sum(own[w] for w in set(passage) & own.keys()) / sum(own.values())
                if score >= dc.SHARE - 1e-9:
                    shares = []
                    for part in split[i]:
                        g = grams(part, min(3, len(part))) if part else set()
                        shares.append(len(g & grams(passage, min(3, len(part)))) / len(g) if g else 1.0)
                    if shares[0] >= dc.OVERLAP and shares[1] >= dc.ANSWER:
                        out[d, i] = max(out.get((d, i), (0, 0, 0)), (score, *shares))
    return out


def same(found, expected):
    assert {(r.doc_id, r.item_id) for r in found} == set(expected)
    for r in found:
        assert np.allclose((r.score, r.question_overlap, r.answer_overlap), expected[r.doc_id, r.item_id])


def test_query_against_plain_bm25(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    same(op9_decontaminate(spark, sf).collect(), brute(docs, items))


@pytest.mark.parametrize("shard", [1, 2, 5000])
def test_results_do_not_depend_on_shards(spark, make, monkeypatch, shard):
    """Short items, one of 400 words, and texts that hold parts of them; with shards of one item also in several passes."""
    monkeypatch.setattr(dc, "SHARD_ITEMS", shard)
    if shard == 1:
        monkeypatch.setattr(dc, "BROADCAST", 1)
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefg") for _ in range(r.randint(2, 4))) for _ in range(60)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(some(n)) + ". " + " ".join(some(4))) for k, n in enumerate((8, 12, 70, 400, 30))]
    texts = []
    for i in range(30):
        parts = items[i % 5][1].split()
        held = parts[r.randint(0, len(parts) // 3) :]
        gap = some(r.choice((0, 40, 100)))
        cut = r.randint(0, len(held))
        texts.append((i, " ".join([*some(r.randint(0, 300)), *held[:cut], *gap, *held[cut:], *some(50)])))
    expected = brute(texts, items)
    assert 5 < len(expected) < 30
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    same(dc.contaminated(make(texts), benchmark).collect(), expected)
    assert {x.doc_id for x in dc.decontaminate(make(texts), benchmark).collect()} == set(range(30)) - {d for d, _ in expected}


def test_kept_columns_give_way_to_results(spark, make):
    item = "what do you call the thing that is here. it is a word."
    docs = make([(1, item)]).selectExpr("*", "7 AS score", "8 AS item_id", "9 AS n", "1 AS _k0")
    found = dc.contaminated(docs, spark.createDataFrame([(5, item)], "item_id long, text string"), keep=("doc_id", "score", "item_id", "n", "_k0"))
    assert found.columns == ["doc_id", "n", "_k0", "item_id", "score", "question_overlap", "answer_overlap"]
    assert [(r.doc_id, r.n, r.item_id) for r in found.collect()] == [(1, 9, 5)]
    assert dc.decontaminate(docs, spark.createDataFrame([(5, "other words in here. and so on")], "item_id long, text string")).columns == docs.columns
