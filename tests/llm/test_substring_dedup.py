import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.llm import substring_dedup as sd
from pathloom.llm.automaton import SuffixAutomaton
from pathloom.llm.queries import op1_substring_dedup


def brute(texts, window):
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[j : j + window]) for w in split for j in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=30), min_size=1, max_size=5), st.integers(1, 5))
def test_automaton_counts(sequences, n):
    automaton = SuffixAutomaton()
    for s in sequences:
        automaton.add(s)
    automaton.count()
    counts = Counter(tuple(s[j : j + n]) for s in sequences for j in range(len(s) - n + 1))
    for s in sequences:
        assert list(automaton.matches(s, n)) == [(j + n, counts[tuple(s[j : j + n])]) for j in range(len(s) - n + 1)]


@pytest.mark.parametrize(("shard", "gather"), [(2000, 500), (2, 1)])
def test_against_brute_force(make, monkeypatch, shard, gather):
    """Small shards, so that frequent anchors are dealt to several."""
    monkeypatch.setattr(sd, "SHARD", shard)
    monkeypatch.setattr(sd, "GATHER", gather)
    r = random.Random(shard)
    word = lambda: r.choice("abcdefghij") + r.choice("xyz") * r.randint(1, 4)
    passage = [word() for _ in range(60)]
    texts = [None, "", "  \t\n", "one", "same " * 200, "same " * 40]
    for _ in range(40):
        body = [word() for _ in range(r.randint(0, 120))]
        if r.random() < 0.6:
            a = r.randint(0, 20)
            cut = list(passage[a : a + r.randint(5, 40)])
            if r.random() < 0.3:
                cut[len(cut) // 2] = "changed"
            at = r.randint(0, len(body))
            body[at:at] = cut
        texts.append(" ".join(body))
    texts += texts[10:14] + [" ".join(passage)] * 2 + ["\u00e9\u2003x " * 30]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)]
    window = 12
    got = sd.substring_dedup(make(rows), window=window).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter((i, *b) for (i, _), b in zip(rows, brute(texts, window)))


def test_repeated_rows_empty_table_and_clashing_columns(make):
    text = " ".join(f"w{i}" for i in range(40))
    docs = make([(1, text), (1, text), (2, "short")])
    assert sorted((r.doc_id, r.n_removed) for r in sd.substring_dedup(docs).collect()) == [(1, 40), (1, 40), (2, 0)]
    odd = docs.selectExpr("doc_id", "text", "doc_id AS _t", "text AS _text", "lang AS marks")
    kept = sd.substring_dedup(odd, keep=("_t", "marks")).collect()
    assert sorted((r._t, r.n_removed) for r in kept) == [(1, 40), (1, 40), (2, 0)]
    assert sd.substring_dedup(docs.limit(0)).count() == 0


def test_long_text(make):
    text = " ".join(f"v{i}" for i in range(300_000))
    rows = {r.doc_id: r for r in sd.substring_dedup(make([(1, text), (2, " ".join(f"v{i}" for i in range(1000, 1050)))]), with_text=False).collect()}
    assert rows[1].n_words == 300_000 and rows[1].n_removed == 50 and rows[2].n_removed == 50


def test_broadcast_references(make):
    references = make([(1, " ".join(f"r{i}" for i in range(50)))])
    docs = make([(1, "a " + " ".join(f"r{i}" for i in range(5, 45)) + " b"), (2, None)])
    remover = sd.SpanRemover(references, window=35)
    assert sorted((r.doc_id, r.n_removed, r.kept_text) for r in remover.apply(docs).collect()) == [(1, 40, "a b"), (2, 0, "")]
    with pytest.raises(ValueError):
        sd.SpanRemover(references, limit=10)


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op1_substring_dedup(spark, sf).collect()}
    assert got == dict(zip([r.doc_id for r in rows], brute([r.text for r in rows], 35)))
