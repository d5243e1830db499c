import hashlib
import random
import re

import public_tokenizers as tokenizers
import pytest

from pathloom.llm import bpe
from pathloom.llm.queries import op2_byte_bpe

RANKS, PATTERN = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN


@pytest.fixture(scope="module")
def model():
    return bpe.Bpe(open(RANKS, "rb").read(), PATTERN)


def test_split_texts_have_the_same_ids(model, monkeypatch):
    r = random.Random(3)
    monkeypatch.setattr(bpe, "GIANT", 10)
    monkeypatch.setattr(bpe, "_RUN", re.compile(r"\S{10,}|\s{10,}"))
    for _ in range(200):
        text = "".join(r.choice(["ab", "the ", "  ", "\n\n", " \t", "é", "ñ1", "'s", "...", " ", "\x1c", "\x85", "日本", "😀", " a"]) for _ in range(r.randint(0, 300)))
        monkeypatch.setattr(bpe, "LONG", r.choice([5, 50, 50_000]))
        ids = model.encode(text)
        assert ids == model.encoding.encode_ordinary(text)
        assert model.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 30_000, " " * 50_000 + "x", "ab" * 5_000, "日" * 4_000, "<|endoftext|>"])
def test_giant_matches(model, text):
    assert model.encode(text) == model.encoding.encode_ordinary(text)


def test_operator(make, model):
    rows = [(1, "Hello there"), (1, "Hello there"), (None, None), (2, ""), (3, "x y " * 40_000)]
    out = bpe.encode(make(rows), RANKS, PATTERN)
    for r in out.collect():
        text = {1: "Hello there", 3: "x y " * 40_000}.get(r.doc_id, "")
        ids = model.encoding.encode_ordinary(text)
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert {bytes(r.decoded).decode() for r in bpe.decode(out, RANKS, PATTERN).collect()} == {"Hello there", "", "x y " * 40_000}
    assert bpe.encode(make(rows).limit(0), RANKS, PATTERN).count() == 0
    assert bpe.encode(make(rows).selectExpr("doc_id", "text", "lang AS _k0"), RANKS, PATTERN, keep=("_k0", "doc_id")).count() == 5


def test_query(spark, sf, model):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op2_byte_bpe(spark, sf).collect():
        ids = model.encoding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
