"""The pipeline against a plain version of each stage on a small corpus."""

import corpus_pipeline
import public_tokenizers as tokenizers

from pathloom.llm import bpe, secrets, toxicity
from test_jaccard_join import brute, shingles  # noqa: I001


def plain(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    chain = toxicity.fit(docs, labels, toxicity.CATEGORIES)
    rows = [r for r in rows if chain.score(r.text or "")[-1] < 0.5]
    least = {c for _, n, c in brute([(r.doc_id, r.text) for r in rows]) if n}
    rows = [r for r in rows if r.doc_id in least or not shingles(r.text)]
    words = lambda t: " " + " ".join("".join(c.lower() if c.isalnum() or c >= "\x80" else " " for c in t).split()) + " "
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(x in words(r.text) for x in items)]
    owners: dict = {}
    for r in rows:
        for _, _, _, v, w in secrets.base_spans(r.text) + secrets.other_spans(r.text, secrets.base_spans(r.text)):
            owners.setdefault(r.text[v:w], set()).add(r.source)
    model, out = bpe.Bpe(open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), tokenizers.PATTERN), {}
    for r in rows:
        text, at, parts = r.text, 0, []
        spans = secrets.base_spans(text) + secrets.other_spans(text, secrets.base_spans(text))
        for v, w in sorted({(v, w) for _, _, _, v, w in spans if len(owners[text[v:w]]) < secrets.WIDE and secrets.entropy(text[v:w]) >= secrets.ENTROPY}):
            if w > at:
                parts += [text[at : max(v, at)], "[SECRET]"]
                at = w
        out[r.doc_id] = model.encode("".join(parts) + text[at:])
    return out


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == plain(spark, sf)


def test_stages_keep_the_columns_of_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "decontaminate", "secrets", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_nulls_repeated_rows_and_clashing_columns(spark, tmp_path):
    """Every stage on odd rows, with columns named like results and internal ones."""
    sf = "/root/testdata/sf0.001"
    labels, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    item = benchmark.first().text
    secret = "my password: Zx8Qw7Er6Ty5 is here with some more words"
    rows = [(1, None, "en", "a", None), (1, None, "en", "a", None), (2, "", None, None, 0), (None, "five words of some text here", "en", "b", 28), (3, "five words of some text here", "en", "b", 28), (3, "five words of some text here", "en", "b", 28), (4, "x " + item + " y", "en", "c", 9), (5, secret, "de", "d", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "0.9D AS p_toxic", "1 AS _spans", "2 AS _row", "3 AS label", "4 AS _v", "5 AS score", "6 AS token_ids", "7 AS _t")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    model = bpe.Bpe(open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), tokenizers.PATTERN)
    assert sorted((r.doc_id or 0, model.decode(r.token_ids).decode()) for r in got) == [(1, ""), (1, ""), (2, ""), (3, rows[3][1]), (5, secret.replace("Zx8Qw7Er6Ty5", "[SECRET]"))]
    empty = tmp_path / "empty"
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        table.limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
