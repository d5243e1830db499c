"""The training-data pipeline over documents.

Stages, each over all that its predecessor kept: toxic documents go, one document of each group of near
copies stays, documents that hold benchmark items go, live secrets are masked in the text, and the rest
is encoded.  All but the last return the columns of documents, extra ones included, whatever their names.

Null texts are empty: they stay, with no tokens.  Null ids, sources and languages are values like others;
repeated rows are copies, of which one stays if the text has words, and all if it has none.  Empty tables
give no rows; without labels nothing is toxic, without a benchmark nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import bpe, decontaminate, jaccard_join, secrets, toxicity
from pathloom.llm.common import discard, packed, passing, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic, by a classifier chain fitted on the labels, is under one half."""
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.CATEGORIES)
    rows = docs.select(packed(docs).alias("_row"), F.col("text").alias("_body"))
    return toxicity.score(rows, chain, keep=("_row",), text_col="_body").filter("p_toxic < 0.5").select("_row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each component of the n-gram Jaccard join; texts without words stay."""
    return jaccard_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with owner-specific secrets masked; n_chars follows the text."""
    done = secrets.redact(docs, repo=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and token_ids of every document."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("jaccard_join", drop_near_copies), ("decontaminate", drop_benchmark), ("secrets", mask_secrets), ("byte_bpe", tokenize)]

#: SQL can't express the classifier chain; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each stage's result is a table in the shared folder.

    When it is written, the tables that the stage made on the way and the one it read are deleted.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with passing(spark) as made:
            docs = written(stage(spark, docs, sf_dir))
            made.remove(docs.held)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
