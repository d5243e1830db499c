"""Benchmark decontamination: BM25 with block-max WAND over test items, then overlap verification.

The test items are the indexed documents; every passage of every training text is a query.  An item's
passages have ``PASSAGE`` words, doubled until the item has at most half as many, at steps of half of
that; so every item stands whole in some passage, and its own length alone decides how long they are.
Words are lower-cased (A-Z) runs of bytes other than ASCII white space and punctuation; a word's weight
in an item is its BM25 impact, divided by the item's threshold (``SHARE`` of the score that the item gets
as its own query), so an item is retrieved at 1 or more.
A passage can't retrieve items of a range in which its words' largest impacts sum to less than 1; for the
other ranges the posting lists are walked with block-max WAND, which retrieves every item at 1 or more.

A retrieved item is verified on the passage: shares of the 3-word runs of its question and of its answer
that stand in the passage must reach ``OVERLAP`` and ``ANSWER``.  Items with a single text column are
split before their last sentence (or in the middle): question, then answer.

Spark counts the terms and builds the index in shards of about ``SHARD_ITEMS`` items of one passage
length; document frequencies and mean lengths are of all items, and every shard meets every document, so
shards don't change results.  The shards are broadcast together, up to ``BROADCAST`` bytes for a pass
over the documents; a larger index takes more passes, one after another.

Null texts and items are empty and match nothing; an empty benchmark or empty documents give no rows;
repeated documents are reported each, equal items with different ids all; a kept column named like a
result gives way to it.  Texts of any length are read whole.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pathloom.llm import wordhash as wh
from pathloom.llm.common import arrow_schema, kept, lean, partitions, written

PASSAGE = 128
K1, B = 1.2, 0.75
SHARE = 0.6
OVERLAP, ANSWER = 0.5, 0.5
#: Postings of a block; ranges of items whose largest impacts are looked at first.
BLOCK, PARTS = 8, 100
SHARD_ITEMS = 5_000
#: Bytes of index that are broadcast for one pass over the documents (one shard at least).
BROADCAST = 64 << 20
#: Parts that the items of a frequent term are dealt to when terms meet their counts.
SALTS = 16
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def question_and_answer(text: str) -> tuple[str, str]:
    """text before its last sentence and the last sentence; a single sentence is halved by words."""
    parts = _SENTENCE.split(text.strip())
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    return " ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])


def word_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return wh.words(raw, np.array([0, len(raw)]), lower=True, plain=True)[0]


def runs(h: np.ndarray, size: int = 3) -> np.ndarray:
    """Distinct hashes of the runs of size words, or of the whole if it is shorter."""
    return np.unique(wh.grams(h, min(size, len(h)))) if len(h) else np.zeros(0, np.uint64)


def length_class(n: int) -> int:
    """How often PASSAGE is doubled for an item of n words."""
    return max(0, (2 * n - 1) // PASSAGE).bit_length()


def scored(n: int, terms: np.ndarray, tf: np.ndarray, df: np.ndarray, n_items: int, mean: float) -> tuple[float, np.ndarray]:
    """An item's BM25 score as its own query, and the impact of each of its terms; n: its words."""
    impact = np.log1p((n_items - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / max(mean, 1e-9)))
    return math.fsum(impact), impact


class Index:
    """Posting lists with normalised impacts.

    Items stand by their own score, so that neighbours have like thresholds; ``part_max`` holds each
    term's largest impact in each of a few ranges of items, ``block_max`` in each block of a posting list.
    """

    def __init__(self, items: list[tuple], df: dict[int, int], n_items: int, mean: float, passage: int = PASSAGE) -> None:
        """items: (id, question, answer)."""
        made = []
        for id_, question, answer in items:
            q, a = word_hashes(question), word_hashes(answer)
            terms, tf = np.unique(np.concatenate([q, a]), return_counts=True)
            made.append((*scored(len(q) + len(a), terms, tf, np.array([df[t] for t in terms.tolist()], float), n_items, mean), id_, terms, runs(q), runs(a)))
        self._lay(made, passage)

    @classmethod
    def of(cls, made: list[tuple], passage: int) -> Index:
        """made: (own score, impacts, id, terms, runs of the question, runs of the answer) of each item."""
        index = cls.__new__(cls)
        index._lay(made, passage)
        return index

    def _lay(self, made: list[tuple], passage: int) -> None:
        made = sorted((m for m in made if len(m[3])), key=lambda m: m[0])
        self.passage = passage
        self.ids, self.question, self.answer = [m[2] for m in made], [m[4] for m in made], [m[5] for m in made]
        term = np.concatenate([m[3] for m in made]) if made else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(made)), [len(m[3]) for m in made])
        impact = np.concatenate([m[1] / (SHARE * m[0]) for m in made]) if made else np.zeros(0)
        order = np.lexsort((item, term))
        term, self.item, self.impact = term[order], item[order], impact[order]
        self.terms, self.start = np.unique(term, return_index=True)
        self.end = np.concatenate([self.start[1:], [len(term)]]).astype(np.int64)
        self.bounds = np.unique(np.linspace(0, len(made), PARTS + 1).astype(np.int64))
        self.part_max = np.zeros((len(self.terms), max(1, len(self.bounds) - 1)), np.float32)
        part = np.searchsorted(self.bounds, self.item, "right") - 1
        np.maximum.at(self.part_max, (np.searchsorted(self.terms, term), part), self.impact.astype(np.float32) * np.float32(1.00001))
        bits = 1 << 20
        self.seen = np.zeros(bits, bool)
        self.seen[(self.terms & np.uint64(bits - 1)).astype(np.int64)] = True

    def columns(self, h: np.ndarray) -> np.ndarray:
        """The term of each word, or -1."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.terms):
            return out
        maybe = np.flatnonzero(self.seen[(h & np.uint64(len(self.seen) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, h[maybe]), len(self.terms) - 1)
        hit = self.terms[at] == h[maybe]
        out[maybe[hit]] = at[hit]
        return out

    def lists(self, terms: np.ndarray, low: int, high: int) -> list[list]:
        """Posting lists cut to items low to high: items, impacts, block maxima, list maximum, position."""
        out = []
        for t in terms.tolist():
            items = self.item[self.start[t] : self.end[t]]
            a, z = np.searchsorted(items, [low, high])
            if a < z:
                impact = self.impact[self.start[t] + a : self.start[t] + z]
                out.append([items[a:z].tolist(), impact.tolist(), np.maximum.reduceat(impact, np.arange(0, z - a, BLOCK)).tolist(), float(impact.max()), 0])
        return out

    @staticmethod
    def wand(lists: list[list]) -> list[tuple[int, float]]:
        """(item, score) of all items that the lists together score at 1 or more, by block-max WAND."""
        found = []

        def advance(x: list, to: int) -> None:
            x[4] = bisect_left(x[0], to, x[4])

        while True:
            lists = [x for x in lists if x[4] < len(x[0])]
            lists.sort(key=lambda x: x[0][x[4]])
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                bound += x[3]
                if bound >= 1 - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                return found
            doc = lists[pivot][0][lists[pivot][4]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][4]] == doc:
                pivot += 1
            near = lists[: pivot + 1]
            blocks, limit = 0.0, lists[pivot + 1][0][lists[pivot + 1][4]] if pivot + 1 < len(lists) else 1 << 62
            for x in near:
                at = bisect_left(x[0], doc, x[4])
                if at < len(x[0]):
                    b = at // BLOCK
                    blocks += x[2][b]
                    limit = min(limit, x[0][min((b + 1) * BLOCK, len(x[0])) - 1] + 1)
            if blocks < 1 - 1e-9:  # nothing up to the end of these blocks reaches the threshold
                for x in near:
                    advance(x, max(limit, doc + 1))
            elif lists[0][0][lists[0][4]] == doc:
                score = math.fsum(x[1][x[4]] for x in near)
                if score >= 1 - 1e-9:
                    found.append((doc, score))
                for x in near:
                    x[4] += 1
            else:
                for x in near:
                    advance(x, doc)

    def passages(self, h: np.ndarray, row: np.ndarray):
        """(row, item, score, question share, answer share) of every verified item of every passage."""
        if not len(h) or not len(self.terms):
            return
        term, half = self.columns(h), self.passage // 2
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        lengths = np.diff(np.concatenate([first, [len(row)]]))
        halves = -(-lengths // half)
        base = np.concatenate([[0], np.cumsum(halves)[:-1]])
        number = np.repeat(base, lengths) + (np.arange(len(row)) - np.repeat(first, lengths)) // half
        hit = term >= 0
        pairs = np.unique(number[hit] * len(self.terms) + term[hit])
        at, terms = pairs // len(self.terms), pairs % len(self.terms)
        bound = np.zeros((int(halves.sum()), self.part_max.shape[1]), np.float32)
        edges = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        for low in range(0, len(edges), 1024):  # the gathered maxima stay small in long texts
            some = edges[low : low + 1024]
            end = edges[low + 1024] if low + 1024 < len(edges) else len(at)
            bound[at[some]] = np.add.reduceat(self.part_max[terms[some[0] : end]], some - some[0], axis=0)
        last = np.zeros(len(bound), bool)
        last[base + halves - 1] = True
        joined = bound.copy()
        joined[:-1][~last[:-1]] += bound[1:][~last[:-1]]
        whole = halves > 1
        last[(base + halves - 1)[~whole]] = False  # a text's only half is a passage; else the last half is in the one before
        starts = np.concatenate([edges, [len(at)]])
        place = np.full(len(bound) + 1, -1)
        place[at[edges]] = np.arange(len(edges))
        owner = np.repeat(np.arange(len(first)), halves)
        for k in np.flatnonzero(~last & (joined.max(1) >= 0.999)).tolist():
            o = owner[k]
            mine = [terms[starts[place[j]] : starts[place[j] + 1]] for j in (k, k + 1) if j < base[o] + halves[o] and place[j] >= 0]
            own = np.unique(np.concatenate(mine))
            parts = np.flatnonzero(self.part_max[own].sum(0) >= 0.999)
            shingles = None
            for p in parts.tolist():
                for item, score in self.wand(self.lists(own, self.bounds[p], self.bounds[p + 1])):
                    if shingles is None:
                        s = first[o] + (k - base[o]) * half
                        words = h[s : min(s + 2 * half, first[o] + lengths[o])]
                        shingles = np.unique(np.concatenate([wh.grams(words, n) for n in (1, 2, 3)]))
                    shares = [float(np.isin(g, shingles).mean()) if len(g) else 1.0 for g in (self.question[item], self.answer[item])]
                    if shares[0] >= OVERLAP and shares[1] >= ANSWER:
                        yield int(row[first[o]]), self.ids[item], score * SHARE, *shares


def _described(item_type, split: bool):
    """Items (id, question, answer or text) to their id, passage class, words, terms with counts, and runs."""
    schema = StructType([StructField("id", item_type), *StructType.fromDDL("class int, n int, terms array<struct<term:bigint,tf:int>>, question array<bigint>, answer array<bigint>").fields])
    arrow = arrow_schema(schema)

    def run(batches):
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                texts = question_and_answer(row[1] or "") if split else (row[1] or "", row[2] or "")
                q, a = map(word_hashes, texts)
                terms, tf = np.unique(np.concatenate([q, a]), return_counts=True)
                n = len(q) + len(a)
                out.append((length_class(n), n, [{"term": t, "tf": k} for t, k in zip(terms.view(np.int64).tolist(), tf.tolist(), strict=True)], runs(q).view(np.int64), runs(a).view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow.field(0).type), *[pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), list(arrow)[1:], strict=True)]], schema=arrow)

    return schema, run


def _build(n_items: int, mean: float):
    """Items sorted by class and shard to the pickled index of each shard."""
    arrow = pa.schema([("class", pa.int32()), ("shard", pa.int32()), ("index", pa.binary())])

    def run(batches):
        at, made = None, []

        def done():
            index = pickle.dumps(Index.of(made, PASSAGE << at[0]), 5)
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([index], pa.binary())], schema=arrow)

        for b in batches:
            for c, shard, id_, n, postings, q, a in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if at != (c, shard):
                    if made:
                        yield done()
                    at, made = (c, shard), []
                term, tf, df = (np.array([p[k] for p in postings], t) for k, t in (("term", np.int64), ("tf", np.int64), ("df", float)))
                order = np.argsort(term.view(np.uint64))
                terms = term.view(np.uint64)[order]
                made.append((*scored(n, terms, tf[order], df[order], n_items, mean), id_, terms, np.array(q, np.int64).view(np.uint64), np.array(a, np.int64).view(np.uint64)))
        if made:
            yield done()

    return run


def indexes(benchmark: DataFrame, id_col: str = "item_id"):
    """Lists of index shards, each list of at most BROADCAST bytes or one shard.

    benchmark has id_col and either question and answer, or text.  The driver holds one list at a time.
    """
    spark = benchmark.sparkSession
    split = not {"question", "answer"} <= set(benchmark.columns)
    schema, describe = _described(benchmark.schema[id_col].dataType, split)
    items = benchmark.select(F.col(id_col).alias("id"), *(["text"] if split else ["question", "answer"])).mapInArrow(lean(describe), schema)
    items = written(items.withColumn("key", F.monotonically_increasing_id()))
    total = items.agg(F.count("*").alias("n"), F.sum("n").alias("words")).first()
    if not total["words"]:
        return
    sizes = {r["class"]: r["count"] for r in items.filter("n > 0").groupBy("class").count().collect()}
    shards = F.element_at(F.create_map(*[F.lit(x) for c, k in sizes.items() for x in (c, -(-k // SHARD_ITEMS))]), F.col("class"))
    items = items.filter("n > 0").withColumn("shard", F.pmod(F.xxhash64("key"), shards).cast("int"))
    terms = items.select("key", F.inline("terms")).withColumn("salt", F.pmod("key", F.lit(SALTS)))
    df = terms.groupBy("term").agg(F.count("*").alias("df")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    postings = terms.join(df, ["term", "salt"]).groupBy("key").agg(F.collect_list(F.struct("term", "tf", "df")).alias("postings"))
    made = items.select("key", "class", "shard", "id", "n", "question", "answer").join(postings, "key").select("class", "shard", "id", "n", "postings", "question", "answer")
    made = made.repartition(partitions(spark), "class", "shard").sortWithinPartitions("class", "shard").mapInArrow(lean(_build(total["n"], total["words"] / total["n"])), "class int, shard int, index binary")
    held, size = [], 0
    for r in written(made).orderBy("class", "shard").toLocalIterator():
        if held and size + len(r["index"]) > BROADCAST:
            yield held
            held, size = [], 0
        held.append(pickle.loads(r["index"]))
        size += len(r["index"])
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """A row for each row of docs and test item that it holds: the columns in keep, item_id, score (share of the item's own BM25 score, of the best passage), question_overlap, answer_overlap."""
    spark = docs.sparkSession
    kinds = {f.name: f.dataType for f in docs.schema}
    keep = kept(keep, ["item_id", "score", "question_overlap", "answer_overlap"])
    schema = StructType([StructField(c, kinds[c]) for c in keep] + [StructField("item_id", benchmark.schema["item_id"].dataType)]).add("score", "double").add("question_overlap", "double").add("answer_overlap", "double")
    arrow, n = arrow_schema(schema), len(keep)
    source = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    before = out = None
    for shards in indexes(benchmark):
        index = spark.sparkContext.broadcast(shards)

        def run(batches, index=index):
            for b in batches:
                for low, data, offsets in wh.chunks(b.column(n)):
                    h, row, _ = wh.words(data, offsets, lower=True, plain=True)
                    best: dict[tuple, tuple] = {}
                    for shard in index.value:
                        for r, item, *figures in shard.passages(h, row):
                            if (r, item) not in best or best[r, item] < tuple(figures):
                                best[r, item] = tuple(figures)
                    if best:
                        at = pa.array([low + r for r, _ in best])
                        columns = [b.column(i).take(at) for i in range(n)] + [pa.array([i for _, i in best], arrow.field(n).type)]
                        columns += [pa.array([f[k] for f in best.values()], pa.float64()) for k in range(3)]
                        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        if before is not None:  # a further pass: the one before is done and its shards are let go
            out = written(out)
            before.destroy()
        part = source.mapInArrow(lean(run), schema)
        out, before = (part if out is None else out.unionByName(part)), index
    return spark.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text holds no test item, with the columns of docs.

    One pass marks texts; a marked row is dropped where it stands, so there is no join.
    """
    before = None
    for shards in indexes(benchmark):
        if before is not None:
            docs = written(docs)
            before.destroy()
        before = docs.sparkSession.sparkContext.broadcast(shards)
        docs = docs.filter(~_holds(before)(F.coalesce(F.col(text_col), F.lit(""))))
    return docs


def _holds(index):
    @F.pandas_udf("boolean")
    def held(texts):
        import pandas as pd

        marks = np.zeros(len(texts), bool)
        for low, data, offsets in wh.chunks(pa.array(texts, pa.string())):
            h, row, _ = wh.words(data, offsets, lower=True, plain=True)
            for shard in index.value:
                for r, *_ in shard.passages(h, row):
                    marks[low + r] = True
        return pd.Series(marks)

    return held
