"""Toxicity by a classifier chain.

Categories are predicted in a fixed order.  Each category has a linear (logistic) model over words
and beginnings of words, some figures of the text, and the probabilities of the earlier categories.  While training,
those probabilities are out of fold: a fold's model, its vocabulary included, is made from the other
folds alone.  Folds go by text, so copies never stand on both sides.

The model is fitted on at most ``SAMPLE`` labelled ids (those of least hash), one text for each; its
vocabulary counts are made by Spark over these texts.  All documents are scored, whole texts.

Null texts are empty; rows without label, and labels that are null in a category, don't train it; a
category without both values in the sample gets its rate (0 without labels) as probability.  An id with
several labels has the greatest, one with several texts trains with that of least hash.  Repeated rows
are scored alike; an empty table gives no rows; a kept column named like a result gives way to it.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pathloom.llm.common import arrow_schema, kept, lean, written

#: Labelled rows that train the model, at most.
SAMPLE = 20_000
#: Words of the vocabulary for each category, at most, and labelled texts in which one must stand.
WORDS, LEAST = 400, 4
FOLDS = 5
_WORD = re.compile(r"[^\W\d_]+")
FIGURES = 6


def words(text: str) -> set[str]:
    """The words (runs of letters, lower case) and their first four and five letters, marked by a star."""
    found = set(_WORD.findall(text.lower()))
    return found | {w[:4] + "*" for w in found if len(w) > 4} | {w[:5] + "*" for w in found if len(w) > 5}


def figures(text: str) -> list[float]:
    """Length, share of white space, of symbols and of digits, share of repeated lines, mean line length; each of about unit size."""
    n = len(text) or 1
    plain = text.encode("ascii", "replace")
    white = sum(map(plain.count, (b" ", b"\n", b"\t")))
    digits = sum(plain.count(b"%d" % d) for d in range(10))
    symbols = sum(map(plain.count, (b"%", b"&", b"*", b"#", b"$", b"|", b"<", b">", b"{", b"}", b"=")))
    lines = text.split("\n")
    return [math.log1p(n) / 10, white / n * 5, symbols / n * 5, digits / n * 5, 1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)) / 10]


@dataclass
class Chain:
    """vocabulary: word to column; weights: one vector for each category (words, figures, earlier probabilities, 1)."""

    categories: list[str]
    vocabulary: dict[str, int]
    weights: list[np.ndarray] = field(default_factory=list)

    def features(self, text: str) -> tuple[list[int], list[float]]:
        v = self.vocabulary
        return [v[w] for w in words(text) & v.keys()], figures(text)

    def score(self, text: str) -> list[float]:
        present, numbers = self.features(text)
        n, out = len(self.vocabulary), []
        for w in self.weights:
            z = float(w[present].sum()) + float(np.dot(w[n : n + FIGURES], numbers)) + sum(map(float.__mul__, out, w[n + FIGURES : -1].tolist())) + float(w[-1])
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return out


class Rows:
    """A design matrix: columns that are 1 (by row and column number) and dense columns after them, the last of them constant."""

    def __init__(self, row: np.ndarray, column: np.ndarray, width: int, dense: np.ndarray) -> None:
        self.row, self.column, self.width, self.dense = row, column, width, dense

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.column], minlength=len(self.dense)) + self.dense @ w[self.width :]

    def transposed_times(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.column, weights=r[self.row], minlength=self.width), self.dense.T @ r])

    def take(self, mask: np.ndarray) -> Rows:
        number = np.cumsum(mask) - 1
        kept = mask[self.row]
        return Rows(number[self.row[kept]], self.column[kept], self.width, self.dense[mask])

    def only(self, columns: np.ndarray) -> Rows:
        """The same rows with just some of the columns that are 1."""
        kept = columns[self.column]
        return Rows(self.row[kept], self.column[kept], self.width, self.dense)

    def with_column(self, values: np.ndarray) -> Rows:
        return Rows(self.row, self.column, self.width, np.concatenate([self.dense[:, :-1], values[:, None], self.dense[:, -1:]], 1))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: Rows, y: np.ndarray, steps: int = 600, shrink: float = 0.3, l2: float = 1e-5, tolerance: float = 1e-4) -> np.ndarray:
    """Weights by accelerated proximal gradient, from zero, with an L1 term of shrink in all; the last column, constant, isn't shrunk."""
    n, size = len(y), x.width + x.dense.shape[1]
    if n == 0 or y.min() == y.max():
        w = np.zeros(size)
        w[-1] = 30 if n and y[0] else -30
        return w
    # each weight is measured in units of its column's size, so that rare words move as fast as frequent ones
    scale = 1 / np.sqrt((np.concatenate([np.bincount(x.column, minlength=x.width), (x.dense**2).sum(0)]) + 1) / n)
    v = np.ones(size)
    for _ in range(20):  # the largest eigenvalue, for the step
        v = scale * x.transposed_times(x.times(scale * v))
        norm = float(np.linalg.norm(v))
        v /= norm
    step = 0.9 * scale**2 / (0.25 * norm / n + l2 * float(scale.max()) ** 2)
    w = z = np.zeros(size)
    t = 1.0
    for _ in range(steps):
        new = z - step * (x.transposed_times(sigmoid(x.times(z)) - y) / n + l2 * z)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step[:-1] * shrink / n, 0)
        if (np.abs(new - w) / scale).max() < tolerance:
            return new
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        back = float(((z - new) / scale**2) @ (new - w)) > 0  # the momentum has gone too far
        t_new = 1.0 if back else t_new
        z = new if back else new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w


def out_of_fold(x: Rows, y: np.ndarray, folds: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """The probability of each row by a model fitted, from zero, on the other folds; the model without a fold uses that fold's columns."""
    known, p = ~np.isnan(y), np.zeros(len(y))
    for f in range(FOLDS):
        others = known & (folds != f)
        p[folds == f] = sigmoid(x.take(folds == f).times(logistic(x.only(columns[f]).take(others), y[others])))
    return p


def train_chain(x: Rows, ys: list[np.ndarray], folds: np.ndarray, columns: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Weights of each category; ys holds 0, 1 or nan.  Earlier categories enter as out-of-fold probabilities.

    columns: which word columns the models without each fold, and last the one of all rows, may use.
    """
    weights = []
    columns = columns or [np.ones(x.width, bool)] * (FOLDS + 1)
    for k, y in enumerate(ys):
        known = ~np.isnan(y)
        weights.append(logistic(x.only(columns[FOLDS]).take(known), y[known]))
        if k + 1 < len(ys):
            x = x.with_column(out_of_fold(x, y, folds, columns))
    return weights


def vocabularies(rows: DataFrame, columns: list[str]) -> list[list[str]]:
    """The words of the model without each fold, and last of the one of all rows: for each category those whose counts tell most.

    rows has _words, _fold and the categories' columns; WORDS words for each category and model reach the driver.
    """
    totals = {r["_fold"]: r for r in rows.groupBy("_fold").agg(*[f(c).alias(f"{f.__name__}{c}") for c in columns for f in (F.count, F.sum)]).collect()}
    counts = rows.select(F.explode("_words").alias("w"), "_fold", *columns)
    sums, choices = [], []
    for f in range(FOLDS + 1):
        for k, c in enumerate(columns):
            mine = F.when(F.col("_fold") != f, F.col(c))  # no row is of fold FOLDS
            sums += [F.count(mine).alias(f"n{f}_{k}"), F.sum(mine).alias(f"s{f}_{k}")]
            some = [r for g, r in totals.items() if g != f]
            known, ones = sum(r[f"count{c}"] for r in some), sum(r[f"sum{c}"] or 0.0 for r in some)
            rate = ones / known if known else 0.0
            n = F.col(f"n{f}_{k}")
            z = F.abs(F.col(f"s{f}_{k}") - n * rate) / F.sqrt(n * F.lit(max(rate * (1 - rate), 1e-9)))
            choices.append(F.struct(F.lit(f).alias("f"), F.lit(k).alias("k"), n.alias("n"), z.alias("z")))
    stated = counts.groupBy("w").agg(*sums).select("w", F.inline(F.array(*choices))).filter(F.col("n") >= LEAST)
    order = Window.partitionBy("f", "k").orderBy(F.col("z").desc(), "w")
    out: list[dict] = [{} for _ in range(FOLDS + 1)]
    for r in stated.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= WORDS).orderBy("f", "k", "at").select("f", "w").collect():
        out[r["f"]][r["w"]] = None
    return [list(o) for o in out]


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Chain:
    """categories: name to SQL expression over labels (1, 0 or null), in chain order."""
    names = list(categories)
    y = [F.max(F.expr(e).cast("double")).alias(f"_y{k}") for k, e in enumerate(categories.values())]
    chosen = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(*y)
    # only hashes low enough for the sample and a margin are sorted, so what tasks send doesn't grow with their number
    share = (sample + 10 * math.sqrt(sample) + 100) / max(1, chosen.count())
    if share < 1:
        chosen = chosen.filter(F.xxhash64("_id") <= int(-(2**63) + share * 2**64))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    text = F.coalesce(F.col(text_col), F.lit(""))
    columns = [f"_y{k}" for k in range(len(names))]
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).join(F.broadcast(chosen), "_id")
    rows = rows.groupBy("_id", *columns).agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text")).withColumn("_fold", F.pmod(F.xxhash64("_text"), F.lit(FOLDS)).cast("int"))
    schema = StructType.fromDDL("_words array<string>, _figures array<double>, _fold int, " + ", ".join(f"{c} double" for c in columns))
    arrow = arrow_schema(schema)

    def featurise(batches):
        for b in batches:
            for low in range(0, b.num_rows, 500):
                part = b.slice(low, 500)
                texts = part.column("_text").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([list(words(t)) for t in texts], arrow.field(0).type), pa.array([figures(t) for t in texts], arrow.field(1).type), part.column("_fold"), *[part.column(c) for c in columns]], schema=arrow)

    rows = written(rows.mapInArrow(lean(featurise), schema))
    if rows.isEmpty():
        return Chain(names, {}, [np.concatenate([np.zeros(FIGURES + k), [-30.0]]).astype(np.float32) for k in range(len(names))])
    chosen_words = vocabularies(rows, columns)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for ws in reversed(chosen_words) for w in ws))}
    designed = StructType.fromDDL("c array<int>, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields[1:]))
    designed_arrow = arrow_schema(designed)

    def number(batches):
        for b in batches:
            found = [sorted(vocabulary[w] for w in ws if w in vocabulary) for ws in b.column("_words").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, designed_arrow.field(0).type), *[b.column(f.name) for f in schema.fields[1:]]], schema=designed_arrow)

    data = list(rows.mapInArrow(lean(number), designed).orderBy(*columns, "_fold", F.col("_figures").cast("string"), F.col("c").cast("string")).toLocalIterator())
    row = np.repeat(np.arange(len(data)), [len(r["c"]) for r in data])
    column = np.array([c for r in data for c in r["c"]], np.int64)
    x = Rows(row, column, len(vocabulary), np.array([[*r["_figures"], 1.0] for r in data]))
    ys = [np.array([np.nan if r[c] is None else r[c] for r in data]) for c in columns]
    allowed = [np.isin(np.arange(len(vocabulary)), [vocabulary[w] for w in ws]) for ws in chosen_words]
    weights = train_chain(x, ys, np.array([r["_fold"] for r in data]), allowed)
    n = len(chosen_words[FOLDS])  # the words of the whole model are the first
    return Chain(names, {w: i for w, i in vocabulary.items() if i < n}, [np.concatenate([w[:n], w[len(vocabulary) :]]) for w in weights])


def score(docs: DataFrame, chain: Chain, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns in keep and p_<category> of every row.  Null text: that of an empty text."""
    keep = kept(keep, [f"p_{c}" for c in chain.categories])
    kinds = {f.name: f.dataType for f in docs.schema}
    schema = StructType([StructField(c, kinds[c]) for c in keep] + [StructField(f"p_{c}", DoubleType()) for c in chain.categories])
    arrow, n = arrow_schema(schema), len(keep)

    def run(batches):
        for b in batches:
            for low in range(0, b.num_rows, 1000):
                part = b.slice(low, 1000)
                scores = [chain.score(t.as_py() or "") for t in part.column(n)]
                columns = [part.column(i) for i in range(n)] + [pa.array([s[k] for s in scores], pa.float64()) for k in range(len(chain.categories))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text")).mapInArrow(lean(run), schema)


#: The categories of the table labels, in chain order.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def toxicity(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """The columns in keep, p_low_quality, p_toxic and toxic (whether p_toxic reaches the threshold) of every row."""
    chain = fit(docs, labels, CATEGORIES)
    return score(docs, chain, kept(keep, ["toxic"])).withColumn("toxic", F.col("p_toxic") >= threshold)
