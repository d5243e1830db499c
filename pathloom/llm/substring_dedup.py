"""Substring deduplication with suffix automata.

``SpanRemover`` is the plain form: automata of reference shards, whose size is checked, are
broadcast and documents stream past them.

``substring_dedup`` measures a corpus against itself.  Broadcasting automata of the whole corpus to
every task would grow with the square of the data, so the reference is dealt to shards by content
and only texts that can match a shard are streamed past its automaton:

1. Of each window of ``window`` words the anchor is its leftmost least hash of ``ANCHOR`` words.
   Successive windows with one anchor occurrence form a region.  Equal windows have equal anchors.
2. Anchors that stand once in the corpus can't be in a repeated window.  A region whose exact words
   stand twice is wholly repeated (copies enter the counts before any shuffle).
3. The remaining regions of repeated anchors go to the shard of their anchor, one copy of each
   distinct region with its number of occurrences.  There they form a suffix automaton, and the
   matching statistics of each single region tell which of its windows occur elsewhere.
   An anchor with more than ``SHARD`` distinct regions is dealt, window by window, to more shards by content.

Results are per text: equal texts have equal results, so rows are joined on a key of the text and
neither unique nor non-null ids are needed.  Null texts count as empty; a text of fewer than
``window`` words loses nothing; repeated rows count as occurrences of their own.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm import wordhash as wh
from pathloom.llm.automaton import SuffixAutomaton
from pathloom.llm.common import arrow_schema, by_text, kept, partitions, written

#: Words of an anchor.
ANCHOR = 8
#: Distinct regions of one anchor, or windows of an anchor with more, that share a shard.
SHARD = 500
#: Regions that are gathered into one automaton, as far as whole anchors allow.
GATHER = 500


def regions(data: np.ndarray, offsets: np.ndarray, window: int):
    """Row, first window (as word of the row), number of windows, anchor hash and content hash of every region."""
    h, row, _ = wh.words(data, offsets)
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), h, row
    k = min(ANCHOR, window)
    grams = wh.grams(h, k)
    view = np.lib.stride_tricks.sliding_window_view(grams, window - k + 1)
    best = np.concatenate([view[a : a + 65536].argmin(1) for a in range(0, len(view), 65536)]) + np.arange(len(view))
    starts = np.flatnonzero(row[: len(view)] == row[window - 1 :])
    if not len(starts):
        return none, none, none, none.view(np.uint64), none.view(np.uint64), h, row
    anchor = best[starts]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    a, last = starts[new], starts[np.concatenate([new[1:], [len(starts)]]) - 1]
    end = last + window
    content = np.empty(len(a), np.uint64)
    for low in range(0, len(a), 1 << 18):  # powers stay short in long texts
        s = slice(low, low + (1 << 18))
        base, part = a[s][0], h[a[s][0] : end[s].max()]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * wh.powers(wh._GRAM, len(part)), out=sums[1:])
        content[s] = (sums[end[s] - base] - sums[a[s] - base]) * wh.powers(wh._GRAM_INVERSE, len(part))[a[s] - base] + (end[s] - a[s]).astype(np.uint64)
    rows = row[a]
    first = np.searchsorted(row, rows)
    return rows, a - first, last - a + 1, grams[anchor[new]], wh.mix(content), h, row


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _scan(window: int, schema: pa.Schema):
    """Texts to distinct (text, anchor, content) with the number of its regions in the text."""

    def run(batches):
        for b in batches:
            t, u = b.column("_t").to_numpy(), b.column("_u").to_numpy()
            for row, data, offsets in wh.chunks(b.column("_text")):
                r, _, _, anchor, content, _, _ = regions(data, offsets, window)
                if not len(r):
                    continue
                order = np.lexsort((content, anchor, r))
                r, anchor, content = r[order], anchor[order], content[order]
                new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])]))
                n = np.diff(np.concatenate([new, [len(r)]]))
                for low in range(0, len(new), 100_000):
                    k = new[low : low + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(t[row + r[k]]), pa.array(u[row + r[k]]), pa.array(_signed(anchor[k])), pa.array(_signed(content[k])), pa.array(n[low : low + 100_000])], schema=schema)

    return run


def _keys(anchor: np.ndarray, content: np.ndarray) -> np.ndarray:
    """One number for each pair of anchor and content."""
    return wh.mix(anchor.astype(np.int64).view(np.uint64) * np.uint64(0xD1342543DE82EF95) + content.astype(np.int64).view(np.uint64))


def _lists(column) -> tuple[np.ndarray, pa.StructArray]:
    """Offsets and entries of a column of lists of structs; null lists are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.nan_to_num(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
    return np.concatenate([[0], np.cumsum(lengths)]), column.flatten()


def _cut(window: int, schema: pa.Schema):
    """Texts with the regions that they stand for to the words of those regions, by shard."""

    def run(batches):
        for whole in batches:
            whole = whole.filter(whole.column("wanted").is_valid())
            for low in range(0, whole.num_rows, 100):
                b, out = whole.slice(low, 100), []
                t, u, texts = b.column("_t").to_pylist(), b.column("_u").to_pylist(), b.column("_text")
                at, wanted = _lists(b.column("wanted"))
                keys = _keys(wanted.field("anchor").to_numpy(), wanted.field("content").to_numpy())
                counts, distinct = wanted.field("n").to_numpy(), wanted.field("distinct").to_numpy()
                for i in range(b.num_rows):
                    data, offsets = wh.strings(texts.slice(i, 1))
                    _, first, n, anchor, content, h, _ = regions(data, offsets, window)
                    words = data.tobytes().split()
                    _, asked, have = np.intersect1d(keys[at[i] : at[i + 1]], _keys(_signed(anchor), _signed(content)), return_indices=True)
                    for x, y in zip((asked + at[i]).tolist(), have.tolist(), strict=True):
                        a, m, k, c, occurs = int(first[y]), int(n[y]), int(_signed(anchor)[y]), int(_signed(content)[y]), int(counts[x])
                        shards = 1 if distinct[x] <= SHARD else -(-int(distinct[x]) * (window - ANCHOR) // SHARD)
                        if shards == 1:
                            out.append((k, 0, c, 0, occurs, t[i], u[i], b" ".join(words[a : a + m + window - 1]).decode()))
                        else:
                            each = wh.grams(h[a : a + m + window - 1], window) % np.uint64(shards)
                            out += [(k, s, c, j, occurs, t[i], u[i], b" ".join(words[a + j : a + j + window]).decode()) for j, s in enumerate(each.tolist())]
                for start in range(0, len(out), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out[start : start + 5000], strict=True), schema, strict=True)], schema=schema)

    return run


def repeated(pieces: dict, window: int) -> list[tuple]:
    """pieces: (content, offset) -> (occurrences, owner, words).  The (owner, content, window offsets) of single pieces that are repeated."""
    automaton, out = SuffixAutomaton(), []
    for n, _, words in pieces.values():
        automaton.add(words, n)
    automaton.count()
    for (content, offset), (n, owner, words) in pieces.items():
        if n == 1:
            ends = [end - window + offset for end, count in automaton.matches(words, window) if count > 1]
            if ends:
                out.append((owner, content, ends))
    return out


def _match(window: int, schema: pa.Schema):
    """Pieces, sorted by anchor and shard, to the repeated windows of each single region."""

    def run(batches):
        gathered: dict = {}
        ids: dict[str, int] = {}
        at = None

        def done():
            found = defaultdict(list)
            for (t, u), (anchor, content), ends in repeated(gathered, window):
                found[t, u, anchor, content].extend(ends)
            gathered.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[i] for k in found], schema.field(i).type) for i in range(4)] + [pa.array(list(found.values()), schema.field(4).type)], schema=schema)

        for b in batches:
            rows = zip(*(b.column(f).to_pylist() for f in ("anchor", "shard", "content", "offset", "n", "_t", "_u", "words")), strict=True)
            for anchor, shard, content, offset, n, t, u, words in rows:
                if at != (anchor, shard) and len(gathered) >= GATHER:
                    yield done()
                at = anchor, shard
                # several anchors may share an automaton: equal windows have equal anchors, so no count changes
                gathered[(anchor, content), offset] = n, (t, u), [ids.setdefault(w, len(ids)) for w in words.split(" ")]
        if gathered:
            yield done()

    return run


def spans(docs: DataFrame, window: int, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The keyed texts, and for each text with repeated windows (_t, _u) its regions: anchor, content and the repeated windows in it (null: all)."""
    spark = docs.sparkSession
    texts = by_text(docs, text_col=text_col)
    found = texts.mapInArrow(_scan(window, pa.schema([("_t", pa.int64()), ("_u", pa.int32()), ("anchor", pa.int64()), ("content", pa.int64()), ("n", pa.int64())])), "_t long, _u int, anchor long, content long, n long")
    stats = found.groupBy("anchor").agg(F.sum("n").alias("total"), F.min("content").alias("low"), F.max("content").alias("high")).filter("total > 1").select("anchor", (F.col("low") != F.col("high")).alias("mixed"))
    shared = written(found.join(stats, "anchor"))
    mixed = shared.filter("mixed").groupBy("anchor", "content").agg(F.sum("n").alias("n"), F.min(F.struct("_t", "_u")).alias("owner"))
    mixed = written(mixed)
    sizes = mixed.groupBy("anchor").agg(F.count("*").alias("distinct"))
    asked = mixed.join(sizes, "anchor").groupBy(F.col("owner._t").alias("_t"), F.col("owner._u").alias("_u")).agg(F.collect_list(F.struct("anchor", "content", "n", "distinct")).alias("wanted"))
    cut_schema = "anchor long, shard long, content long, offset int, n long, _t long, _u int, words string"
    pieces = texts.join(asked, ["_t", "_u"], "left").mapInArrow(_cut(window, _arrow(spark, cut_schema)), cut_schema)
    pieces = pieces.repartition(partitions(spark), "anchor", "shard").sortWithinPartitions("anchor", "shard")
    match_schema = "_t long, _u int, anchor long, content long, windows array<int>"
    single = pieces.mapInArrow(_match(window, _arrow(spark, match_schema)), match_schema)
    whole = shared.filter("not mixed").select("_t", "_u", "anchor", "content").unionByName(
        shared.filter("mixed").join(mixed.filter("n > 1").select("anchor", "content"), ["anchor", "content"]).select("_t", "_u", "anchor", "content")
    ).withColumn("windows", F.lit(None).cast("array<int>"))
    return texts, whole.unionByName(single)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.types import StructType

    return arrow_schema(StructType.fromDDL(ddl))


def covered(data: np.ndarray, offsets: np.ndarray, window: int, keys: np.ndarray, windows: list) -> np.ndarray:
    """Which words of one text repeated windows cover; keys and windows (None: all) tell its regions with such."""
    _, first, n, anchor, content, h, _ = regions(data, offsets, window)
    gone = np.zeros(len(h) + 1, np.int64)
    own = _keys(_signed(anchor), _signed(content))
    partly = [k for k, w in enumerate(windows) if w is not None]
    full = np.isin(own, np.delete(keys, partly))
    np.add.at(gone, first[full], 1)
    np.add.at(gone, (first + n)[full] + window - 1, -1)
    if partly:
        order = np.argsort(own, kind="stable")
        low, high = (np.searchsorted(own[order], keys[partly], side) for side in ("left", "right"))
        for k, a, z in zip(partly, low.tolist(), high.tolist(), strict=True):
            start = (first[order[a:z], None] + np.unique(windows[k])).ravel()
            np.add.at(gone, start, 1)
            np.add.at(gone, start + window, -1)
    return np.cumsum(gone)[:-1] > 0


def _finish(window: int, keep: list[str], with_text: bool, schema: pa.Schema):
    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, 100):
                b = whole.slice(low, 100)
                at, marks = _lists(b.column("marks"))
                keys, windows = _keys(marks.field("anchor").to_numpy(), marks.field("content").to_numpy()), marks.field("windows")
                n_words, n_removed, digest, kept = [], [], [], []
                texts = b.column("_text")
                for i in range(b.num_rows):
                    data, offsets = wh.strings(texts.slice(i, 1))
                    words, removed = data.tobytes().split(), 0
                    n_words.append(len(words))
                    if at[i] < at[i + 1]:
                        mine = slice(at[i], at[i + 1])
                        gone = covered(data, offsets, window, keys[mine], windows[mine].to_pylist())
                        removed = int(gone.sum())
                        words = [words[k] for k in np.flatnonzero(~gone).tolist()]
                    n_removed.append(removed)
                    text = b" ".join(words)
                    digest.append(hashlib.sha256(text).hexdigest())
                    if with_text:
                        kept.append(text.decode())
                columns = [b.column(c) for c in keep] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
                if with_text:
                    columns.append(pa.array(kept, pa.string()))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def substring_dedup(docs: DataFrame, window: int = 35, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_text: bool = True) -> DataFrame:
    """The columns in keep, n_words, n_removed, kept_sha256 and (with_text) kept_text of every row of docs.

    Every word covered by a window of ``window`` words whose word sequence also starts elsewhere in
    the corpus is removed; windows are judged on the input.  Kept words are joined by one space.
    Nulls: a null text is empty (0 words).  Columns named like internal ones (_text, _t, _u) may be in docs;
    a kept column named like a result gives way to it.  An empty table gives no rows.
    """
    keep = kept(keep, ["n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])
    texts, found = spans(docs, window, text_col)
    marks = found.groupBy("_t", "_u").agg(F.collect_set(F.struct("anchor", "content", "windows")).alias("marks"))
    keyed = by_text(docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_source")), *[f"_k{i}" for i in range(len(keep))], text_col="_source")
    joined = keyed.join(marks, ["_t", "_u"], "left").select(*[F.col(f"_k{i}") for i in range(len(keep))], "_text", "marks")
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    kinds = {f.name: f.dataType for f in docs.schema}
    schema = StructType([StructField(c, kinds[c]) for c in keep] + [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())] + [StructField("kept_text", StringType())] * with_text)
    return joined.mapInArrow(_finish(window, [f"_k{i}" for i in range(len(keep))], with_text, arrow_schema(schema)), schema)


class SpanRemover:
    """Documents against a bounded set of reference texts: broadcast automata, one per shard.

    The references are read to the driver, so they must be few: more than ``limit`` words raises ValueError.
    """

    def __init__(self, references: DataFrame, window: int = 35, text_col: str = "text", shard_words: int = 100_000, limit: int = 500_000) -> None:
        self.window, shards, size, total = window, [SuffixAutomaton()], 0, 0
        for r in references.select(text_col).toLocalIterator():
            words = (r[0] or "").encode().split()
            total += len(words)
            if total > limit:
                raise ValueError(f"the references have more than {limit} words; use substring_dedup")
            if size and size + len(words) > shard_words:
                shards.append(SuffixAutomaton())
                size = 0
            shards[-1].add(words)
            size += len(words)
        for s in shards:
            s.count()
        self.shards = references.sparkSession.sparkContext.broadcast(shards)

    def apply(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs with n_removed and kept_text: words in runs of window or more that occur in a reference are gone."""
        from pyspark.sql.functions import pandas_udf

        shards, window = self.shards, self.window

        @pandas_udf("n_removed long, kept_text string")
        def cut(texts):
            import pandas as pd

            out = []
            for text in texts:
                words = (text or "").encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                for s in shards.value:
                    for end, _ in s.matches(words, window):
                        gone[end - window] += 1
                        gone[end] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                out.append((int(gone.sum()), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()))
            return pd.DataFrame(out, columns=["n_removed", "kept_text"])

        return docs.withColumn("_cut", cut(F.col(text_col))).select(*docs.columns, "_cut.n_removed", "_cut.kept_text")
