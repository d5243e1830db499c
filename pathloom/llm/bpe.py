"""Byte-level BPE encoding and decoding with a local rank file.

The rank file (lines of base64 token and rank) is read once on the driver and travels to the
workers, which need no file of their own.  Texts over ``LONG`` characters are split first, only
where a match of the splitting pattern must begin whatever stands around it: between a character
that isn't white space and a space or line feed.  Matches longer than ``GIANT`` characters, on which
a quadratic merge would take hours, are merged with a heap; the ids are the same.

Null texts count as empty (no ids).  Text that looks like a special token is ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from pathloom.llm.common import arrow_schema, kept, lean

LONG = 50_000
GIANT = 2_000
_CUT = re.compile(r"[^\s](?=[ \n])")
_RUN = re.compile(rf"\S{{{GIANT},}}|\s{{{GIANT},}}")


class Bpe:
    """Encodes as tiktoken does with the same ranks and pattern, without special tokens."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        import regex
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.names = {rank: str(rank) for rank in self.tokens}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        white = r"\p{White_Space}"
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{white}").replace(r"\s", white).replace(r"\S", rf"[^{white}]"))

    def encode(self, text: str) -> list[int]:
        if len(text) <= LONG:
            return self._part(text)
        ids, at = [], 0
        while at < len(text):
            m = _CUT.search(text, min(at + LONG, len(text)) - 1)
            end = m.end() if m else len(text)
            ids += self._part(text[at:end])
            at = end
        return ids

    def _part(self, text: str) -> list[int]:
        if len(text) < GIANT or not _RUN.search(text):
            return self.encoding.encode_ordinary(text)
        ids = []
        for m in self.pattern.finditer(text):
            piece = m[0].encode()
            rank = self.ranks.get(piece)
            ids += [rank] if rank is not None else self.merge(piece) if len(piece) >= GIANT else self.encoding._encode_single_piece(piece)
        return ids

    def merge(self, piece: bytes) -> list[int]:
        """The merges of one match, least rank first and leftmost among equals, in n log n."""
        n, ranks = len(piece), self.ranks
        after, before, end = [*range(1, n + 1)], [*range(-1, n - 1)], [*range(1, n + 1)]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if not end[i] or j >= n or end[j] != stop:
                continue
            k = after[j]
            end[i], after[i], end[j] = stop, k, 0
            if k < n:
                before[k] = i
                if (r := ranks.get(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def decode(self, ids) -> bytes:
        """The raw bytes; they need not be valid UTF-8 where ids were cut."""
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def _bpe(ranks: bytes, pattern: str) -> Bpe:
    return Bpe(ranks, pattern)


def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """The columns in keep, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 (of the bytes decoded from the ids) and, with_ids, token_ids.

    Null text: no ids.  Repeated rows give repeated results; an empty table gives none; a kept column
    named like a result gives way to it.
    """
    ranks = open(rank_file, "rb").read()
    keep = kept(keep, ["n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * with_ids])
    kinds = {f.name: f.dataType for f in docs.schema}
    schema = StructType([StructField(c, kinds[c]) for c in keep] + [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())] + [StructField("token_ids", ArrayType(IntegerType()))] * with_ids)
    arrow, n_keep = arrow_schema(schema), len(keep)

    def run(batches):
        bpe = _bpe(ranks, pattern)
        name, token = bpe.names.__getitem__, bpe.tokens.__getitem__
        for b in batches:
            for low in range(0, b.num_rows, 1000):
                part = b.slice(low, 1000)
                counts, digests, back, all_ids = [], [], [], []
                for text in part.column(n_keep):
                    ids = bpe.encode(text.as_py() or "")
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(" ".join(map(name, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(b"".join(map(token, ids))).hexdigest())
                    if with_ids:
                        all_ids.append(ids)
                columns = [part.column(i) for i in range(n_keep)] + [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
                if with_ids:
                    columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text")).mapInArrow(lean(run), schema)


def decode(encoded: DataFrame, rank_file: str, pattern: str, ids_col: str = "token_ids", to: str = "decoded") -> DataFrame:
    """encoded with the bytes of its ids in column to (binary).  Null ids: null."""
    from pyspark.sql.functions import pandas_udf

    ranks = open(rank_file, "rb").read()

    @pandas_udf(BinaryType())
    def raw(ids):
        bpe = _bpe(ranks, pattern)
        return ids.map(lambda x: None if x is None else bpe.decode(x))

    raw.__annotations__.clear()
    return encoded.withColumn(to, raw(F.col(ids_col)))
