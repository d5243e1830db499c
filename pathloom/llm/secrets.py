"""Secret scans: candidate spans, then corpus-wide ownership frequency of their values.

Base kinds are ``assign``, ``access`` and ``hex``; ``owned`` is the kind that the method adds.  Values
are hashed, and for each hash the distinct repositories and owners are counted over the whole corpus.
A value that ``WIDE`` owners or more share is a widely copied example; one of fewer owners that looks
random, or that is assigned and isn't a known placeholder, is owner-specific and counts as live.  Short
values can't look random: few characters have few bits whatever their source.  Further random-looking tokens are reported (``owned``)
only if they are owner-specific.

Null texts are empty; a null repository or owner counts as one unknown one.  Repeated rows give
repeated results and add no owner; an empty table gives no rows.  Positions are code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StringType, StructField, StructType

from pathloom.llm.common import arrow_schema, by_text, join_counted, kept, lean, packed, written

#: Owners from which a value is a widely copied example.
WIDE = 3
#: Bits a character from which a value looks random.
ENTROPY = 3.0
#: Words that make up placeholders of assigned values.
PLACEHOLDERS = frozenset("api apikey change changeme default dummy example field hidden here insert key me my none null passwd password placeholder redacted removed required sample secret string test the todo token undefined unknown your".split())
KINDS = ("assign", "access", "hex", "owned")

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_OTHER = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
_NEEDLES = ("passw", "secret", "token", "api")
_CANDIDATE = "array<struct<kind:int,start:int,end:int,value_start:int,value_end:int,hash:bigint,random:boolean>>"


def entropy(s: str) -> float:
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in (s.count(c) for c in set(s))) if n else 0.0


def placeholder(value: str) -> bool:
    """One repeated character, or nothing but PLACEHOLDERS and separators."""
    return len(set(value)) == 1 or all(w in PLACEHOLDERS for w in re.split(r"[+/_.=-]+", value.lower()) if w)


def secretive(kind: int, value: str) -> bool:
    """Whether a value counts as live if it is owner-specific."""
    return entropy(value) >= ENTROPY or (KINDS[kind] == "assign" and not placeholder(value))


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(kind, start, end, value start, value end) of the base kinds, by start, then kind."""
    out = []
    lower = text.lower()
    if any(x in lower for x in _NEEDLES):
        out += [(0, m.start(), m.end(), m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(1, *m.span(), *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(2, *m.span(), *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], x[0]))


def other_spans(text: str, base: list[tuple]) -> list[tuple[int, int, int, int, int]]:
    """Tokens of mixed characters that look random and meet no base span."""
    out = []
    for m in _OTHER.finditer(text):
        s = m[0]
        if any(c.isdigit() for c in s) and s.upper() != s and s.lower() != s and entropy(s) >= ENTROPY + 0.5 and not any(a < m.end() and m.start() < b for _, a, b, _, _ in base):
            out.append((3, *m.span(), *m.span()))
    return out


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def scan(docs: DataFrame, keep: tuple[str, ...], repo: Column, owner: Column, text_col: str) -> DataFrame:
    """Keys of the text, kept columns (_k0 ...), _repo, _owner, counts, base_sha256 and _found, the candidates."""
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.coalesce(repo.cast("string"), F.lit("")).alias("_repo"), F.coalesce(owner.cast("string"), F.lit("")).alias("_owner"), F.col(text_col).alias("_source"))
    rows = by_text(rows, *[f"_k{i}" for i in range(len(keep))], "_repo", "_owner", text_col="_source")
    passed = [f for f in rows.schema if f.name != "_text"]
    schema = StructType(passed + [StructField("n_assign", LongType()), StructField("n_access", LongType()), StructField("n_hex", LongType()), StructField("base_sha256", StringType())]).add("_found", DataType.fromDDL(_CANDIDATE))
    arrow, names = arrow_schema(schema), [f.name for f in passed]

    def run(batches):
        for b in batches:
            for low in range(0, b.num_rows, 1000):
                part, counts, digests, found = b.slice(low, 1000), ([], [], []), [], []
                for t in part.column("_text"):
                    text = t.as_py()
                    base = base_spans(text)
                    for k in range(3):
                        counts[k].append(sum(x[0] == k for x in base))
                    digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{z}" for k, a, z, _, _ in base).encode()).hexdigest())
                    found.append([dict(kind=k, start=a, end=z, value_start=v, value_end=w, hash=_hash(text[v:w]), random=secretive(k, text[v:w])) for k, a, z, v, w in base + other_spans(text, base)])
                columns = [part.column(c) for c in names] + [pa.array(c, pa.int64()) for c in counts] + [pa.array(digests, pa.string()), pa.array(found, arrow.field("_found").type)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(lean(run), schema)


def labelled(scanned: DataFrame) -> DataFrame:
    """For each text with candidates (_t, _u): _spans, the base and owner-specific ones with their numbers of repositories and owners and whether they look live.

    Values that very many texts hold are few, and meet their counts by broadcast, so no task gathers one.
    """
    one = scanned.filter(F.size("_found") > 0).select("_t", "_u", "_repo", "_owner", F.explode("_found").alias("c"))
    spans = written(one.select("_t", "_u", "c", F.col("c.hash").alias("hash")).distinct())
    owners = one.select(F.col("c.hash").alias("hash"), "_repo", "_owner").distinct().groupBy("hash").agg(F.countDistinct("_repo").alias("repos"), F.countDistinct("_owner").alias("owners"))
    owners = written(owners.join(spans.groupBy("hash").agg(F.count("*").alias("n")), "hash"))
    live = (F.col("owners") < WIDE) & F.col("c.random")
    spans = join_counted(spans, owners, "hash").withColumn("live", live).filter((F.col("c.kind") < 3) | F.col("live"))
    return spans.groupBy("_t", "_u").agg(F.array_sort(F.collect_list(F.struct(F.col("c.start").alias("start"), F.col("c.kind").alias("kind"), F.col("c.end").alias("end"), F.col("c.value_start").alias("value_start"), F.col("c.value_end").alias("value_end"), "repos", "owners", "live"))).alias("_spans"))


def find_secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), repo: Column | None = None, owner: Column | None = None, text_col: str = "text") -> DataFrame:
    """The columns in keep, n_assign, n_access, n_hex, base_sha256, spans (all, as kind:start:end) and n_live, n_example of every row.

    repo and owner default to the column source.  A kept column named like a result gives way to it.
    """
    keep = kept(keep, ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example"])
    repo, owner = F.col("source") if repo is None else repo, F.col("source") if owner is None else owner
    scanned = written(scan(docs, keep, repo, owner, text_col))
    kinds = F.array(*map(F.lit, KINDS))
    none = scanned.filter(F.size("_found") == 0).withColumn("_spans", F.lit(None))
    some = scanned.filter(F.size("_found") > 0).join(labelled(scanned), ["_t", "_u"], "left")
    spans = F.coalesce(F.array_join(F.transform("_spans", lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit(""))

    def number(test) -> Column:
        return F.coalesce(F.size(F.filter("_spans", test)), F.lit(0)).cast("long")

    done = none.withColumn("_spans", F.lit(None).cast(some.schema["_spans"].dataType)).unionByName(some)
    return done.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), number(lambda s: s["live"]).alias("n_live"), number(lambda s: s["owners"] >= WIDE).alias("n_example"))


def redact(docs: DataFrame, repo: Column | None = None, owner: Column | None = None, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with the values of live secrets replaced by mark; widely copied examples stay.  Columns and rows are those of docs."""
    repo, owner = F.col("source") if repo is None else repo, F.col("source") if owner is None else owner
    scanned = scan(docs, (), repo, owner, text_col).filter(F.size("_found") > 0)
    live = labelled(written(scanned)).select("_t", "_u", F.filter("_spans", lambda s: s["live"]).alias("_spans")).filter(F.size("_spans") > 0)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(packed(docs).alias("_row"), F.xxhash64(text).alias("_t"), F.hash(text).alias("_u")).join(live, ["_t", "_u"], "left")

    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def cut(texts, spans):
        out = []
        for text, found in zip(texts, spans, strict=True):
            at, parts = 0, []
            for a, b in sorted({(s["value_start"], s["value_end"]) for s in found}):
                if b > at:
                    parts += [text[at : max(a, at)], mark]
                    at = b
            out.append("".join(parts) + text[at:])
        import pandas as pd

        return pd.Series(out, dtype=object)

    clean = rows.filter("_spans IS NULL").select("_row")
    found = rows.filter("_spans IS NOT NULL").select(F.col("_row").withField(f"`{text_col}`", cut(F.col("_row").getField(text_col), F.col("_spans"))).alias("_row"))
    return clean.unionByName(found).select("_row.*")
