"""Exact Jaccard self-join on word shingles with adaptive multi-match prefixes, and its components.

Each text is the set of its distinct shingles of ``SHINGLE`` words (A-Z lower-cased).  All shingles have
one global order: rare before frequent, by a count of all shingles of the corpus in ``CELLS`` cells, of
which the mean, what chance puts into any cell, is taken off.
If two sets are similar enough, their prefixes of n - alpha + l shingles share at least l of them.
Each text takes the l (1 to ``MOST``) of least estimated cost: what its prefix's shingles are expected
to meet, and what must then be verified.  Pairs need as many common prefix shingles as the smaller l
asks for before their whole sets are compared.

Prefix shingles are dealt by value.  Where few texts of similar size have one, it is counted for each pair of
them; pairs with as many as the smaller l asks for (one, if either has a short prefix), and all texts of similar size
with a shingle that more texts have, form families: a shingle that two long texts share by chance connects nothing.  A family of
bounded size is joined in one task.  In a larger one texts are dealt to blocks of bounded size, like
texts to the same ones (by least hash), and a text is sent to a pair of blocks only if it has as many prefix shingles in
common with one of the other block, or if a shingle of many texts, by their sizes, lets it be similar to one there.  So the cost
goes with the candidates, not with the square of the family.  Within a pair of blocks a pair of texts needs as
many common prefix shingles as the smaller l, then every such pair is verified, once; pairs are not
written out: each text's number of links leaves, and a spanning set of the links, of which the
components are made.

Equal sets (copies) are one vertex throughout; sets that are not equal never are: where two have one
64-bit hash, a second one tells them apart.  Null and empty texts have no shingle and no link; texts
of fewer than ``SHINGLE`` words are one shingle.  Repeated rows and ids are joined like other copies.  An
empty table gives no rows; a kept column named like a result gives way to it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pathloom.llm import wordhash as wh
from pathloom.llm.common import arrow_schema, discard, join_counted, kept, lean, partitions, written
from pathloom.llm.graph import components

SHINGLE = 5
#: Similarity: 100 * intersection >= PERCENT * union.
PERCENT = 75
CELL_BITS, SLICES = 22, 64
CELLS = 1 << CELL_BITS
MOST = 4
#: Cost of a verification in units of one common prefix shingle.
VERIFY = 8.0
#: Estimated texts from which a prefix shingle is dealt to several tasks.
SALT = 20_000
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1 << 20
#: Texts of similar size with a common prefix shingle up to which it is counted for each pair of them.
PAIRS = 8
#: Prefix shingles from which a text asks for l common ones before it is sent to another; a shorter one, which costs little, asks for one.
COUNTED = 32
#: Bits of the filter of the texts that may be similar to others, at most, and for each of them.
FILTER_BITS, BITS_A_TEXT = 1 << 27, 16
#: Bits of a vertex's number (tests lower them, so that sets collide).
VERTEX_BITS = 64
#: Vertices that a task remembers so as not to send copies; connected ones that it keeps before it sends them.
SEEN, CONNECTED = 200_000, 1_000_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray):
    """(row, sorted distinct shingle hashes) of every row that has words."""
    h, row, _ = wh.words(data, offsets, lower=True)
    if not len(h):
        return
    grams = wh.grams(h, SHINGLE)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    last = np.concatenate([first[1:], [len(row)]])
    for a, z in zip(first.tolist(), last.tolist(), strict=True):
        s = np.unique(grams[a : z - SHINGLE + 1]) if z - a >= SHINGLE else wh.grams(h[a:z], z - a)
        yield int(row[a]), s


class Vertices:
    """Numbers for sets of shingles; renamed holds those of the few sets whose first hash another set has too."""

    def __init__(self, renamed: dict[tuple[int, int], int] | None = None) -> None:
        self.bits, self.renamed = VERTEX_BITS, renamed or {}
        self.shared = {v for v, _ in self.renamed}

    def hashes(self, s: np.ndarray) -> tuple[int, int]:
        """Two independent hashes of a set; the first is the vertex unless it is renamed."""
        n, out = np.uint64(len(s)), []
        for salt in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D):
            out.append(int(wh.mix(np.array([wh.mix(s ^ np.uint64(salt)).sum() + n], np.uint64)).view(np.int64)[0]))
        return out[0] >> (64 - self.bits), out[1]

    def number(self, s: np.ndarray) -> int:
        if not self.shared:
            return int(wh.mix(np.array([wh.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0]) >> (64 - self.bits)
        v, u = self.hashes(s)
        return self.renamed.get((v, u), v) if v in self.shared else v


def alpha(n: int) -> int:
    """Least intersection with any similar set."""
    return -(-PERCENT * n // 100)


def alpha_smaller(n: int) -> int:
    """Least intersection with any similar set that isn't smaller."""
    return -(-2 * PERCENT * n // (100 + PERCENT))


def ordered(s: np.ndarray, ranks: np.ndarray, upto: int) -> np.ndarray:
    """The first upto shingles in the global order, as numbers that sort in it (rank, then 54 bits of the hash)."""
    keys = (ranks[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(54)) | (s >> np.uint64(10))
    return np.sort(np.partition(keys, upto - 1)[:upto] if upto < len(keys) else keys)


def frequency(keys: np.ndarray) -> np.ndarray:
    """Estimated occurrences of ordered shingles beyond those that chance puts into a cell."""
    return np.exp2((keys >> np.uint64(54)).astype(float) / 16) - 1


def shares(keys: np.ndarray, most: int) -> np.ndarray:
    """To how many tasks the texts with each ordered shingle are dealt, by at most so many texts."""
    return np.ceil(np.maximum(frequency(keys), 1.0) / most).astype(np.int64)


def prefix(s: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Ordered prefix, its l, and how many of it are in the prefix for sets that aren't smaller."""
    n = len(s)
    least = alpha(n)
    most = min(MOST, least)
    keys = ordered(s, ranks, n - least + most)
    meets = np.cumsum(np.maximum(frequency(keys), 1.0))
    l, cost = 1, np.inf
    for k in range(1, most + 1):
        c = meets[n - least + k - 1] * (1 + VERIFY / (k * k))
        if c < cost * 0.9:  # a longer prefix must be worth its postings
            l, cost = k, c
    return keys[: n - least + l], l, n - alpha_smaller(n) + l


def count_cells(docs: DataFrame) -> np.ndarray:
    """Ranks (16 steps an octave) of the cells' shingle counts over all texts, less the mean count."""
    size = CELLS // SLICES
    schema = "slice int, cells binary"
    arrow = pa.schema([("slice", pa.int32()), ("cells", pa.binary())])

    def count(batches):
        cells = np.zeros(CELLS, np.uint32)
        for b in batches:
            for _, data, offsets in wh.chunks(b.column(0)):
                parts = [s for _, s in shingle_sets(data, offsets)]
                if parts:
                    cells += np.bincount((np.concatenate(parts) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=CELLS).astype(np.uint32)
        for k in range(SLICES):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(cells[k * size : (k + 1) * size].tobytes(), 1)], pa.binary())], schema=arrow)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(cells), np.uint32)
                sums[k] = sums[k] + part if k in sums else part.astype(np.uint64)
        for k, cells in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(cells.tobytes(), 1)], pa.binary())], schema=arrow)

    counts = np.zeros(CELLS, np.uint64)
    for r in docs.select("_text").mapInArrow(lean(count), schema).repartition(min(SLICES, partitions(docs.sparkSession)), "slice").mapInArrow(lean(add), schema).collect():
        counts[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(zlib.decompress(r["cells"]), np.uint64)
    return np.round(16 * np.log2(1.0 + np.maximum(counts - counts.mean(), 0.0))).astype(np.uint16)


def _describe(keep: int, arrow: pa.Schema, vertices: Vertices):
    """Rows to kept columns, n_shingles, and of its set (null without shingles) _v, a second hash _u and the least hash _m of its shingles."""

    def run(batches):
        for b in batches:
            sizes, found = np.zeros(b.num_rows, np.int64), np.zeros((3, b.num_rows), np.int64)
            for low, data, offsets in wh.chunks(b.column(keep)):
                for r, s in shingle_sets(data, offsets):
                    v, u = vertices.hashes(s)
                    sizes[low + r], found[:, low + r] = len(s), (v, u, int(s[0]) >> 1)
            columns = [b.column(i).cast(arrow.field(i).type) for i in range(keep)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes), *[pa.array(x, mask=sizes == 0) for x in found]], schema=arrow)

    return run


def apart(described: DataFrame) -> tuple[DataFrame, DataFrame, Vertices]:
    """described with a number _v of its own for each set; a row (v, n, copies, m) for each; how to number sets.

    Sets with one first hash are counted; of some 10^11 different sets, a few hundred have a first hash in common.
    """
    sets = described.filter("_v IS NOT NULL").groupBy("_v").agg(F.max("n_shingles").alias("n"), F.count("*").alias("copies"), F.min("_m").alias("m"), F.min("_u").alias("u"), (F.min("_u") < F.max("_u")).alias("mixed"))
    sets = written(sets)
    mixed = sets.filter("mixed").select("_v", F.col("u").alias("first"))
    if mixed.isEmpty():
        return described, sets.select(F.col("_v").alias("v"), "n", "copies", "m"), Vertices()
    others = described.join(F.broadcast(mixed), "_v").filter("_u <> first").select("_v", "_u").distinct().withColumn("_new", F.xxhash64("_v", "_u"))
    renamed = written(others)
    described = described.join(F.broadcast(renamed), ["_v", "_u"], "left").withColumn("_v", F.coalesce("_new", "_v")).drop("_new")
    sets = described.filter("_v IS NOT NULL").groupBy(F.col("_v").alias("v")).agg(F.max("n_shingles").alias("n"), F.count("*").alias("copies"), F.min("_m").alias("m"))
    return written(described), written(sets), Vertices({(r["_v"], r["_u"]): r["_new"] for r in renamed.toLocalIterator()})


def _postings(ranks, vertices: Vertices):
    """Texts to (key, salt, n, v, l): a row for each prefix shingle of each vertex new to the task.

    l, how many common ones the vertex needs, is negative where the shingle isn't in the prefix for sets that aren't smaller.
    Shingles of very many texts are dealt by size class (each text to its own and the next, so that
    texts of similar sizes meet in one) and, within it, by vertex.
    """
    arrow = pa.schema([("key", pa.int64()), ("salt", pa.int32()), ("n", pa.int32()), ("v", pa.int64()), ("l", pa.int8())])

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            for _, data, offsets in wh.chunks(b.column(0)):
                keys, numbers, sizes, needs, lengths = [], [], [], [], []
                for _, s in shingle_sets(data, offsets):
                    v = vertices.number(s)
                    if v in seen:
                        continue
                    if len(seen) < SEEN:
                        seen.add(v)
                    k, l, n_small = prefix(s, ranks.value)
                    keys.append(k)
                    numbers.append(v)
                    sizes.append(len(s))
                    lengths.append(len(k))
                    need = l if len(k) >= COUNTED else 1
                    needs.append(np.where(np.arange(len(k)) < n_small, need, -need).astype(np.int8))
                if not keys:
                    continue
                k, v, n, l = np.concatenate(keys), np.repeat(np.array(numbers, np.int64), lengths), np.repeat(np.array(sizes, np.int64), lengths), np.concatenate(needs)
                parts = shares(k, SALT)
                many = parts > 1
                salt = np.where(many, 1 + size_class(n) * parts + v % parts, 0)
                again = np.flatnonzero(many)
                at = np.concatenate([np.arange(len(k)), again])
                salt = np.concatenate([salt, (salt + parts)[again]])
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)[at]), pa.array(salt.astype(np.int32)), pa.array(n[at].astype(np.int32)), pa.array(v[at]), pa.array(l[at])], schema=arrow)

    return run


def size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / np.log(100 / PERCENT) + 1e-9).astype(np.int64)


class Sets:
    """Disjoint sets of numbers; the least stands for its set."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def find(self, x: int) -> int:
        above, root = self.above, x
        while (y := above.get(root, root)) != root:
            root = y
        while x != root:
            above[x], x = root, above[x]
        return root

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.above[max(x, y)] = min(x, y)


def runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run, and the run of each row; new: whether a row begins one."""
    start = np.flatnonzero(new)
    return start, np.append(start[1:], len(new)), np.cumsum(new) - 1


def pairs(run: np.ndarray, short: np.ndarray, n: np.ndarray, v: np.ndarray, l: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows x and y, and how many common shingles they need, of each pair of different vertices of similar size in a short run.

    x is the smaller one, by n and v, and has the shingle in its prefix for sets that aren't smaller (l > 0).
    """
    rows, found = np.flatnonzero(short[run]), []
    for step in range(1, len(rows)):
        x, y = rows[:-step], rows[step:]
        some = run[x] == run[y]
        if not some.any():
            break
        x, y = x[some], y[some]
        turned = (n[x] > n[y]) | ((n[x] == n[y]) & (v[x] > v[y]))
        x, y = np.where(turned, y, x), np.where(turned, x, y)
        some = (l[x] > 0) & (v[x] != v[y]) & (100 * n[x] >= PERCENT * n[y])
        found.append((x[some], y[some]))
    x, y = (np.concatenate([np.zeros(0, np.int64), *f]) for f in (zip(*found, strict=True) if found else ((), ())))
    return x, y, np.minimum(np.abs(l[x]), np.abs(l[y]))


def _meetings():
    """Postings sorted by key, salt, n and v to (a, b, kind, n).

    A run of vertices by size is cut where the next is too large for any pair across; what no set has in
    its prefix for sets that aren't smaller connects nothing.  A short run gives its pairs: a and b, each time n, have that many
    prefix shingles in common, and kind is how many they need.  A longer one gives (kind 0) each of its vertices
    with the least of those that it is connected to in this task.  For salted keys that is decided over
    all tasks: the first vertex b of each run is given with a number a of the key and size class, and as kind whether
    the run has such a set (-1); if it hasn't (-2), so are its other vertices.
    """
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("kind", pa.int8()), ("n", pa.int32())])

    def rows(a, b, kind) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(kind, pa.int8()), pa.array(np.ones(len(a), np.int32))], schema=arrow)

    def meet(new, key, salt, n, v, l, sets):
        """Of whole runs."""
        start, end, run = runs(new)
        short = (end - start <= PAIRS) & (salt[start] == 0)
        x, y, need = pairs(run, short, n, v, l)
        if len(x):
            yield rows(v[x], v[y], need)
        hot = []
        for a, z in zip(start[~short].tolist(), end[~short].tolist(), strict=True):
            members, small = v[a:z].tolist(), bool((l[a:z] > 0).any())
            if small:
                for other in members[1:]:
                    sets.join(other, members[0])
            if salt[a]:
                number = (int(salt[a]) - 1) // int(shares(key[a : a + 1].view(np.uint64), SALT)[0])
                class_ = int(wh.mix(key[a : a + 1].view(np.uint64) + np.uint64(number)).view(np.int64)[0])
                hot.extend((class_, x, -1 if small else -2) for x in (members[:1] if small else members))
        if hot:
            yield rows(*zip(*hot, strict=True))

    def run(batches):
        sets, rest = Sets(), None
        for b in batches:
            columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            columns[2] = columns[2].astype(np.int64)
            columns = columns if rest is None else [np.concatenate(pair) for pair in zip(rest, columns, strict=True)]
            key, salt, n, v, _ = columns
            if not len(key):
                continue
            other = np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
            again = ~other & np.concatenate([[False], v[1:] == v[:-1]])  # a vertex of several tasks
            new = (other | np.concatenate([[False], 100 * n[:-1] < PERCENT * n[1:]]))[~again]
            columns = [c[~again] for c in columns]
            cut = int(np.flatnonzero(new)[-1])  # the last run may go on
            if cut:
                yield from meet(new[:cut], *(c[:cut] for c in columns), sets)
            rest = [c[cut:] for c in columns]
            if len(sets.above) > CONNECTED:
                yield rows(list(sets.above), [sets.find(x) for x in sets.above], np.zeros(len(sets.above), np.int8))
                sets = Sets()
        if rest is not None:
            yield from meet(np.arange(len(rest[0])) == 0, *rest, sets)
        if sets.above:
            yield rows(list(sets.above), [sets.find(x) for x in sets.above], np.zeros(len(sets.above), np.int8))

    return run


class Block:
    """Texts of one block of a family, or of two, joined among themselves."""

    def __init__(self, ranks: np.ndarray) -> None:
        self.ranks = ranks
        self.members: dict[int, tuple] = {}

    def add(self, v: int, text: str, copies: int, side: int) -> None:
        if v in self.members:
            return
        raw = np.frombuffer((text or "").encode(), np.uint8)
        for _, s in shingle_sets(raw, np.array([0, len(raw)])):
            self.members[v] = (s, *prefix(s, self.ranks), copies, side)

    def links(self, across: bool) -> tuple[list[tuple[int, int]], dict[int, int]]:
        """Links that connect what is similar here, and of each text the number of rows that are similar to it; with across, of pairs of different blocks."""
        order = sorted(self.members, key=lambda v: (len(self.members[v][0]), v))
        if not order:
            return [], {}
        sets, prefixes, l, n_small, copies, side = zip(*(self.members[v] for v in order), strict=True)
        size, l, copies, side = (np.array(x, np.int64) for x in ([len(s) for s in sets], l, copies, side))
        shingles, sets = numbered(sets)
        keys, prefixes = numbered(prefixes)
        # texts by prefix shingle: room for all, filled up to the present text
        room = np.bincount(np.concatenate([k[:m] for k, m in zip(prefixes, n_small, strict=True)]), minlength=keys)
        start = np.cumsum(room) - room
        end, posted = start.copy(), np.zeros(int(room.sum()), np.int64)
        label, degree, mark, out = np.arange(len(order)), np.zeros(len(order), np.int64), np.zeros(shingles, bool), []
        for y, k in enumerate(prefixes):
            met = [posted[a:z] for a, z in zip(start[k].tolist(), end[k].tolist(), strict=True) if a < z]
            if met:
                counts = np.bincount(np.concatenate(met), minlength=y)
                able = (counts > 0) & (counts >= np.minimum(l[:y], l[y])) & (100 * size[:y] >= PERCENT * size[y])
                if across:
                    able &= side[:y] != side[y]
                found = np.flatnonzero(able)
                if len(found):
                    mark[sets[y]] = True
                    both = np.add.reduceat(mark[np.concatenate([sets[x] for x in found.tolist()])], np.cumsum(size[found]) - size[found], dtype=np.int64)
                    mark[sets[y]] = False
                    found = found[100 * both >= PERCENT * (size[found] + size[y] - both)]
                    degree[found] += copies[y]
                    degree[y] += copies[found].sum()
                    labels, one = np.unique(label[found], return_index=True)
                    out += [(order[x], order[y]) for x in found[one].tolist()]
                    label[np.isin(label, labels)] = y
            k = k[: n_small[y]]
            posted[end[k]] = y
            end[k] += 1
        return out, {order[x]: int(degree[x]) for x in np.flatnonzero(degree).tolist()}


def numbered(parts: tuple[np.ndarray, ...]) -> tuple[int, list[np.ndarray]]:
    """How many distinct values the parts have, and the parts with each value as a number below that."""
    values, at = np.unique(np.concatenate(parts), return_inverse=True)
    return len(values), np.split(at, np.cumsum([len(x) for x in parts])[:-1])


def _join(ranks):
    """Texts sorted by blocks p and q to verified links (a, b, null) and to (a, null, rows that a is linked to)."""
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches):
        at, block = None, None

        def done():
            links, degree = block.links(at[0] != at[1])
            none, less = [None] * len(links), [None] * len(degree)
            return pa.RecordBatch.from_arrays([pa.array([*(x for x, _ in links), *degree], pa.int64()), pa.array([*(y for _, y in links), *less], pa.int64()), pa.array([*none, *degree.values()], pa.int64())], schema=arrow)

        for b in batches:
            for low in range(0, b.num_rows, 500):
                part = b.slice(low, 500)
                for p, q, v, own, copies, text in zip(*(part.column(i) for i in range(6)), strict=True):
                    here = p.as_py(), q.as_py()
                    if here != at:
                        if block:
                            yield done()
                        at, block = here, Block(ranks.value)
                    block.add(v.as_py(), text.as_py(), copies.as_py(), own.as_py())
        if block:
            yield done()

    return run


def _bits(v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each vertex."""
    h = wh.mix(v.view(np.uint64).copy())
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def member_filter(members: DataFrame) -> np.ndarray | None:
    """A Bloom filter of the vertices in column v, of FILTER_BITS bits at most; None where that is too few to hold many back.

    It only spares texts without a candidate the way to the join by v, which decides.
    """
    bits = 1 << max(16, (BITS_A_TEXT * members.count()).bit_length())
    if bits > 4 * FILTER_BITS:
        return None
    bits = min(bits, FILTER_BITS)
    arrow = pa.schema([("slice", pa.int32()), ("bits", pa.binary())])

    def build(batches):
        seen = np.zeros(bits, bool)
        for b in batches:
            for at in _bits(b.column(0).to_numpy(), bits):
                seen[at] = True
        for k, part in enumerate(np.split(seen, SLICES)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(np.packbits(part).tobytes(), 1)], pa.binary())], schema=arrow)

    def either(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(part), np.uint8)
                sums[k] = sums[k] | part if k in sums else part
        for k, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], schema=arrow)

    out, schema = np.zeros(bits // 8, np.uint8), "slice int, bits binary"
    for r in members.select("v").mapInArrow(lean(build), schema).repartition(min(SLICES, partitions(members.sparkSession)), "slice").mapInArrow(lean(either), schema).collect():
        size = len(out) // SLICES
        out[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out


def _texts(vertices: Vertices, filter_):
    """Texts to (v, text), once for each vertex new to the task that the filter (a broadcast of one or of None) lets through."""
    arrow = pa.schema([("v", pa.int64()), ("text", pa.string())])

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            for low, data, offsets in wh.chunks(b.column(0)):
                rows, numbers = [], []
                for r, s in shingle_sets(data, offsets):
                    v = vertices.number(s)
                    if v not in seen:
                        if len(seen) < SEEN:
                            seen.add(v)
                        rows.append(low + r)
                        numbers.append(v)
                if not rows:
                    continue
                rows, numbers = np.array(rows), np.array(numbers, np.int64)
                if filter_.value is not None:
                    held = [filter_.value[at >> 3] >> (7 - (at & 7)) & 1 for at in _bits(numbers, 8 * len(filter_.value))]
                    through = (held[0] & held[1]).astype(bool)
                    rows, numbers = rows[through], numbers[through]
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), b.column(0).take(pa.array(rows)).cast(pa.string())], schema=arrow)

    return run


def _block_postings(ranks, most: int):
    """Texts of large families (block, v, text) to a row for each prefix shingle: key, part, block, n, l (as in _postings), v.

    A shingle of very many texts is dealt to several parts, each text to one; in the others it is
    known, without v, by its block and size.
    """
    arrow = pa.schema([("key", pa.int64()), ("part", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("l", pa.int8()), ("v", pa.int64())])

    def run(batches):
        for b in batches:
            blocks, numbers = b.column(0).to_numpy(), b.column(1).to_numpy()
            for low, data, offsets in wh.chunks(b.column(2)):
                rows, keys, sizes, needs = [], [], [], []
                for r, s in shingle_sets(data, offsets):
                    k, l, n_small = prefix(s, ranks.value)
                    rows.append(low + r)
                    keys.append(k)
                    sizes.append(len(s))
                    need = l if len(k) >= COUNTED else 1
                    needs.append(np.where(np.arange(len(k)) < n_small, need, -need).astype(np.int8))
                if not rows:
                    continue
                lengths, k = [len(x) for x in keys], np.concatenate(keys)
                at, n, l, parts = np.repeat(rows, lengths), np.repeat(sizes, lengths), np.concatenate(needs), shares(k, most)
                home = numbers[at] % parts
                for step in range(int(parts.max())):
                    some = np.flatnonzero(parts > step)
                    v = pa.array(numbers[at[some]], mask=np.full(len(some), step > 0))
                    yield pa.RecordBatch.from_arrays([pa.array(k[some].view(np.int64)), pa.array((home[some] + step) % parts[some]), pa.array(blocks[at[some]]), pa.array(n[some]), pa.array(l[some]), v], schema=arrow)

    return run


def _visits(most: int):
    """Rows of _block_postings sorted by key, part, block and v to (p, q, v, w, need, times).

    v and w, each time, have that many prefix shingles in common, and must visit the blocks p and q if these are as many as they need.
    """
    arrow = pa.schema([("p", pa.int64()), ("q", pa.int64()), ("v", pa.int64()), ("w", pa.int64()), ("need", pa.int8()), ("times", pa.int32())])

    def rows(p, q, v, w, need) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (p, q, v, w, need.astype(np.int8), np.ones(len(p), np.int32))], schema=arrow)

    def meet(key, part, block, n, l, v, known):
        """Of whole runs of one key and part: the pairs of short ones; of the others each row with v and each block of its run that may hold a similar text."""
        first, end, run = runs(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
        short = (end - first <= PAIRS) & (shares(key[first].view(np.uint64), most) == 1)
        x, y, need = pairs(run, short, n, v, l)
        if len(x):
            yield rows(np.minimum(block[x], block[y]), np.maximum(block[x], block[y]), v[x], v[y], need)
        small, known = l > 0, known & ~short[run]
        at = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (block[1:] != block[:-1])]))
        texts, other = np.diff(np.append(at, len(key))), block[at]
        low, high = np.minimum.reduceat(n, at), np.maximum.reduceat(n, at)
        small_low, small_high = np.minimum.reduceat(np.where(small, n, 1 << 62), at), np.maximum.reduceat(np.where(small, n, -1), at)
        groups = np.bincount(run[at], minlength=len(first))
        start = np.cumsum(groups) - groups
        able = np.flatnonzero(known & ((groups > 1) | (texts[start] > 1))[run])
        for some in np.split(able, np.searchsorted(np.cumsum(groups[run[able]]), np.arange(1 << 20, int(groups[run[able]].sum()), 1 << 20))):
            many = groups[run[some]]
            x = np.repeat(some, many)
            g = np.repeat(start[run[some]] - (np.cumsum(many) - many), many) + np.arange(len(x))
            larger = small[x] & (high[g] >= n[x]) & (PERCENT * low[g] <= 100 * n[x])
            smaller = (small_low[g] <= n[x]) & (100 * small_high[g] >= PERCENT * n[x])
            kept_ = np.flatnonzero((larger | smaller) & ((block[x] != other[g]) | (texts[g] > 1)))
            a, b, who = block[x[kept_]], other[g[kept_]], v[x[kept_]]
            found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), who], 1), axis=0)
            if len(found):
                yield rows(*found.T, found[:, 2], np.zeros(len(found)))

    def run(batches):
        rest = None
        for b in batches:
            columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            columns += [b.column(5).fill_null(0).to_numpy(zero_copy_only=False), b.column(5).is_valid().to_numpy(zero_copy_only=False)]
            columns = columns if rest is None else [np.concatenate(pair) for pair in zip(rest, columns, strict=True)]
            if not len(columns[0]):
                continue
            last = len(columns[0]) - int(np.argmax((columns[0][::-1] != columns[0][-1]) | (columns[1][::-1] != columns[1][-1])))
            whole = (columns[0][0] != columns[0][-1]) or (columns[1][0] != columns[1][-1])
            cut = last if whole else 0  # the last run may go on
            if cut:
                yield from meet(*(c[:cut] for c in columns))
            rest = [c[cut:] for c in columns]
        if rest is not None:
            yield from meet(*rest)

    return run


def visits(postings: DataFrame) -> DataFrame:
    """(p, q, v), once each: v must visit the blocks p and q, because it may be similar to a text of the one that it isn't in.

    Of two similar texts that have a prefix shingle in common, the one that isn't larger has it in its
    prefix for sets that aren't smaller.  The texts of a shingle that many have are summed up by block before they
    meet; the others' pairs are counted.
    """
    dealt = postings.repartition(partitions(postings.sparkSession), "key", "part").sortWithinPartitions("key", "part", "block", "v")
    met = dealt.mapInArrow(lean(_visits(SALT)), "p long, q long, v long, w long, need byte, times int")
    met = met.groupBy("p", "q", "v", "w", "need").agg(F.sum("times").alias("times")).filter("times >= need")
    return met.select("p", "q", F.explode(F.array("v", "w")).alias("v")).distinct()


def links(docs: DataFrame, sets: DataFrame, vertices: Vertices) -> DataFrame:
    """Verified links (a, b, null) between vertices, enough to connect all similar sets, and (a, null, n): a is linked to n rows of other vertices, in parts to be summed.

    docs has _text, sets (v, n, copies, m) of every vertex.
    """
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    ranks = spark.sparkContext.broadcast(count_cells(docs))
    postings = docs.select("_text").mapInArrow(lean(_postings(ranks, vertices)), "key long, salt int, n int, v long, l byte")
    met = postings.repartition(n, "key", "salt").sortWithinPartitions("key", "salt", "n", "v").mapInArrow(lean(_meetings()), "a long, b long, kind byte, n int")
    met = written(met.groupBy("a", "b", "kind").agg(F.sum("n").alias("n")).filter("n >= kind"))
    hot = met.filter("kind < 0")
    across = hot.join(hot.groupBy("a").agg(F.min("b").alias("least"), F.max("kind").alias("most")).filter("most = -1"), "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    families = components(met.filter("kind >= 0").select("a", "b").unionByName(across))
    discard(met)
    members = written(families.join(sets, "v").select("v", F.col("label").alias("family"), F.col("n").alias("size"), "copies", "m"))

    # of a group of members: how many blocks of bounded size it needs
    pieces = F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("pieces")
    families = written(members.groupBy("family").agg(F.count("*").alias("n"), pieces))
    placed = written(join_counted(members, families.withColumnRenamed("pieces", "buckets"), "family").withColumn("place", F.struct("family", F.pmod(F.xxhash64("m"), F.col("buckets")).alias("bucket"))).drop("n"))
    places = written(placed.groupBy("place").agg(F.count("*").alias("n"), pieces))
    number = F.pmod(F.xxhash64("v"), F.col("pieces"))
    blocks = join_counted(placed, places, "place").select("v", "copies", "buckets", F.when(F.col("buckets") == 1, F.col("place.family")).otherwise(F.xxhash64("place", number)).alias("block"))
    through = spark.sparkContext.broadcast(member_filter(members))
    homes = written(docs.select("_text").mapInArrow(lean(_texts(vertices, through)), "v long, text string").join(blocks, "v"))
    discard(members, placed, places)
    own = F.col("block").alias("own")
    laid = homes.filter("buckets = 1").select(F.col("block").alias("p"), F.col("block").alias("q"), "v", own, "copies", "text")
    if not families.filter("pieces > 1").isEmpty():
        large = homes.filter("buckets > 1")
        # written, so that its size is known when it meets the texts, which are much larger
        found = written(visits(large.select("block", "v", "text").mapInArrow(lean(_block_postings(ranks, SALT)), "key long, part long, block long, n long, l byte, v long")))
        laid = laid.unionByName(found.join(large, "v").select("p", "q", "v", own, "copies", "text"))
    out = written(laid.repartition(n, "p", "q").sortWithinPartitions("p", "q").mapInArrow(lean(_join(ranks)), "a long, b long, n long"))
    discard(homes, families)
    return out


def jaccard_components(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text", with_links: bool = False, with_class: bool = False) -> DataFrame:
    """The columns in keep, n_shingles and component_id (least id reachable by links, its own included) of every row.

    A row without shingles has its own id as component_id; null ids count for nothing in the least id.
    with_links adds n_links: the number of other rows that are similar to the row, copies included.
    with_class adds class_id, which is unique to a component also where ids are null or repeated (null without shingles).
    """
    keep = kept(keep, ["n_shingles", "component_id", *["n_links"] * with_links, *["class_id"] * with_class])
    kinds = {f.name: f.dataType for f in docs.schema}
    source = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    names = [f"_k{i}" for i in range(len(keep))] + ["_id"]
    schema = StructType([StructField(x, kinds[c]) for x, c in zip(names, [*keep, id_col], strict=True)] + [StructField("n_shingles", LongType()), *[StructField(c, LongType()) for c in ("_v", "_u", "_m")]])
    described = written(source.mapInArrow(lean(_describe(len(names), arrow_schema(schema), Vertices())), schema))
    described, sets, vertices = apart(described)
    found = links(source, sets, vertices)
    labels = components(found)
    # a row for each vertex: its component's label (its own where nothing is similar), and how many rows have it
    own = sets.join(labels, "v", "left").select(F.col("v").alias("_v"), F.coalesce("label", "v").alias("label"), F.col("copies").alias("n"))
    columns = [*names, "n_shingles", "component_id"]
    if with_links:
        columns.append("n_links")
        others = found.filter("n IS NOT NULL").groupBy(F.col("a").alias("_v")).agg(F.sum("n").alias("others"))
        own = own.join(others, "_v", "left").withColumn("n_links", F.col("n") - 1 + F.coalesce("others", F.lit(0)).cast("long"))
    filled = join_counted(described.filter("_v IS NOT NULL"), written(own), "_v")
    empty = described.filter("_v IS NULL").withColumn("label", F.lit(None).cast("long")).withColumn("component_id", F.col("_id")).withColumn("n_links", F.lit(0).cast("long"))
    if with_class:
        columns.append("class_id")
        filled, empty = (x.withColumn("class_id", F.col("label")) for x in (filled, empty))
    filled = written(filled)
    least = written(filled.groupBy("label").agg(F.min("_id").alias("component_id"), F.count("*").alias("n")))
    done = join_counted(filled.drop("n"), least, "label").select(*columns).unionByName(empty.select(*columns))
    return done.select(*[F.col(x).alias(c) for x, c in zip(names, keep, strict=False)], *columns[len(names) :])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the least id (null last), then least text; rows without shingles all stay.  The columns are those of docs."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_body"))
    packed = packed.withColumn("_t", F.xxhash64("_body")).withColumn("_u", F.hash("_body"))
    placed = jaccard_components(packed.withColumnRenamed("_doc", "doc_id").withColumnRenamed("_body", "text"), keep=("doc_id", "_t", "_u"), with_class=True)
    linked = placed.filter("n_shingles > 0")
    chosen = linked.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "_t", "_u")).alias("one")).select("one.doc_id", "one._t", "one._u")
    chosen = chosen.select(F.col("doc_id").alias("_chosen"), F.col("_t").alias("_ct"), F.col("_u").alias("_cu"))
    # copies of one text are spread by their ids
    one = packed.join(chosen, (F.col("_t") == F.col("_ct")) & (F.col("_u") == F.col("_cu")) & F.col("_doc").eqNullSafe(F.col("_chosen")))
    # repeated rows that agree in id and text: the first of them by all their values
    empty = packed.filter(F.regexp_replace("_body", "[\\x20\\x09-\\x0D]+", "") == "")
    return one.groupBy("_doc", "_t", "_u").agg(F.min("_row").alias("_row")).select("_row.*").unionByName(empty.select("_row.*"))
