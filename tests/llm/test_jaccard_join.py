import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.llm import jaccard_join as jj
from pathloom.llm.graph import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = defaultdict(list)
    for k, s in enumerate(sets):
        common = Counter(j for x in s for j in index[x])
        for x in s:
            index[x].append(k)
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[find(k)] = find(j)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(sets[k]), least.get(find(k))) for k, (i, *_) in enumerate(rows))


def corpus(seed, families=12):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghijklmn") + r.choice("opqrstuvwxyz") * r.randint(0, 3)
    line = " ".join(word() for _ in range(9))
    rows = []
    for _ in range(families):
        base = [word() for _ in range(r.randint(1, 120))]
        for _ in range(r.choice((1, 2, 3, 14))):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = word()
            if r.random() < 0.3:
                w += line.split()
            text = " ".join(w)
            rows.append((len(rows), text.upper() if r.random() < 0.2 else text))
    return rows + [(len(rows) + k, t) for k, t in enumerate((None, "", " \n", "one", "ONE", "one two", "é É", line, line))]


@pytest.mark.parametrize(("seed", "settings_"), [(1, {}), (2, {"BLOCK_TEXTS": 3, "SALT": 2}), (3, {"BLOCK_SHINGLES": 150, "CONNECTED": 4, "SEEN": 3}), (4, {"BLOCK_TEXTS": 2, "MOST": 1})])
def test_against_brute_force(make, monkeypatch, seed, settings_):
    """Small blocks and limits, so that families span blocks, frequent shingles are salted and tasks forget."""
    for k, v in settings_.items():
        monkeypatch.setattr(jj, k, v)
    rows = corpus(seed)
    rows += [(None, rows[0][1]), rows[1], (rows[2][0], rows[3][1])]
    got = jj.jaccard_components(make(rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_star_around_one_text_of_a_salted_key(make, monkeypatch):
    """Only the bare text has the common shingles in its prefix for sets that aren't smaller; the others are dealt to other parts too."""
    monkeypatch.setattr(jj, "SALT", 3)
    template = [f"t{k}" for k in range(104)]
    rows = [(0, " ".join(template))] + [(i, " ".join(template + [f"own{i}x{k}" for k in range(24)])) for i in range(1, 31)]
    got = jj.jaccard_components(make(rows)).collect()
    assert {r.component_id for r in got} == {0}
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


@pytest.mark.parametrize("settings_", [{}, {"BLOCK_TEXTS": 3, "SALT": 2}, {"BLOCK_SHINGLES": 150, "CONNECTED": 4, "SEEN": 3}])
def test_number_of_links(make, monkeypatch, settings_):
    """All links count, also those between texts that others connect already, and copies."""
    for k, v in settings_.items():
        monkeypatch.setattr(jj, k, v)
    rows = corpus(7) + [(900, "a b c d e f g h i j k l m n o p"), (901, "a b c d e f g h i j k l m n o p q"), (902, "a b c d e f g h i j k l m n o p q"), (903, "a b c d e f g h i j k l m n o p q r")]
    sets = [shingles(t) for _, t in rows]
    similar = lambda a, b: bool(a) and 100 * len(a & b) >= 75 * len(a | b)
    want = Counter((i, sum(similar(s, o) for o in sets) - bool(s)) for (i, _), s in zip(rows, sets, strict=True))
    assert want[900, 3] and max(n for _, n in want) > 3
    assert Counter((r.doc_id, r.n_links) for r in jj.jaccard_components(make(rows), with_links=True).collect()) == want


HASHES = st.integers(0, 2**54 - 1).map(lambda x: x << 10)


@settings(max_examples=60, deadline=None)
@given(st.lists(HASHES, min_size=1, max_size=40, unique=True), st.data())
def test_prefixes_of_similar_sets_share_enough(x, data):
    """What the multi-match prefix promises, for any order of the shingles."""
    kept = data.draw(st.lists(st.sampled_from(x), unique=True))
    y = list({*kept, *data.draw(st.lists(HASHES, max_size=10, unique=True))})
    if not y or 100 * len({*x} & {*y}) < 75 * len({*x} | {*y}):
        return
    ranks = np.random.default_rng(len(x)).integers(0, 200, jj.CELLS).astype(np.uint16)
    small, large = sorted((np.array(sorted(s), np.uint64) for s in (x, y)), key=len)
    (a, l, n_small), (b, m, _) = jj.prefix(small, ranks), jj.prefix(large, ranks)
    assert len({*a[:n_small].tolist()} & {*b.tolist()}) >= min(l, m)


def test_edges(spark, make):
    docs = make(corpus(5, 3))
    assert jj.jaccard_components(docs.limit(0)).count() == 0
    odd = docs.selectExpr("doc_id", "text", "lang AS _v", "1 AS label", "2 AS _id")
    assert jj.jaccard_components(odd, keep=("doc_id", "_v", "label", "_id")).columns == ["doc_id", "_v", "label", "_id", "n_shingles", "component_id"]
    long = " ".join(f"w{k}" for k in range(200_000))
    assert [r.component_id for r in jj.jaccard_components(make([(7, long), (9, long + " end")])).collect()] == [7, 7]


def test_one_of_each_group_stays(make):
    rows = corpus(6)
    rows += [rows[0], (None, "a null id of its own text"), (500, None), (501, "")]
    kept = jj.keep_one(make(rows))
    assert kept.columns == make(rows).columns
    words = [k for k, (_, t) in enumerate(rows) if shingles(t)]
    groups = {c for _, n, c in brute([rows[k] for k in words])}
    empty = [i for i, t in rows if not shingles(t)]
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*groups, *empty])


def test_components_without_ids_of_their_own_stay_apart(make):
    """Unrelated texts with null ids, or with one id, are groups of their own."""
    rows = [(None, "one text of its own words"), (None, "quite another text that stands alone"), (None, "quite another text that stands alone"), (7, "the seventh says this and that"), (7, "nobody wrote any such line before"), (8, "nobody wrote any such line before")]
    kept = jj.keep_one(make(rows)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([rows[0], rows[1], rows[3], rows[4]])


def test_components(spark):
    r = random.Random(0)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges[:-1]:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x.v: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def chain(n):
    """Texts that share all their shingles with two others each and are similar to none: one family of unconnected texts."""
    phrase = lambda k: " ".join(f"p{k}x{j}" for j in range(14))
    return [(i, phrase(i) + " " + phrase(i + 1)) for i in range(n)]


def test_a_large_family_costs_what_its_candidates_do(make, monkeypatch):
    sent = []
    plain = jj.visits
    monkeypatch.setattr(jj, "visits", lambda p: sent.append(plain(p).cache()) or sent[-1])
    monkeypatch.setattr(jj, "BLOCK_TEXTS", 16)
    rows = chain(800) + [(1000, chain(1)[0][1] + " end")]
    got = jj.jaccard_components(make(rows)).collect()
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id != r.component_id} == {(1000, 0)}
    assert 0 < sent[0].count() <= 4 * len(rows)  # of 50 blocks, each text is sent to those of its neighbours


@pytest.mark.parametrize("bits", [3, 12])
def test_sets_of_one_hash_stay_apart(make, monkeypatch, bits):
    monkeypatch.setattr(jj, "VERTEX_BITS", bits)
    rows = corpus(11)
    got = jj.jaccard_components(make(rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_frequent_labels_and_copies_are_joined_by_broadcast(make, monkeypatch):
    """Copies of one text, a star and many near copies, with every key of more than two rows taken for a frequent one."""
    from pathloom.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", 2)
    template = [f"t{k}" for k in range(104)]
    rows = corpus(8) + [(2000 + i, "the same words in every row here") for i in range(30)]
    rows += [(3000, " ".join(template))] + [(3000 + i, " ".join(template + [f"own{i}x{k}" for k in range(24)])) for i in range(1, 31)]
    got = jj.jaccard_components(make(rows), with_links=True).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert {r.n_links for r in got if 2000 <= r.doc_id < 3000} == {29} and {r.n_links for r in got if r.doc_id > 3000} == {1}


def test_kept_columns_give_way_to_results(make):
    docs = make(corpus(5, 2)).selectExpr("*", "1 AS component_id", "2 AS label", "3 AS n", "4 AS family")
    out = jj.jaccard_components(docs, keep=("doc_id", "component_id", "label", "n", "family"))
    assert out.columns == ["doc_id", "label", "n", "family", "n_shingles", "component_id"] and out.count() == docs.count()
    assert jj.keep_one(docs).columns == docs.columns


@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_the_filter_of_texts_only_spares_work(make, monkeypatch, bits):
    """Too small to be used, and small enough to let other texts through."""
    monkeypatch.setattr(jj, "FILTER_BITS", bits)
    rows = corpus(12)
    got = jj.jaccard_components(make(rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


@pytest.mark.parametrize("settings_", [{"PAIRS": 1}, {"PAIRS": 2, "SALT": 2, "BLOCK_TEXTS": 3}, {"PAIRS": 3, "BLOCK_TEXTS": 2}, {"PAIRS": 30, "BLOCK_TEXTS": 4, "SEEN": 2}])
def test_pairs_that_are_counted_and_shingles_of_many_texts(make, monkeypatch, settings_):
    for k, v in ({"COUNTED": 1} | settings_).items():
        monkeypatch.setattr(jj, k, v)
    rows = corpus(13) + [(700 + i, t) for i, (_, t) in enumerate(corpus(13, 4))]
    got = jj.jaccard_components(make(rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_a_shingle_common_by_chance_connects_nothing(make, monkeypatch):
    """Long texts that share one sentence of five words each with the next; only two copies go to the join of whole texts."""
    sent = []
    plain = jj.member_filter
    monkeypatch.setattr(jj, "member_filter", lambda members: sent.append(members.count()) or plain(members))
    chance = lambda k: [f"c{k}x{j}" for j in range(5)]
    rows = [(i, " ".join([*chance(i), *[f"own{i}x{k}" for k in range(150)], *chance(i + 1)])) for i in range(60)]
    rows.append((99, rows[7][1] + " end"))
    got = jj.jaccard_components(make(rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert sent == [2]


def test_written_tables_leave_no_shuffle_files(spark):
    from pathloom.llm.common import written

    def shuffled():
        return {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}

    before = shuffled()
    table = written(spark.range(10_000).selectExpr("id % 100 AS k", "id").repartition(5, "k").groupBy("k").count())
    assert shuffled() <= before
    assert table.count() == 100
