import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hybridkb.llm import near_duplicates as nd
from hybridkb.llm.components import Unions, connected_components

DOCS = "doc_id long, text string"


def corpus(seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randint(1, 5))) for _ in range(500)]
    passage = [r.choice(words) for _ in range(60)]
    docs = []

    def add(ws):
        docs.append((len(docs), r.choice([" ", "  ", "\n"]).join(ws)))

    for size in [1, 2, 3, 4, 5, 7, 9, 12, 20, 40, 60, 100, 150, 260, 300, 600, 1200]:
        for _ in range(3):
            base = [r.choice(words) for _ in range(size)]
            add(base)
            for rate in (0.0, 0.01, 0.03, 0.06, 0.1):
                ws = [r.choice(words) if r.random() < rate else w for w in base if r.random() >= rate / 4]
                add(ws or base)
            cut = r.randrange(1 + size // 5)
            add(base[cut:] or base)
    for _ in range(40):
        ws = [r.choice(words) for _ in range(r.choice([30, 90, 200]))]
        k = r.randrange(len(ws))
        add(ws[:k] + passage + ws[k:])
    return docs


def grams(t, n=3):
    w = [x for x in __import__("re").split(r"[\t\n\x0b\f\r ]+", t) if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs, g, n=3):
    sets = [(i, grams(t, n)) for i, t in docs if i is not None and t and grams(t, n)]
    out = {}
    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if i != j and min(len(a), len(b)) >= g * max(len(a), len(b)):
                v = len(a & b) / len(a | b)
                if v >= g - 1e-12:
                    k = (min(i, j), max(i, j))
                    out[k] = max(out.get(k, 0), round(v, 6))
    return out


def brute_pairs(docs, g):
    """Pairs of different sets, each named by the least document that has it."""
    least = {}
    for i, t in docs:
        if i is not None and t and (x := frozenset(grams(t))):
            least[x] = min(i, least.get(x, i))
    sets = sorted(((i, x) for x, i in least.items()), key=lambda v: v[0])
    out = {}
    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            v = len(a & b) / len(a | b)
            if i != j and v >= g - 1e-12:
                out[i, j] = max(out.get((i, j), 0), round(v, 6))
    return out


def brute_classes(docs, g):
    names = {}
    own = {i: set() for i, _ in docs if i is not None}
    for i, t in docs:
        if i is not None and t and (x := frozenset(grams(t))):
            own[i].add(names.setdefault(x, len(names)))
    sets = list(names)
    near = [{j for j, b in enumerate(sets) if j != k and len(a & b) / len(a | b) >= g - 1e-12} for k, a in enumerate(sets)]
    u = Unions(len(sets))
    edges = [(k, j) for k, js in enumerate(near) for j in js] + [(min(x), j) for x in own.values() for j in x]
    u.join(np.array([e[0] for e in edges], int), np.array([e[1] for e in edges], int))
    root = u.roots(np.arange(len(sets))).tolist()
    least = {}
    for i, x in own.items():
        for k in x:
            least[root[k]] = min(i, least.get(root[k], i))
    return {i: (min((least[root[k]] for k in x), default=i), max((len(near[k]) for k in x), default=0)) for i, x in own.items()}


def classes(df):
    rows = df.collect()
    assert df.columns == ["doc_id", "class_id", "n_links"]
    out = {r.doc_id: (r.class_id, r.n_links) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("g", [0.75, 0.9, 0.6])
def test_all_pairs_are_found(spark, g):
    docs = corpus()
    frame = spark.createDataFrame(docs, DOCS).repartition(5)
    got = {(r.doc_a, r.doc_b): r.jaccard for r in nd.representative_pairs(frame, threshold=g).collect()}
    assert got == brute_pairs(docs, g) and len(got) > 20
    assert classes(nd.near_duplicate_classes(frame, threshold=g)) == brute_classes(docs, g)


def test_thresholds_without_the_guarantee_are_refused(spark):
    with pytest.raises(ValueError):
        nd.near_duplicate_classes(spark.createDataFrame(corpus()[:3], DOCS), threshold=0.3)


def test_sql_agrees(spark):
    docs = corpus(2) + [(3, "a further text of document three"), (500, "a further text of document three"), (501, None), (502, " ")]
    documents = pd.DataFrame(docs, columns=["doc_id", "text"])  # noqa: F841
    c = duckdb.connect()
    c.register("documents", documents)
    assert {i: (k, n) for i, k, n in c.execute(nd.oracle()).fetchall()} == brute_classes(docs, nd.THRESHOLD)


def test_similar_sets_share_a_signature():
    """The guarantee itself, before sketches: random pairs at the threshold, at many sizes."""
    bands, rng = nd.Bands(0.75), np.random.default_rng(3)
    for size in [1, 2, 3, 5, 8, 13, 40, 63, 64, 100, 127, 128, 200, 255, 256, 400, 511, 512, 900, 1500, 5000]:
        for _ in range(12):
            a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            swap = int(size * 1 / 7)
            b = np.concatenate([a[swap:], rng.integers(0, 1 << 63, swap, dtype=np.uint64)]) if rng.random() < 0.5 else a[: max(1, int(np.ceil(0.75 * size)))]
            both = [np.unique(x) for x in (a, b)]
            inter = len(np.intersect1d(*both))
            if inter < 0.75 * (len(both[0]) + len(both[1]) - inter):
                continue
            s, o, e = nd.signatures(np.concatenate(both), np.cumsum([0, len(both[0]), len(both[1])]), np.array([1, 2]), bands)
            sides = [set(s[e["id"][o] == i].tolist()) for i in (1, 2)]
            assert sides[0] & sides[1], size


def test_blocks_of_a_large_group(spark):
    """Tiles of a component of 60 different sets in blocks of 4 or so, copies among them."""
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) if i % 5 else " ".join(base)) for i in range(60)]
    frame = spark.createDataFrame(docs, DOCS)
    got = {(r.doc_a, r.doc_b): r.jaccard for r in nd.representative_pairs(frame, block=4).collect()}
    want = brute_pairs(docs, nd.THRESHOLD)
    assert got == want and len(got) > 900
    assert classes(nd.near_duplicate_classes(frame, block=4)) == brute_classes(docs, nd.THRESHOLD)


def test_a_signature_that_many_share():
    """Groups of over 512 entries: whoever is alike is connected, by whatever order of sizes."""
    rng = np.random.default_rng(5)
    shared = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    sets = []
    for i in range(700):
        base = np.random.default_rng(1000 + i // 2).integers(0, 1 << 63, 30 + (i // 2) % 90, dtype=np.uint64)
        sets.append(np.unique(np.concatenate([shared[:3], base[: len(base) - i % 2]])))
    ids, bounds = np.arange(700), np.cumsum([0] + [len(x) for x in sets])
    entries = np.zeros(700, nd.ENTRY)
    entries["id"], entries["size"], entries["sketch"] = ids, np.diff(bounds), nd.sketches(np.concatenate(sets), bounds)
    a, b = nd.links(np.zeros(700, np.uint32), np.arange(700), entries, 0.75)
    u = Unions(700)
    u.join(a, b)
    root = u.roots(ids)
    assert (root[::2] == root[1::2]).all() and len(np.unique(root)) > 300


def test_groups_of_signatures_by_chunks(spark):
    docs = corpus(4) + [(1000 + i, t) for i, t in corpus(4)[::7]]
    frame = spark.createDataFrame(docs, DOCS).repartition(6)

    def groups(links):
        return {(r.node, r.component) for r in connected_components(links).collect()}

    whole = nd.candidate_links(frame, nd.NGRAM, nd.THRESHOLD)
    assert groups(nd.candidate_links(frame, nd.NGRAM, nd.THRESHOLD, 2000)) == groups(whole)


def test_two_chunks_of_one_signature():
    """Pairs across chunks are found with those within them taken as given."""
    rng = np.random.default_rng(8)
    bases = [rng.integers(0, 1 << 63, 40 + i % 60, dtype=np.uint64) for i in range(300)]
    sets = [np.unique(bases[i % 300][: len(bases[i % 300]) - i // 300]) for i in range(900)]
    entries = np.zeros(900, nd.ENTRY)
    bounds = np.cumsum([0] + [len(x) for x in sets])
    entries["id"], entries["size"], entries["sketch"] = np.arange(900), np.diff(bounds), nd.sketches(np.concatenate(sets), bounds)
    for second in (1, 450, 600):
        halves = [nd.links(np.zeros(len(e), np.uint32), np.arange(len(e)), e, 0.75) for e in (entries[:second], entries[second:])]
        joined = tuple(np.concatenate([h[k] for h in halves]) for k in (0, 1))
        a, b = nd.links(np.zeros(900, np.uint32), np.arange(900), entries, 0.75, second, joined)
        u = Unions(900)
        u.join(a, b)
        root = u.roots(np.arange(900))
        assert (root[:300] == root[300:600]).all() and (root[:300] == root[600:]).all() and len(np.unique(root)) == 300


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(None, 3), (5, None), (7, 7)]
    u = Unions(400)
    plain = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    u.join(np.array([a for a, _ in plain]), np.array([b for _, b in plain]))
    nodes = {x for e in plain for x in e}
    want = {(x, int(u.roots(np.array([x]))[0])) for x in nodes}
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_one_of_each_group_stays(spark):
    docs = corpus()
    u = Unions(len(docs))
    pairs = brute(docs, nd.THRESHOLD)
    u.join(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    want = sorted(set(u.roots(np.arange(len(docs))).tolist()))
    frame = spark.createDataFrame(docs, DOCS).withColumn("_gone", F.lit(1))
    got = nd.keep_one_of_each(frame)
    assert got.columns == frame.columns and sorted(r.doc_id for r in got.collect()) == want


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, "   \n"), (None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (5, "a b c d"), (6, long), (7, long + " x"), (8, "a"), (9, "a"), (10, ""), (4, "other text here now")]
    docs = spark.createDataFrame(rows, DOCS)
    clash = docs.withColumns({"component": F.lit(1), "node": F.lit(2), "block": F.lit(3), "jaccard": F.lit(4.0)})
    got = classes(nd.near_duplicate_classes(clash))
    assert got == brute_classes(rows, nd.THRESHOLD)
    assert got[5] == (4, 0) and got[7] == (6, 1) and got[9] == (8, 0) and got[1] == (1, 0)
    assert nd.near_duplicate_classes(docs.limit(0)).count() == 0 and nd.keep_one_of_each(docs.limit(0)).count() == 0
    kept = sorted(((r.doc_id, r.text and r.text[:5]) for r in nd.keep_one_of_each(docs).collect()), key=str)
    assert kept == sorted([(1, None), (2, ""), (3, "   \n"), (None, "a b c"), (4, "a b c"), (4, "other"), (6, "w0 w1"), (8, "a"), (10, "")], key=str)
