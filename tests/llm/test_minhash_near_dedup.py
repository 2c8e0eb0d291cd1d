from __future__ import annotations

import random

import numpy as np

from tallyspan.llm import minhash_near_dedup as m
from tallyspan.llm.components import components
from tallyspan.llm.shared import table


def plain(rows, words, percent):
    sets = {}
    for i, text in rows:
        if i is None:
            continue
        w = (text or "").encode().lower().split()
        grams = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(frozenset(grams))
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in ids}


def edited(draw, words, n):
    words = list(words)
    for _ in range(n):
        words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
    return " ".join(words)


def corpus(seed=3):
    draw = random.Random(seed)
    rows, shared = [], " ".join(f"s{k}" for k in range(12))
    for group in range(6):
        base = [f"g{group}w{draw.randrange(4000)}" for _ in range(120)]
        rows += [edited(draw, base, draw.choice((0, 1, 2, 3, 5, 8))) for _ in range(draw.choice((2, 5, 40)))]
    rows += [shared + " " + " ".join(f"u{draw.randrange(10**6)}" for _ in range(draw.choice((2, 6, 30)))) for _ in range(40)]
    draw.shuffle(rows)
    return [(k * 3 + 5, t) for k, t in enumerate(rows)]


def test_components_equal_brute_force(spark, awkward):
    rows = corpus() + [(r.doc_id, r.text) for r in awkward.collect()] + [(5, "other text under an id that is used twice in this table here")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for words, percent in ((3, 85), (5, 80)):
        expected = plain(rows, words, percent)
        found = m.near_duplicates(frame, words=words, percent=percent).collect()
        assert len(found) == len(rows)
        assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == expected
        assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in found)


def test_many_tiles_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(m, "TILE", 7)
    monkeypatch.setattr(m, "SIGN_TILE", 5)
    rows = corpus(9)
    found = m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in found} == plain(rows, 3, 85)


def test_index_meets_every_pair_under_the_distance(spark):
    import pyarrow as pa

    draw = np.random.default_rng(4)
    for distance in (0, 5, 2 * m.CHUNKS - 1):
        one, rest = draw.integers(0, 2**16, m.SYMBOLS).astype("<u2"), bytes(m.SKETCH)
        for _ in range(50):
            two = one.copy()
            two[draw.choice(m.SYMBOLS, distance, replace=False)] ^= 1
            batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([one.tobytes() + rest, two.tobytes() + rest], pa.binary())], names=["class_id", "signature"])
            out = next(m.index(iter([batch]))).to_pydict()
            keys = {}
            for k, c in zip(out["key"], out["class_id"], strict=True):
                keys.setdefault(k, set()).add(c)
            assert any(len(v) == 2 for v in keys.values())


def test_shingle_counts_and_empty_table(spark, awkward, nothing):
    found = {r.doc_id: r.n_shingles for r in m.near_duplicates(awkward, words=3, percent=85).collect()}
    assert (found[4], found[5], found[6], found[7], found[10], found[1]) == (0, 0, 0, 1, 1, 15)
    assert m.near_duplicates(nothing).count() == 0 and m.keep_one(nothing).count() == 0


def test_one_of_each_group_stays(spark, awkward):
    kept = m.keep_one(awkward)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == awkward.columns and 1 in ids and not {2, 3, 8} & set(ids) and {4, 5, 6, 7, None} <= set(ids)


def test_intersections_are_exact():
    draw = np.random.default_rng(2)
    sets = [np.unique(draw.integers(0, 300, 120).astype(np.uint64)) for _ in range(9)] + [np.empty(0, np.uint64)]
    both = m.intersections(sets, width=16)
    assert all(both[a, b] == len(np.intersect1d(sets[a], sets[b])) for a in range(10) for b in range(10) if a != b)


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (3, 2)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert all(found[k] == 0 for k in range(41)) and all(found[k] == 100 for k in range(100, 160))
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_query_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert {r.doc_id: r.component_id for r in m.op5_minhash_near_dedup(spark, sf).collect()} == plain(rows, 3, 85)


def test_distances_count_differing_symbols():
    draw = np.random.default_rng(8)
    signs = [m.signature(np.unique(draw.integers(0, 60, 50).astype(np.uint64))) for _ in range(7)]
    found = m.distances(signs)
    one, rest = m.symbols(signs)
    assert all(found[a, b] == (one[a] != one[b]).sum() + (rest[a] != rest[b]).sum() for a in range(7) for b in range(7))


def boilerplate(draw, share, n=700, size=200):
    """Texts with a common part, of about this similarity pair by pair, and some near copies among them."""
    common = [f"c{k}" for k in range(round(size * 2 * share / (1 + share)))]
    rows = [" ".join([f"u{draw.randrange(10**7)}" for _ in range(size - len(common))] + common) for _ in range(n)]
    return [(k, t) for k, t in enumerate(rows + [edited(draw, t.split(), 1) for t in rows[:10]])]


def test_a_shared_part_makes_no_clusters(spark, monkeypatch):
    """Only pairs under the distance go on to be verified, whatever the number of texts that share a part."""
    for share in (0.2, 0.3, 0.4):
        rows = boilerplate(random.Random(4), share)
        fed = []
        real = m.tiled
        monkeypatch.setattr(m, "tiled", lambda members, size: fed.append((size, met := real(members, size))) or met)
        found = m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85)
        assert {r.doc_id for r in found.collect() if not r.kept} == set(range(700, 710))
        monkeypatch.setattr(m, "tiled", real)
        texts = next(met for size, met in fed if size == m.TILE)
        assert texts.count() <= 24  # two for each pair of near copies, and next to none by chance
