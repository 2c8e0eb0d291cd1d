from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tallyspan.llm import exact_topk as x
from tests.oracle import FOLDER, same


def plain(rows, k):
    sound = {}
    for i, v in rows:
        if i is not None and v and all(a is not None and np.isfinite(a) for a in v):
            w = tuple(int(np.floor(256 * float(np.float32(a)))) for a in v)
            sound[i] = min(sound.get(i, w), w)
    out = {}
    for q in (i for i in sound if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(sound[q], w, strict=True)), i) for i, w in sound.items() if i != q and len(w) == len(sound[q]))
        out |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def found(frame, k=5):
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in x.top_k(frame, F.col("vec_id") % 50 == 0, k).collect()}


def test_equals_sql(spark):
    assert same(spark, x.op9_exact_topk, x.oracle(), FOLDER) > 0


def test_awkward_vectors(spark):
    draw = np.random.default_rng(3)
    rows = [(k, [float(v) for v in draw.choice([-0.5, 0.0, 0.25, 0.5], 4)]) for k in range(160)]
    rows += [(200, None), (201, [None, 1.0, 1.0, 1.0]), (202, [float("nan")] * 4), (203, [float("inf")] * 4), (None, [1.0] * 4), (204, []), (250, [0.5, 0.5]), (251, [0.5, 0.25]), (3, rows[3][1]), (300, [0.5] * 4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    assert found(frame) == plain(rows, 5)
    assert found(frame.limit(0)) == {} and len(found(frame.where("vec_id in (0, 1, 2)"))) == 2


def test_blocks_shards_and_the_merging_tree(spark, monkeypatch):
    monkeypatch.setattr(x, "QUERY_BLOCK", 2)
    monkeypatch.setattr(x, "SHARD_ROWS", 20)
    monkeypatch.setattr(x, "FAN_IN", 2)
    draw = np.random.default_rng(6)
    rows = [(k, [float(v) for v in draw.integers(-2, 3, 3) / 4]) for k in range(240)]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == plain(rows, 5)


def test_large_components_through_the_query(spark):
    """Products of any size are exact up to 64 bits and cut there; a few large rows among many small ones change nothing else."""
    draw = np.random.default_rng(12)
    rows = [(k, [float(v) for v in draw.integers(-4, 5, 3) / 4]) for k in range(120)]
    rows += [(500, [3e8, 1.0, 0.0]), (501, [3e8, 0.5, 0.0]), (502, [-3e8, 1.0, 2.0]), (550, [1e30, 1.0, 1.0]), (551, [-1e30, 0.0, 0.0]), (552, [1e5, 1e5, 1e5]), (553, [3.6028797018963964e16, 0.0, 0.0])]
    scaled = {i: [max(-(2**63), min(2**63 - 1, int(np.floor(256 * np.float64(x))))) for x in v] for i, v in rows}
    expected = {}
    for q in (i for i in scaled if i % 50 == 0):
        dots = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(scaled[q], w, strict=True)))), i) for i, w in scaled.items() if i != q)
        expected |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(dots[:5])}
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == expected


def test_wide_products_equal_python():
    draw = np.random.default_rng(1)
    for most in (2**30, 2**45, 2**62):
        left, right = draw.integers(-most, most, (4, 7)), draw.integers(-most, most, (5, 7))
        left[0, 0], right[1, 1] = -(2**63), 2**63 - 1
        exact = [[max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(one, two, strict=True)))) for two in right] for one in left]
        assert x.products(left, right).tolist() == exact
    assert x.best_of(np.asarray([[2**30, 1]]), np.asarray([0]), np.asarray([[2**30, 1], [2**30, 2]]), np.asarray([0, 1]), 5) == [(0, 1, 2**60 + 2)]
