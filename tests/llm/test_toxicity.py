from __future__ import annotations

import zlib

import numpy as np

from tallyspan.llm import toxicity as t
from tallyspan.llm.boosting import Boosted, Isotonic
from tallyspan.llm.shared import table

SF = "/root/testdata/sf0.01"


def test_trees_and_calibration():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(800, 3))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5)).astype(float)
    model = Boosted(rounds=40).fit(x, y)
    assert ((model(x) > 0) == (y > 0)).mean() > 0.97
    fit = Isotonic().fit(np.asarray([0.1, 0.2, 0.3, 0.4]), np.asarray([0.0, 1.0, 0.0, 1.0]))
    assert (np.diff(fit(np.linspace(0, 1, 20))) >= 0).all()
    assert Boosted().fit(np.zeros((0, 3)), np.zeros(0))(np.zeros((2, 3))).tolist() == [0.0, 0.0]


def test_held_out_accuracy(spark):
    documents, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = t.op3_toxicity(spark, SF).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    right = np.mean([r.predicted == r.toxic for r in held])
    assert len(held) > 50 and right > 0.93 and all(0 <= r.score <= 1 for r in rows)
    assert documents.count() == t.op3_toxicity(spark, SF).count()


def test_held_out_rows_are_ranked_and_calibrated(spark):
    """Ranking, recall and calibration on rows that no label was learned from; accuracy alone says little where few are toxic."""
    sf = "/root/testdata/sf0.1"
    rows = t.op3_toxicity(spark, sf).where("held_out").join(table(spark, sf, "labels"), "doc_id").select("score", "predicted", "toxic").collect()
    score, toxic = np.asarray([r.score for r in rows]), np.asarray([r.toxic for r in rows])
    order = np.argsort(score, kind="stable")
    _, place, many = np.unique(score[order], return_inverse=True, return_counts=True)
    ranks = np.empty(len(score))
    ranks[order] = (np.cumsum(many) - (many - 1) / 2)[place]
    auc = (ranks[toxic == 1].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (1 - toxic).sum())
    found = np.asarray([r.predicted for r in rows])
    assert toxic.sum() > 100 and auc > 0.98 and found[toxic == 1].mean() > 0.9 and found[toxic == 0].mean() < 0.05
    assert ((score - toxic) ** 2).mean() < 0.03
    for low, high in ((0.0, 0.05), (0.9, 1.01)):  # where most scores are, they say how many are toxic
        part = (score >= low) & (score < high)
        assert abs(score[part].mean() - toxic[part].mean()) < 0.05


def test_held_out_labels_change_nothing(spark):
    documents, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = labels.withColumn("toxic", t.F.when(t.held_out(t.F.col("doc_id")), 1 - t.F.col("toxic")).otherwise(t.F.col("toxic")))
    one, two = t.train(documents, labels, rows=150), t.train(documents, flipped, rows=150)
    assert one.lexicon == two.lexicon and np.array_equal(one.calibration.y, two.calibration.y)


def test_awkward_rows(spark, awkward, nothing):
    model = t.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    found = {r.doc_id: r for r in t.score(awkward, model).collect()}
    assert len(found) == 14 and found[4].score == found[5].score and found[13].predicted == 1 and found[1].predicted == 0
    kept = t.reject_toxic(awkward, model)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} == set(found) - {13}
    assert t.score(nothing, model).count() == 0
    assert t.score(awkward, t.train(nothing, table(spark, SF, "labels").limit(0))).count() == awkward.count()


def test_hidden_spellings():
    w = t.Weighing(t.Lexicon({"idiot": 5.0}, {}))
    assert w["1d10t"][2] == "hidden" and w["Idiot!"][0] == 5.0 and w["table"] is None and w["you"][2] == "person"
