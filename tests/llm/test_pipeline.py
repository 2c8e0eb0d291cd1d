from __future__ import annotations

import zlib

import corpus_pipeline as p
from tallyspan.llm import best_fit_packing, minhash_near_dedup, secret_scans, toxicity
from tallyspan.llm.shared import table, written
from tests.llm.test_minhash_near_dedup import plain as plain_components

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    model = toxicity.train(docs, table(spark, SF, "labels"))
    weighing = toxicity.Weighing(model.lexicon)
    for name, stage in p.STAGES:
        before = docs.collect()
        docs = written(stage(spark, docs, SF), f"test-{name}")
        after = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        if name == "toxicity":
            scores = dict(zip([r.doc_id for r in before], model.score([r.text for r in before], weighing), strict=True))
            assert sorted(r.doc_id for r in after) == sorted(i for i, s in scores.items() if s < toxicity.THRESHOLD)
        elif name == "near_dedup":
            roots = plain_components([(r.doc_id, r.text) for r in before], 5, 80)
            assert sorted(r.doc_id for r in after) == sorted(i for i, r in roots.items() if i == r)
        elif name == "secrets":
            scorer = secret_scans.Scorer(secret_scans.fitted(spark.createDataFrame(before, docs.schema)))
            assert {r.doc_id: r.text for r in after} == {r.doc_id: secret_scans.redacted(r.text, scorer) for r in before}
        elif name == "mixing":
            assert {r.doc_id for r in after} == {r.doc_id for r in before} and len(after) >= len(before)
        else:
            own = best_fit_packing.spellings(best_fit_packing.default_vocabulary())
            ids = {r.doc_id: own.ids(r.text) + bytes(4) for r in before}
            assert sum(r.length for r in after) == sum(len(ids[r.doc_id]) // 4 for r in before)
            assert all(zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for r in after)


def test_stages_on_awkward_rows(spark, awkward, nothing):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = awkward.select(*names)
    kept = {r.doc_id for r in docs.collect()}
    for name, stage in p.STAGES:
        before = docs.collect()
        docs = written(stage(spark, docs, SF), f"test-{name}")
        after = docs.collect()
        if name == "toxicity":
            assert {r.doc_id for r in after} <= kept and {1, 4, 5, 6, 7, 10, None} <= {r.doc_id for r in after}
        elif name == "near_dedup":
            assert {4, 5, 6, 7, None} <= {r.doc_id for r in after} and not {2, 3, 8} & {r.doc_id for r in after}
        elif name == "secrets":
            assert len(after) == len(before) and not any("hunter2hunter2" in (r.text or "") for r in after)
            assert sorted(str(r.text) for r in after if r.doc_id != 12) == sorted(str(r.text) for r in before if r.doc_id != 12)
        elif name == "mixing":
            assert {r.doc_id for r in after} == {r.doc_id for r in before} and {tuple(r) for r in after} == {tuple(r) for r in before}
        else:
            assert {r.doc_id for r in after} == {r.doc_id for r in before} and len({(r.row_key, r.piece) for r in after}) == len(after)
            assert len({r.row_key for r in after}) == len(before)
    docs = nothing.select(*names)
    for name, stage in p.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        assert docs.count() == 0


def test_run_keeps_only_its_results(spark):
    from pathlib import Path

    from tallyspan.llm.shared import own_folder, release

    release(spark)
    rows = p.run(spark, SF).collect()
    assert len({(r.row_key, r.piece) for r in rows}) == len(rows) > 0
    left = {f.name.rsplit("-", 1)[0] for f in Path(own_folder(spark).removeprefix("file://")).iterdir()}
    assert left == {"sequences", "stage-packing"}


def test_near_copies_keep_their_smallest_id(spark):
    text = " ".join(f"w{k}" for k in range(200))
    rows = spark.createDataFrame([(9, text), (4, text + " tail"), (7, "something else that is said in quite other words")], "doc_id long, text string")
    assert sorted(r.doc_id for r in minhash_near_dedup.keep_one(rows).collect()) == [4, 7]
