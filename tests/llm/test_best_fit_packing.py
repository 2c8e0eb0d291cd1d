from __future__ import annotations

import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspan.llm import best_fit_packing as b


def test_spellings_equal_the_tokenizer():
    from tokenizers import Tokenizer

    own, whole = b.Spellings(b.default_vocabulary()), Tokenizer.from_file(b.default_vocabulary())
    draw = random.Random(5)
    special = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>"]
    letters = [chr(c) for c in range(9, 0x250)] + [*"Σςİıﬁ東京́‍🙂"] + [*"abcdeABC .,!'"] * 20 + ["'s", "'LL"] + special * 4
    for _ in range(1500):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 50)))
        assert own.ids(text) == np.asarray(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_special_tokens_are_single_ids():
    own = b.Spellings(b.default_vocabulary())
    assert np.frombuffer(own.ids("a <|endoftext|> b"), "<u4").tolist() == [320, 49407, 321]
    assert 49406 in np.frombuffer(own.ids("x<|startoftext|>y"), "<u4")


def test_rows_equal_the_untouched_tokenizer(spark):
    """Every column but the place, row for row, and as few sequences as item-by-item best fit makes."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(b.default_vocabulary())
    texts = {k: t for k, t in enumerate([None, "", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "word " * 5000, "x" * 9000, *(f"w{k} <|endoftext|> " * k for k in range(60))])}
    expected, lengths = set(), []
    for k, text in texts.items():
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            lengths.append(len(part))
            expected.add((k, piece, at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
    rows = b.pack(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == expected and len(rows) == len(expected)
    free = []
    for length in sorted(lengths, reverse=True):
        fits = [k for k, f in enumerate(free) if f >= length]
        if fits:
            free[min(fits, key=lambda k: free[k])] -= length
        else:
            free.append(2048 - length)
    assert len({r.sequence_id for r in rows}) == len(free)


def bins_of(runs):
    bins = {}
    for length, _, count, first, offset, each in runs:
        for k in range(count):
            bins.setdefault(first + k // each, []).append((offset + k % each * length, length))
    return bins


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_is_gapless_and_no_worse_than_first_fit_by_more_than_a_bin(histogram):
    runs, window = b.plan(histogram, 64), 64
    bins = bins_of(runs)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    for length, n in histogram.items():
        mine = sorted((r[1], r[2]) for r in runs if r[0] == length)
        assert sum(c for _, c in mine) == n and all(a + c == d for (a, c), (d, _) in zip(mine, mine[1:], strict=False)) and mine[0][0] == 0
    free = []
    for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):  # best fit, item by item
        fits = [k for k, f in enumerate(free) if f >= length]
        if fits:
            free[min(fits, key=lambda k: free[k])] -= length
        else:
            free.append(window - length)
    assert len(bins) == len(free)


def test_packs_every_row(spark, awkward, nothing):
    rows = [r.asDict() for r in b.pack(awkward).collect()]
    assert len({r["doc_id"] for r in rows}) == 14 and b.pack(nothing).count() == 0
    own = b.Spellings(b.default_vocabulary())
    texts = {r.doc_id: r.text for r in awkward.collect()}
    for r in rows:
        ids = own.ids(texts[r["doc_id"]]) + bytes(4)
        part = ids[4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert (zlib.crc32(part), len(part) // 4) == (r["ids_crc32"], r["length"])
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048


def test_ranks_are_gapless_in_any_number_of_groups(spark):
    pieces = spark.createDataFrame([(k, 0, 0, k % 3, 7, k * 37 % 11) for k in range(200)], "doc_id long, piece int, start long, length long, ids_crc32 long, salt long")
    for groups in (1, 4):
        found = {}
        for r in b.ranked(pieces, groups).collect():
            found.setdefault(r.length, []).append(r["rank"])
        assert all(sorted(v) == list(range(len(v))) for v in found.values())


def test_sequences_round_trip(spark, awkward, nothing):
    """Every part of every sequence is its text's ids, ids repeated or null; every row of the table is there once."""
    from tallyspan.llm.shared import written

    docs = awkward.select("doc_id", "text")
    own, made = b.Spellings(b.default_vocabulary()), written(b.sequences(docs), "test-sequences")
    expected = sorted((r.doc_id or -1, own.ids(r.text) + bytes(4)) for r in docs.collect())
    found, place = {}, {}
    assert b.id_bytes(b.default_vocabulary()) == 2 and b.id_bytes(b.default_vocabulary(), 1 << 16) == 4
    for r in made.collect():
        at, ids = 0, np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()
        for p in r.parts:
            assert p.offset == at
            at += p.length
            found.setdefault((p.doc_id or -1, p.row_key), {})[p.start] = ids[4 * p.offset : 4 * at]
            place[p.row_key, p.piece] = (p.doc_id, p.start, p.length, r.sequence_id, p.offset)
        assert len(r.ids) == 2 * at <= 2 * 2048
    assert sorted((k[0], b"".join(v[s] for s in sorted(v))) for k, v in found.items()) == expected
    rows = b.digests(made).collect()
    assert {(r.row_key, r.piece): (r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in rows} == place and len(rows) == len(place)
    assert all(zlib.crc32(found[r.doc_id or -1, r.row_key][r.start]) == r.ids_crc32 for r in rows)
    assert b.sequences(nothing).count() == 0 and b.digests(b.sequences(nothing)).count() == 0


def test_pieces_carry_deflated_ids(spark):
    """Ids are shuffled twice on their way to a sequence, so they take well under the two bytes each that they have there."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = b.pieces_of(docs, with_ids=True).select("length", "ids").collect()
    assert sum(len(r.ids) for r in pieces) < 0.8 * 2 * sum(r.length for r in pieces)
    assert all(len(zlib.decompress(r.ids)) == 2 * r.length for r in pieces)
