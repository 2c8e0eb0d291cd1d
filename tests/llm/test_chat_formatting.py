from __future__ import annotations

import random
from functools import lru_cache

from tallyspan.llm import chat_formatting as c
from tallyspan.llm.shared import table

A = c.Automaton()


#: What may follow a start or a role, written out by hand.
AFTER = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def cheapest(roles):
    """The least cost of a legal conversation that has every given turn, by trying all ways.

    Costs: 2 for merging a turn into the one before, 5 for another role than given, 3 for an empty turn put in between.
    """

    @lru_cache(None)
    def least(k, last):
        if k == len(roles):
            return {"": 0, "assistant": 0, "user": 3, "system": 6}[last]
        found = []
        for role in ("system", "user", "assistant"):
            paid = 0 if role == roles[k] else 5
            if role == last:
                found.append(paid + 2 + least(k + 1, role))
            if role in AFTER[last]:
                found.append(paid + least(k + 1, role))
            if any(role in AFTER[between] for between in AFTER[last]):
                found.append(paid + 3 + least(k + 1, role))
        return min(found)

    return least(0, "")


def by_conversation(frame):
    found = {}
    for r in frame.collect():
        found.setdefault(r.conv_id, []).append(r)
    return {k: sorted(v, key=lambda r: (r.segment, r.piece)) for k, v in found.items()}


def paid(pieces):
    return sum(A.insert * (r.action == "insert") + A.relabel * ("relabel" in r.action) + A.merge * ("merge" in r.action) for r in pieces)


def test_repairs_are_legal_and_cheapest_in_any_segments(spark):
    draw = random.Random(8)
    rows = [(k, t, draw.choice(("user", "assistant", "user", "assistant", "system", "tool", None)), f"t{t}") for k in range(80) for t in range(draw.randint(1, 10))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for segment in (3, 4096):
        for k, pieces in by_conversation(c.format_chats(frame, segment=segment)).items():
            mine = [r for r in rows if r[0] == k]
            roles = [r.new_role for r in pieces if "merge" not in r.action]
            assert all(pair in A.follows for pair in zip(["", *roles], roles, strict=False)) and roles[-1] == "assistant"
            assert paid(pieces) == cheapest(tuple(r[2] for r in mine))
            assert [r.turn for r in pieces if r.action != "insert"] == [r[1] for r in mine]
            text = "".join(r.rendered for r in pieces)
            assert text.count("<|end|>") == len(roles) and text.endswith("<|end|>\n") and all(r[3] in text for r in mine)


def test_rendering(spark):
    frame = spark.createDataFrame([(1, 0, "user", "Hi"), (1, 1, "user", "there"), (1, 2, "assistant", "Yes")], "conv_id long, turn long, role string, text string")
    text = "".join(r.rendered for r in by_conversation(c.format_chats(frame))[1])
    assert text == "<|user|>\nHi\nthere<|end|>\n<|assistant|>\nYes<|end|>\n"


def test_awkward_tables(spark):
    frame = spark.createDataFrame([(None, 0, "user", "a", 1), (1, None, None, None, 1), (1, 0, "user", "", 1), (1, 0, "user", "", 1), (2, 5, "assistant", "x" * 200_000, 1)], "conv_id long, turn long, role string, text string, piece long")
    found = by_conversation(c.format_chats(frame))
    assert set(found) == {None, 1, 2} and sum(r.action != "insert" for v in found.values() for r in v) == 5
    assert c.format_chats(frame.limit(0)).count() == 0


def test_query_covers_every_turn(spark):
    sf = "/root/testdata/sf0.001"
    rows = c.op8_chat_formatting(spark, sf).where("action <> 'insert'")
    assert rows.count() == table(spark, sf, "conversations").count()


def test_rules_without_a_way_are_refused():
    import pytest

    with pytest.raises(ValueError, match="cannot be repaired"):
        c.Automaton(follows=(("", "user"),), ends=("assistant",))
    with pytest.raises(ValueError, match="cannot be repaired"):
        c.Automaton(roles=("user", "assistant"), follows=(("user", "assistant"),))
    assert c.Automaton(roles=("user",), follows=(("", "user"),), ends=("user",)).finish()[1] == (0, [])


def test_ids_of_other_types(spark):
    frame = spark.createDataFrame([("a", 0, "user", "Hi"), ("a", 1, "assistant", "Yes"), ("7", 0, "tool", "x"), (None, 0, "user", "y")], "conv_id string, turn long, role string, text string")
    found = by_conversation(c.format_chats(frame))
    assert set(found) == {"a", "7", None} and "".join(r.rendered for r in found["a"]).count("<|end|>") == 2


def test_hot_turns_are_spread_and_lose_nothing(spark):
    """Many rows of one turn number, without a number and without a conversation, equal ones among them: the same cost as in one piece."""
    draw = random.Random(3)
    rows = [(1, 5, draw.choice(("user", "assistant", None)), f"t{k}") for k in range(150)] + [(1, None, "user", "same")] * 90 + [(None, None, draw.choice(("user", "system")), draw.choice(("x", f"y{k}"))) for k in range(120)]
    rows += [(2, k, draw.choice(("user", "assistant")), f"u{k}") for k in range(40)] + [(1, k, "assistant", f"v{k}") for k in range(12)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    marked = c.spread(frame.withColumn("mark", c.F.xxhash64("text")), 8)
    sizes = [r["count"] for r in marked.groupBy("conv_id", "segment").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 30
    one, two = (by_conversation(c.format_chats(frame, segment=s)) for s in (8, 4096))
    for conv in (1, 2, None):
        assert paid(one[conv]) == paid(two[conv])
        text = lambda pieces: [(r.turn, r.role, r.rendered.strip("\n")) for r in pieces if r.action != "insert"]
        assert len(text(one[conv])) == len(text(two[conv])) == sum(r[0] == conv for r in rows)
        assert [x[:2] for x in text(one[conv])] == [x[:2] for x in text(two[conv])]
        roles = [r.new_role for r in one[conv] if "merge" not in r.action]
        assert all(pair in A.follows for pair in zip(["", *roles], roles, strict=False)) and roles[-1] == "assistant"
        assert [r.segment for r in one[conv]] == sorted(r.segment for r in one[conv])
