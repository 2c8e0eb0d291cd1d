from __future__ import annotations

import re

from tallyspan.llm import quality_rules as q
from tests.oracle import FOLDER, same


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + d for i, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_plain_counts(spark, awkward):
    more = spark.createDataFrame([(100, "a b c a b c x y z"), (101, "l one\nl one\n\nl two\n l one"), (102, " ".join(f"w{k % 40}" for k in range(400)))], "doc_id long, text string")
    for frame in (awkward.where("doc_id is null or doc_id <> 10"), more):
        for r, text in zip(q.judge(frame).collect(), [x.text for x in frame.collect()], strict=True):
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(text)


def test_long_and_many_repeats(spark):
    text = " ".join(f"w{k % 5000}" for k in range(10_000))
    r = q.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_repeat_words == 10_000 and r.base_failed


def test_verdicts(spark, awkward, nothing):
    good = " ".join(f"the {chr(97 + k % 26)}hing{k} was x{k} of" for k in range(30)) + "."
    frame = spark.createDataFrame([(1, good), (2, good + " ##### $$$$$" * 40), (3, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in q.judge(frame).collect()}
    assert found[1].kept and not found[2].kept and found[3].base_failed
    assert q.judge(awkward).count() == awkward.count() and q.judge(nothing).count() == 0


def test_equals_sql(spark):
    assert same(spark, q.op1_quality_rules, q.oracle(), FOLDER) == 200
