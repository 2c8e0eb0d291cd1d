from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pytest

from tallyspan.llm import secret_scans as s
from tallyspan.llm.shared import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def field(spark):
    return s.fitted(table(spark, SF, "documents"), rows=100)


def plain(text):
    rules = [
        ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    ]
    return sorted([(m.start(), k, kind, m.end()) for k, (kind, rule, ok) in enumerate(rules) for m in rule.finditer(text or "") if ok(m)])


def test_base_equals_plain_search(spark, field, awkward):
    for frame in (awkward, table(spark, SF, "documents")):
        texts = {r.doc_id: r.text for r in frame.collect()}
        for r in s.scan(frame, field).collect():
            found = plain(texts[r.doc_id])
            listed = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found)
            assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[2] == k for x in found) for k in ("assign", "access", "hex"))
            assert {x for x in listed.split(",") if x} <= set(r.spans.split(","))


@pytest.mark.parametrize(("text", "secret"), [
    ("my password is hunter22x and so on", "hunter22x"), ("url postgres://bob:s3cr3tpw9@db.example.com/x here", "s3cr3tpw9"),
    ("take ghp_16C7e42F292c6912E7710c838347Ae178B4a from there", "ghp_16C7e42F292c6912E7710c838347Ae178B4a"),
])
def test_field_finds_more(field, text, secret):
    assert secret in [text[a:b] for a, b, _ in s.all_spans(text, s.Scorer(field))[1]]


@pytest.mark.parametrize("text", ["call +1 (487) 555-7209 or mail bob.55@mail9.example.com", "the token was lost and there is no password here", "see https://www.example.org/path/123.html for it", "", None])
def test_clean_texts_stay_clean(field, text):
    assert s.all_spans(text, s.Scorer(field)) == ([], [])


def plain_spans(text, field, weight):
    """Spans of a decode of the whole text, token by token."""
    found = [(m[0], *m.span()) for m in s.TOKEN.finditer(text)]
    rows = s.token_features([t for t, _, _ in found], s.file_features(text))
    states = field.best([weight(tuple(r)) for r in rows], False, False) if rows else []
    spans = []
    for (_, a, b), state in zip(found, states, strict=True):
        if state == 2 and spans and spans[-1][2]:
            spans[-1][1] = b
        elif state:
            spans.append([a, b, True])
        if not state and spans:
            spans[-1][2] = False
    return [(a, a + len(kept)) for a, b, _ in spans if (kept := text[a:b].rstrip(".,;:!?)]}\"'"))]


def test_every_token_counts_as_in_a_whole_decode(spark, field, monkeypatch):
    texts = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").collect() if r.text]
    odd = "token = ab12 x:y @ // is bearer Zx81kQ02mVb77TyU3k pass: hunter2x9 a1b2 .= http://u:p4ssw0rd@h key \n".split(" ")
    texts += [" ".join(odd[(k * j) % len(odd)] for j in range(60)) for k in range(1, 40)] + ["", " ", "x", "pass: a1b2c3d4"]
    monkeypatch.setattr(s, "alone", functools.cache(s.alone))
    weight = functools.cache(lambda row: field.weight(row).tolist())
    whole = s.Scorer(field)
    expected = [plain_spans(t, field, weight) for t in texts]
    assert [s.field_spans(t, whole) for t in texts] == expected and sum(map(len, expected)) > 100
    monkeypatch.setattr(s, "STRETCH", 37)
    monkeypatch.setattr(s, "REMEMBERED", 50)
    short = [(t, e) for t, e in zip(texts, expected, strict=True) if len(t) < 3000]
    cut = s.Scorer(field)
    assert [s.field_spans(t, cut) for t, _ in short] == [e for _, e in short]


def test_most_tokens_are_decided_at_once(spark, field):
    scorer = s.Scorer(field)
    text = " ".join(r.text for r in table(spark, SF, "documents").limit(50).collect() if r.text)
    tokens = s.TOKEN.findall(text)
    rest = np.asarray([field.weight([f"{f}:{k}" for f in s.file_features(text)]) for k in ("mixed", "value", "named", "other")])
    assert scorer.sure(scorer.scores(tokens, rest)).mean() > 0.5


def test_redaction(spark, field, awkward, nothing):
    out = s.redact(awkward, field)
    assert out.schema == awkward.schema and out.count() == awkward.count() and s.redact(nothing, field).count() == 0
    changed = [r for r in out.collect() if r.doc_id == 12]
    assert all("hunter2" not in r.text and "AKIA" not in r.text and "deadbeef" not in r.text and r.n_chars == len(r.text) for r in changed)
    assert {r.doc_id: r.text for r in out.collect() if r.doc_id != 12} == {r.doc_id: r.text for r in awkward.collect() if r.doc_id != 12}


def test_training_on_nothing(spark, nothing):
    assert s.scan(nothing, s.fitted(nothing)).count() == 0


def test_viterbi_is_the_best_path(field):
    import itertools

    rows = s.token_features("the token = ab12cd34ef56 ok".split(), s.file_features("plain"))
    score = [field.weight(r) for r in rows]
    moves = field.moves + field.LEGAL

    def total(path):
        return score[0][path[0]] + field.START[path[0]] + sum(moves[a, b] + score[k + 1][b] for k, (a, b) in enumerate(zip(path, path[1:], strict=False)))

    assert tuple(field.decode(rows)) == max(itertools.product(range(3), repeat=len(rows)), key=total)


def test_passages_cover_a_text():
    text = " ".join(f"w{k}" for k in range(1000)) + " " + "x" * 5000 + " end"
    found = list(s.passages(text))
    assert "".join(text[a:b] for a, b in found).replace(" ", "") == text.replace(" ", "") and len(found) == 18
    assert all(len(s.TOKEN.findall(text[a:b])) <= 64 for a, b in found) and list(s.passages("")) == []


def test_passages_are_drawn_over_all_texts(spark, monkeypatch):
    rows = [(k, f"{k} plain words. " + ("x " * 200 + "Zx81kQ02mVb77TyU3k ") * 8) for k in range(300)]
    taken = []
    monkeypatch.setattr(s, "train", lambda drawn: taken.extend(drawn))
    s.fitted(spark.createDataFrame(rows, "doc_id long, text string"), passages=100)
    assert len(taken) == 200 and sum("Zx81" in t for t, _, _ in taken) >= 90 and all(len(f) == 6 for _, _, f in taken)


def test_labels_of_passages_follow_the_text(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(s, "train", lambda drawn: taken.extend(drawn))
    text = "some words " * 40 + 'password = "hunter2hunter2" and deadbeefdeadbeef0123 ' + "more words " * 40
    s.fitted(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert sorted(t[a:b] for t, secrets, _ in taken for a, b in secrets) == ["deadbeefdeadbeef0123", "hunter2hunter2"]


@pytest.mark.parametrize(("text", "secret"), [("write it down: pass: hunter22xQ9z and go on", "hunter22xQ9z"), ("we found sk-aB3dE5fG7h9 in the log of that day", "sk-aB3dE5fG7h9")])
def test_short_secrets_are_found(field, text, secret):
    assert secret in [text[a:b] for a, b, _ in s.all_spans(text, s.Scorer(field))[1]]


def test_features_of_the_file():
    prose, code = s.file_features("Plain words of a text. " * 50), s.file_features("a = {1: 2};\n" * 50)
    assert len(prose) == len(code) and all(a != b for a, b in list(zip(prose, code, strict=True))[:4]) and s.file_features("")


def test_many_spans_in_one_text_take_no_square(field):
    import time

    began = time.process_time()
    base, every = s.all_spans("deadbeefdeadbeef0123 x9y8z7 " * 30_000, s.Scorer(field))
    assert len(base) == 30_000 and len(every) >= 30_000 and time.process_time() - began < 20


def test_redaction_of_overlapping_spans(field):
    text = 'password="deadbeefdeadbeef0123" tail'
    assert [x[2] for x in s.all_spans(text, s.Scorer(field))[0]] == ["assign", "hex"]
    out = s.redacted(text, s.Scorer(field))
    assert "deadbeef" not in out and out.endswith("tail") and out.count("[SECRET]") == 1
