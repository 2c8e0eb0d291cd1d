"""Secret scans: fixed base patterns, and a linear-chain conditional random field that adds spans.

The field tags tokens as outside (O), begin (B) or inside (I) of a secret from the token's shape, the words around it
and features of the whole text; Viterbi decodes it. It is trained here, on sentences generated from publicly documented
shapes of secrets and of harmless look-alikes, and on passages of at most ``SAMPLE_ROWS`` documents in which the base
patterns give the labels. At most ``PASSAGES`` passages of at most ``PASSAGE_TOKENS`` tokens and ``PASSAGE_CHARS`` characters
are taken with something that mixes letters and digits, and as many without, drawn evenly over all passages of these documents.

Every token of every text is scored. What a token's score takes from the token itself is worked out once a spelling; what it
takes from its neighbours and its text is added for a whole stretch at once. Where O is ahead by more than any change of
transitions could make up for, every best path is at O (``Field.slack``), so the path is looked for between such tokens alone
and is the one of the whole text.

Defined results: null and empty texts have no spans; spans are code points, end exclusive; repeated rows are scanned
alike; texts of any length are read whole; an empty table gives an empty result; extra columns are not carried along.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan.llm.shared import sampled_ids, table

#: Bounds of what the field is trained on.
SAMPLE_ROWS = 1000
PASSAGES = 400
PASSAGE_TOKENS = 64
PASSAGE_CHARS = 2000
#: Spellings that a Python worker remembers, and characters that are tokenized at a time.
REMEMBERED, REMEMBERED_CHARS = 120_000, 4_000_000
STRETCH = 250_000
KINDS = ("assign", "access", "hex", "crf")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Runs that may hold a hexadecimal one; looked for at their beginnings only.
LONG = re.compile(r"(?<![A-Za-z0-9+/_=\-])[A-Za-z0-9+/_=\-]{16,}")

GAP = re.compile(r"\s")
TOKEN = re.compile(r"[\w+/.\-]+={0,2}|[^\s\w+/.\-]")
NAMES = re.compile(r"(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|bearer|auth[_-]?key|client[_-]?secret)=?s?", re.IGNORECASE)
#: Names as whole tokens only: they are parts of many other words.
SHORT_NAMES = re.compile(r"(?:pass|pin|login|key)=?", re.IGNORECASE)
# Publicly documented beginnings of issued keys.
PREFIXES = ("ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "rk_live_", "sk-", "xoxb-", "xoxp-", "xoxa-", "AKIA", "ASIA", "AIza", "ya29.", "eyJ", "SG.", "npm_", "pypi-", "dop_v1_", "hf_")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, in order of start, then of kind."""
    lower, found = text.lower(), []
    if any(w in lower for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    for run in LONG.finditer(text):
        found += [(m.start() + run.start(), m.end() + run.start(), "hex") for m in HEX.finditer(run[0])]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def shape(token: str) -> str:
    """Classes of characters, runs joined, at most six."""
    kinds = re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", token)
    return re.sub(r"(.)\1+", r"\1", re.sub(r"\d", "0", kinds))[:6]


def mixed(token: str) -> bool:
    """Long and not an ordinary word: digits among letters, or capitals inside."""
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    inner = sum(a.islower() and b.isupper() for a, b in zip(token, token[1:], strict=False))
    return bool(digits and letters) or inner >= 3


def file_features(text: str) -> list[str]:
    """Features of the whole text, in steps: signs of code, digits, length of lines, assignments, addresses, key material."""
    size = max(1, len(text))
    lines = text.count("\n") + 1

    def step(count: int, per: int) -> int:
        """0 for none, 1 while they are rarer than four in ``per`` characters, then a step for each fourfold density, 4 at most."""
        return next((k for k in (1, 2, 3) if count * per < size * 4**k), 4) if count else 0

    return [
        f"file:signs:{step(sum(text.count(c) for c in '={};'), 200)}", f"file:assignments:{step(text.count('=') + text.count(': '), 200)}",
        f"file:lines:{min(4, int(np.log2(size / lines) / 2))}", f"file:digits:{step(sum(text.count(c) for c in '0123456789'), 100)}",
        f"file:links:{min(2, text.count('://'))}", f"file:armour:{'-----BEGIN' in text}",
    ]


@dataclass(frozen=True, slots=True)
class Alone:
    """What is known of a token by itself."""

    features: tuple[str, ...]
    name: bool
    mixed: bool  # long, with digits among letters or capitals inside
    value: bool  # may be a password
    assigns: bool  # after it comes a value
    leads: bool  # right after it comes a value
    at: bool
    colon: bool
    slashes: bool
    before: str  # how it is seen by the token after it
    after: str  # how it is seen by the token before it


def named_by(t: str) -> bool:
    """Whether a token is a name that secrets are given under, or a longer word with one in it."""
    low = t.lower()
    if not ("pass" in low or "pwd" in low or "secret" in low or "token" in low or "key" in low or "credential" in low or "bearer" in low or "pin" in low or "login" in low):
        return False  # none of the names is in it
    found = NAMES.search(t)
    return bool(found and (len(t) < 28 or NAMES.fullmatch(t.strip("=._-")))) or bool(SHORT_NAMES.fullmatch(t))


@cache
def word_alone(length: int, variety: int, name: bool, leads: bool) -> Alone:
    """What is known of a short token of letters alone; few such are told apart."""
    row = ("bias", f"len:{length}", "shape:word", f"variety:{variety}", f"name:{name}", "kind:letters", "mixed:False", "value:False")
    return Alone(row, name, False, False, False, leads, False, False, False, "word", "word")


def alone(t: str) -> Alone:
    n = len(t)
    if n < 12 and t.isalpha():
        return word_alone(n // 4, len(set(t)) // 4, named_by(t), n < 7 and t.lower() in ("is", "bearer"))
    core = t.strip("._-=/")
    n, several = len(core), len(set(core))
    digits, letters = sum(map(str.isdigit, core)), sum(map(str.isalpha, core))
    name = not digits and named_by(t)
    is_mixed = n >= 16 and mixed(core)
    value = bool(n >= 6 and digits and letters)
    row = [
        "bias", f"len:{min(n, 40) // 4}", "shape:word" if n < 12 and letters == n else f"shape:{shape(core)}" if n < 12 else "shape:long", f"variety:{min(several, 24) // 4}", f"name:{name}",
        f"kind:{'digits' if digits == n else 'letters' if letters == n else 'both' if digits and letters else 'signs'}", f"mixed:{is_mixed}", f"value:{value}",
    ]
    row += ["hexadecimal"] if n >= 16 and digits and letters and all(c in "0123456789abcdefABCDEF" for c in core) else []
    row += ["issued"] if n >= 10 and core.startswith(PREFIXES) and mixed(core) else []
    row += ["dotted"] if "." in core and not digits else []
    row += ["card"] if digits == n and 12 <= n <= 19 else []
    word = len(t) > 2 or t.isalnum()
    return Alone(tuple(row), name, is_mixed, value, t in ":=" or t.endswith("="), t.lower() in ("is", "bearer"), t == "@", t == ":", t.startswith("//"), "word" if word else t, "word" if word else t)


def around(named: bool, assigned: bool, value: bool, address: bool, in_url: bool, login: bool) -> list[str]:
    """Features of a token's neighbourhood."""
    row = [f"named:{named}", f"named+assigned:{named and assigned}", f"value+named+assigned:{value and named and assigned}"]
    return [*row, *(["address"] if address else []), *(["in url"] if in_url else []), *(["login"] if login else [])]


def kind_of(mixed: bool, value: bool, named: bool) -> str:
    """Which tokens share the weights of a feature of the text."""
    return "mixed" if mixed else "value" if value else "named" if named else "other"


def token_features(tokens: list[str], of_file: list[str]) -> list[list[str]]:
    """The features of every token of a text, one by one; ``Scorer`` gives their weights all at once."""
    known = [alone(t) for t in tokens]
    rows = []
    for i, t in enumerate(known):
        named = any(k.name for k in known[max(0, i - 4) : i])
        assigned = any(k.assigns for k in known[max(0, i - 3) : i]) or (i > 0 and known[i - 1].leads)
        address = (i > 0 and known[i - 1].at) or (i + 1 < len(known) and known[i + 1].at)
        in_url = i > 0 and known[i - 1].colon and t.slashes
        login = i > 0 and known[i - 1].colon and i + 1 < len(known) and known[i + 1].at
        before, after = known[i - 1].before if i else "word", known[i + 1].after if i + 1 < len(known) else "word"
        kind = kind_of(t.mixed, t.value, named)
        rows.append([*t.features, f"prev:{before}", f"next:{after}", *around(named, assigned, t.value, address, in_url, login), *(f"{f}:{kind}" for f in of_file)])
    return rows


@dataclass
class Field:
    """Weights of a linear-chain conditional random field over the states O, B, I."""

    names: dict[str, int]
    weights: np.ndarray  # feature, state
    moves: np.ndarray  # from, to

    START = np.asarray([0.0, 0.0, -1e6])
    LEGAL = np.asarray([[0.0, 0.0, -1e6], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])

    @classmethod
    def fit(cls, sequences: list[tuple[list[list[str]], list[int]]], steps: int = 80, penalty: float = 0.02) -> Field:
        """Maximum penalised likelihood by Adam, gradients by forward-backward over all sequences at once."""
        names: dict[str, int] = {}
        lengths = np.asarray([len(y) for _, y in sequences])
        longest, many = int(lengths.max()), len(sequences)
        place, feature = [], []
        gold = np.zeros((many, longest, 3))
        for s, (rows, labels) in enumerate(sequences):
            for t, (row, label) in enumerate(zip(rows, labels, strict=True)):
                gold[s, t, label] = 1
                for f in row:
                    place.append(s * longest + t)
                    feature.append(names.setdefault(f, len(names)))
        at, of = np.asarray(place), np.asarray(feature)
        weights, moves = np.zeros((len(names), 3)), np.zeros((3, 3))
        live = np.arange(longest)[None, :] < lengths[:, None]
        gold_moves = np.einsum("ntj,ntk->jk", gold[:, :-1], gold[:, 1:])
        first, second = [np.zeros_like(weights), np.zeros_like(moves)], [np.zeros_like(weights), np.zeros_like(moves)]
        for step in range(1, steps + 1):
            scores = np.stack([np.bincount(at, weights[of, k], many * longest) for k in range(3)], 1).reshape(many, longest, 3)
            unary, pair = cls._marginals(scores, moves + cls.LEGAL, live)
            gap = (gold - unary * live[:, :, None]).reshape(-1, 3)
            up = np.stack([np.bincount(of, gap[at, k], len(names)) for k in range(3)], 1) - penalty * weights
            gradients = (up, gold_moves - pair - penalty * moves)
            for k, (target, g) in enumerate(zip((weights, moves), gradients, strict=True)):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                target += 0.2 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return cls(names, weights, moves)

    @classmethod
    def _marginals(cls, scores: np.ndarray, moves: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected states and moves of all sequences, by scaled forward and backward sums."""
        many, longest, _ = scores.shape
        odds = np.exp(scores - scores.max(2, keepdims=True))
        step = np.exp(np.maximum(moves, -700))
        ahead, back, scale = np.empty_like(odds), np.ones_like(odds), np.ones((many, longest, 1))
        now = odds[:, 0] * np.exp(np.maximum(cls.START, -700))
        for t in range(longest):
            if t:
                now = (ahead[:, t - 1] @ step) * odds[:, t]
            scale[:, t] = now.sum(1, keepdims=True)
            ahead[:, t] = now / scale[:, t]
        for t in range(longest - 2, -1, -1):
            reach = ((odds[:, t + 1] * back[:, t + 1]) @ step.T) / scale[:, t + 1]
            back[:, t] = np.where(live[:, t + 1, None], reach, 1)
        follow = odds[:, 1:] * back[:, 1:] / scale[:, 1:] * live[:, 1:, None]
        return ahead * back, step * np.einsum("ntj,ntk->jk", ahead[:, :-1], follow)

    def weight(self, features) -> np.ndarray:
        """The summed weights of features, a number a state; unknown ones weigh nothing."""
        return self.weights[[self.names[f] for f in features if f in self.names]].sum(0)

    def slack(self) -> tuple[float, float]:
        """The most that transitions can lose where a secret is cut by setting one of its tokens to O.

        The first number where the token after it is not inside; the second where it is, which then begins a secret.
        """
        m = self.moves + self.LEGAL
        most = [-np.inf, -np.inf]
        for p, k, n, x in product((None, 0, 1, 2), (1, 2), (None, 0, 1, 2), (None, 0, 1, 2)):
            to = 1 if n == 2 else n

            def total(a: int, b: int | None, p=p, x=x) -> float:
                first = self.START[a] if p is None else m[p, a]
                return float(first + (0 if b is None else m[a, b] + (0 if x is None else m[b, x])))

            old = total(k, n)
            if old > -1e5:
                most[n == 2] = max(most[n == 2], old - total(0, to))
        return most[0], most[1]

    def best(self, scores: list[list[float]], before: bool, after: bool) -> list[int]:
        """The best state sequence by Viterbi; ``before`` and ``after``: whether a token at O stands there."""
        m = (self.moves + self.LEGAL).tolist()
        o, b, i = scores[0]
        now = (o + m[0][0], b + m[0][1], i + m[0][2]) if before else (o, b, i + float(self.START[2]))
        back = []
        (oo, ob, oi), (bo, bb, bi), (io, ib, ii) = m
        for o, b, i in scores[1:]:
            x, y, z = now
            to_o = max((x + oo, 0), (y + bo, -1), (z + io, -2))
            to_b = max((x + ob, 0), (y + bb, -1), (z + ib, -2))
            to_i = max((x + oi, 0), (y + bi, -1), (z + ii, -2))
            back.append((-to_o[1], -to_b[1], -to_i[1]))
            now = (to_o[0] + o, to_b[0] + b, to_i[0] + i)
        ends = [v + m[k][0] for k, v in enumerate(now)] if after else list(now)
        state = ends.index(max(ends))
        path = [state]
        for pointers in reversed(back):
            state = pointers[state]
            path.append(state)
        return path[::-1]

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The best state sequence of a whole text from its tokens' features."""
        return self.best([self.weight(row).tolist() for row in rows], False, False) if rows else []


class Scorer(dict):
    """Maps spellings to rows of what is known of them; scores stretches of tokens with their neighbours."""

    def __init__(self, field: Field) -> None:
        self.field = field
        self.slack = field.slack()
        self.near = np.asarray([field.weight(around(*(bool(code >> k & 1) for k in range(6)))) for code in range(64)])
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.chars = 0
        self.kinds: dict[Alone, int] = {}  # spellings of which the same is known share a row
        self.places: dict[int, int] = {}  # rows of what ``word_alone`` keeps for good
        self.own, self.before, self.after = (np.zeros((1024, 3)) for _ in range(3))
        self.flags = np.zeros(1024, np.int64)

    def __missing__(self, token: str) -> int:
        t = alone(token)
        k = self.places.get(id(t))  # short words of one kind are one object
        if k is None:
            k = self.kinds.get(t)
        if k is None:
            k = self.kinds[t] = len(self.kinds)
            if k == len(self.flags):
                for name in ("own", "before", "after", "flags"):
                    old = getattr(self, name)
                    setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
            self.own[k] = self.field.weight(t.features)
            self.before[k], self.after[k] = self.field.weight([f"prev:{t.before}"]), self.field.weight([f"next:{t.after}"])
            if len(token) < 12 and token.isalpha():
                self.places[id(t)] = k
            self.flags[k] = sum(v << j for j, v in enumerate((t.name, t.mixed, t.value, t.assigns, t.leads, t.at, t.colon, t.slashes)))
        self[token] = k
        self.chars += len(token)
        return k

    def scores(self, tokens: list[str], of_file: np.ndarray) -> np.ndarray:
        """(token, state) sums of weights; ``of_file``: the weights of the text's features by kind of token."""
        ids = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        flags = self.flags[ids]
        name, mixed, value, assigns, leads, at, colon, slashes = ((flags >> j & 1).astype(bool) for j in range(8))

        def among(seen: np.ndarray, last: int) -> np.ndarray:
            """Whether one of the ``last`` tokens before is such."""
            total = np.concatenate([[0], np.cumsum(seen)])
            k = np.arange(len(seen))
            return total[k] > total[np.maximum(0, k - last)]

        named, assigned = among(name, 4), among(assigns, 3) | among(leads, 1)
        behind = np.append(at[1:], False)  # whether the next token is such
        colon = among(colon, 1)
        code = named + 2 * assigned + 4 * value + 8 * (among(at, 1) | behind) + 16 * (colon & slashes) + 32 * (colon & behind)
        kind = np.where(mixed, 0, np.where(value, 1, np.where(named, 2, 3)))
        found = self.own[ids] + self.near[code] + of_file[kind]
        word = self["x"]
        found[1:] += self.before[ids[:-1]]
        found[:-1] += self.after[ids[1:]]
        found[0] += self.before[word]
        found[-1] += self.after[word]
        return found

    def sure(self, scores: np.ndarray) -> np.ndarray:
        """Tokens at which every best path of the whole text is at O; the last one needs no follower."""
        ahead = scores[:, 0] - np.maximum(scores[:, 1], scores[:, 2])
        follower = np.zeros(len(scores))
        follower[:-1] = scores[1:, 1] - scores[1:, 2]
        return (ahead > self.slack[0] + 1e-6) & (ahead + follower > self.slack[1] + 1e-6)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """The spans that the best path of the whole text tags."""
        if len(self) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        of_text = file_features(text)
        of_file = np.asarray([self.field.weight([f"{f}:{kind}" for f in of_text]) for kind in ("mixed", "value", "named", "other")])
        found: list[tuple[int, int]] = []
        held: list[tuple[list[float], int, int]] = []  # (scores, start, end) of the open run of tokens that are not sure
        led = False  # whether a token at O stands before the run

        def close(after: bool) -> None:
            if held:
                now: list[int] | None = None
                for state, (_, a, b) in zip(self.field.best([x[0] for x in held], led, after), held, strict=True):
                    if state == 2 and now:
                        now[1] = b
                        continue
                    if now:
                        found.append((now[0], now[1]))
                    now = [a, b] if state else None
                if now:
                    found.append((now[0], now[1]))
                held.clear()

        past: list[str] = []  # the tokens before the stretch that its tokens look at
        for start, end in stretches(text):
            tokens = TOKEN.findall(text, start, end)
            if not tokens:
                continue
            last = end == len(text)
            ahead = [] if last else [m[0] for m, _ in zip(TOKEN.finditer(text, end), range(2), strict=False)]
            scores = self.scores([*past, *tokens, *ahead], of_file)
            sure = self.sure(scores)[len(past) : len(past) + len(tokens)]
            scores = scores[len(past) : len(past) + len(tokens)]
            if not sure.all():
                spans = None
                for k in np.flatnonzero(~sure).tolist():
                    if spans is None:
                        spans = [m.span() for m in TOKEN.finditer(text, start, end)]
                        previous = -1
                    if k > previous + 1:
                        close(True)
                        led = True
                    held.append((scores[k].tolist(), *spans[k]))
                    previous = k
                if previous < len(tokens) - 1:
                    close(True)
                    led = True
            else:
                close(True)
                led = True
            past = [*past, *tokens][-4:]
        close(False)
        return found


def stretches(text: str, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Parts of a text of about ``size`` characters, cut before white space."""
    size, start = size or STRETCH, 0
    while start < len(text):
        end = min(len(text), start + size)
        gap = GAP.search(text, end)
        end = gap.start() if gap else len(text)
        yield start, end
        start = end


def field_spans(text: str, scorer: Scorer) -> list[tuple[int, int]]:
    """Spans that the field tags, without closing signs."""
    return [(a, a + len(kept)) for a, b in scorer.spans(text) if (kept := text[a:b].rstrip(".,;:!?)]}\"'"))]


def all_spans(text: str | None, scorer: Scorer) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans: the field's are added where no base span holds them."""
    if not text:
        return [], []
    base = base_spans(text)
    starts, ends = [x[0] for x in base], list(accumulate((x[1] for x in base), max))
    added = [(a, b, "crf") for a, b in field_spans(text, scorer) if not (k := bisect_right(starts, a)) or ends[k - 1] < b]
    return base, sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def made_sentences(count: int = 800, seed: int = 7) -> list[list[tuple[str, int]]]:
    """Generated training sentences: pieces of text with 1 where they are a secret."""
    draw = random.Random(seed)
    mixed_letters = string.ascii_letters + string.digits
    plain = "the value was used for a new service and we set it in our file then run all tests with an old name of this page".split()

    def some(letters: str, least: int, most: int) -> str:
        return "".join(draw.choice(letters) for _ in range(draw.randint(least, most)))

    def filler(least: int = 1, most: int = 7) -> str:
        return " ".join(draw.choice(plain) if draw.random() < 0.7 else some(string.ascii_lowercase, 2, 14) for _ in range(draw.randint(least, most)))

    def secret() -> str:
        return draw.choice([
            lambda: draw.choice(("ghp_", "gho_", "npm_", "hf_", "sk_live_", "sk_test_")) + some(mixed_letters, 24, 36),
            lambda: draw.choice(("xoxb-", "xoxp-")) + some(string.digits, 10, 12) + "-" + some(mixed_letters, 18, 24),
            lambda: "AIza" + some(mixed_letters + "-_", 35, 35), lambda: "eyJ" + some(mixed_letters, 20, 40) + "." + some(mixed_letters, 20, 60) + "." + some(mixed_letters + "-_", 20, 43),
            lambda: some(mixed_letters + "+/", 40, 40), lambda: some("0123456789abcdef", 32, 40), lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16, 16),
            lambda: "glpat-" + some(mixed_letters, 20, 20), lambda: some(mixed_letters, 24, 48), lambda: "sk-" + some(mixed_letters, 11, 24),
        ])()

    def password() -> str:
        return some(string.ascii_lowercase, 2, 6) + some(string.digits, 1, 4) + some(mixed_letters, 2, 8)

    def harmless() -> str:
        return draw.choice([
            lambda: some(string.digits, 16, 16), lambda: f"{some(string.ascii_lowercase, 4, 10)}.{some(string.digits, 1, 3)}@{some(string.ascii_lowercase, 4, 9)}{some(string.digits, 1, 1)}.example.com",
            lambda: f"https://www.{some(string.ascii_lowercase, 5, 12)}.example.org/{some(string.ascii_lowercase, 4, 10)}/{some(string.digits, 2, 5)}.html", lambda: f"+1 ({some(string.digits, 3, 3)}) {some(string.digits, 3, 3)}-{some(string.digits, 4, 4)}",
            lambda: "".join(some(string.ascii_lowercase, 3, 8).capitalize() for _ in range(4)), lambda: "_".join(some(string.ascii_lowercase, 3, 8) for _ in range(4)), lambda: f"20{some(string.digits, 2, 2)}-0{draw.randint(1, 9)}-1{draw.randint(0, 9)}T1{draw.randint(0, 9)}:00:00",
            lambda: f"v{draw.randint(1, 9)}.{draw.randint(0, 20)}.{draw.randint(0, 20)}", lambda: some(string.ascii_lowercase, 16, 30), lambda: some(string.ascii_uppercase, 16, 30), lambda: f"{some(string.digits, 1, 3)}.{some(string.digits, 1, 3)}.{some(string.digits, 1, 3)}.{some(string.digits, 1, 3)}",
            lambda: f"DejaVuSans{some(string.ascii_lowercase, 4, 8).capitalize()}Regular2.ttf", lambda: f"{some(string.ascii_lowercase, 4, 9)}-{some(string.ascii_lowercase, 4, 9)}-{some(string.ascii_lowercase, 4, 9)}-{draw.randint(10, 2030)}",
        ])()

    names = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "API-KEY", "access_key", "client_secret", "Password", "SECRET", "TOKEN", "pass", "pin", "login", "passphrase")
    sentences = []
    for _ in range(count):
        pieces = [(filler(), 0)]
        for _ in range(draw.randint(1, 3)):
            quote, name, kind = draw.choice(("", '"', "'")), draw.choice(names), draw.random()
            if kind < 0.25:
                pieces += [(f" {name}{draw.choice((' = ', '=', ': ', ':', ' : '))}{quote}", 0), (draw.choice((secret, password, password))(), 1), (f"{quote} ", 0)]
            elif kind < 0.4:
                pieces += [(" ", 0), (secret(), 1), (" ", 0)]
            elif kind < 0.46:
                pieces += [(f" {name} is ", 0), (password(), 1), (" ", 0)]
            elif kind < 0.52:
                pieces += [(f" Authorization: Bearer ", 0), (secret(), 1), (" ", 0)]
            elif kind < 0.57:
                pieces += [(f" {draw.choice(('postgres', 'mysql', 'amqp', 'https'))}://{some(string.ascii_lowercase, 3, 8)}:", 0), (password(), 1), (f"@{some(string.ascii_lowercase, 3, 9)}.example.com/{some(string.ascii_lowercase, 3, 9)} ", 0)]
            elif kind < 0.8:
                pieces += [(f" {harmless()} ", 0)]
            else:
                pieces += [(f" {draw.choice(('the', 'a', 'no', 'your'))} {name} {filler(2, 6)}. ", 0)]
            pieces.append((filler(), 0))
        sentences.append(pieces)
    return sentences


def labelled(text: str, secrets: list[tuple[int, int]], of_file: list[str]) -> tuple[list[list[str]], list[int]]:
    """Features and states of a passage: a token is begin or inside by its overlap with a secret."""
    tokens = [(m[0], m.start(), m.end()) for m in TOKEN.finditer(text)]
    states, last = [], None
    for _, a, b in tokens:
        mine = next((k for k, (s, e) in enumerate(secrets) if a < e and s < b), None)
        states.append(0 if mine is None else 2 if mine == last else 1)
        last = mine
    return token_features([t for t, _, _ in tokens], of_file), states


def passages(text: str, at_a_time: int = PASSAGE_TOKENS, most_chars: int = PASSAGE_CHARS) -> Iterator[tuple[int, int]]:
    """All passages of a text: consecutive tokens, at most so many and so long."""
    start, end, n = 0, 0, 0
    for m in TOKEN.finditer(text):
        if n and (n == at_a_time or m.end() - start > most_chars):
            yield start, end
            n = 0
        if not n:
            start = m.start()
        end, n = m.end(), n + 1
    if n:
        yield start, end


VALUE = re.compile(r"[^\W\d_][+/_=.\-]*\d|\d[+/_=.\-]*[^\W\d_]")


def labels_of(text: str) -> list[tuple[int, int]]:
    """The base patterns' secrets: of an assignment its value."""
    return sorted([m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] + [x[:2] for x in base_spans(text) if x[2] != "assign"])


def drawer(most: int):
    """(id, text) to (odd, draw, passage, starts, ends, features): of each text those ``most`` of either sort that come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                of_file, secrets = file_features(text), labels_of(text)
                kinds: dict[bool, list] = {False: [], True: []}
                for start, end in passages(text):
                    draw = int.from_bytes(hashlib.md5(f"{number}:{start}".encode()).digest()[:7], "big")
                    kinds[bool(VALUE.search(text, start, end))].append((draw, start, end))
                for odd, found in kinds.items():
                    for draw, start, end in sorted(found)[:most]:
                        mine = [(max(a, start) - start, min(b, end) - start) for a, b in secrets if a < end and start < b]
                        rows.append((odd, draw, text[start:end], [a for a, _ in mine], [b for _, b in mine], of_file))
            kinds_of = (pa.bool_(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds_of, strict=True)], names=["odd", "draw", "passage", "starts", "ends", "features"])

    return run


def train(drawn: list[tuple[str, list[tuple[int, int]], list[str]]] = ()) -> Field:
    """Fits the field on generated sentences and on (passage, secrets, features of its text)."""
    sequences = []
    kinds = [file_features("plain words of a text that goes on like this. " * 20), file_features("a = 1;\nb: {2}\n" * 20)]
    for k, pieces in enumerate(made_sentences()):
        text, secrets = "", []
        for piece, secret in pieces:
            if secret:
                secrets.append((len(text), len(text) + len(piece)))
            text += piece
        sequences.append(labelled(text, secrets, kinds[1] if k % 3 == 0 else kinds[0]))
    sequences += [labelled(text, secrets, of_file) for text, secrets, of_file in drawn]
    return Field.fit([x for x in sequences if x[0]])


def scanner(field: Field):
    """(doc_id, text) to counts and span lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(field)
        for batch in batches:
            counts, digests, lists = {k: [] for k in KINDS[:3]}, [], []
            for text in batch.column(1):
                base, every = all_spans(text.as_py(), scorer)
                for kind in KINDS[:3]:
                    counts[kind].append(sum(s[2] == kind for s in base))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                lists.append(listed(every))
            columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts.values()], pa.array(digests, pa.string()), pa.array(lists, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def fitted(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows: int = SAMPLE_ROWS, passages: int = PASSAGES) -> Field:
    """The field trained on passages of at most ``rows`` documents; only passages reach the driver."""
    drawn = sampled_ids(documents, rows, id_column, text_column).mapInArrow(drawer(passages), "odd boolean, draw long, passage string, starts array<long>, ends array<long>, features array<string>")
    found = [r for odd in (True, False) for r in drawn.where(F.col("odd") == odd).orderBy("draw", "passage").limit(passages).collect()]
    return train([(r["passage"], [*zip(r["starts"], r["ends"], strict=True)], r["features"]) for r in found])


def scan(documents: DataFrame, field: Field, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row: doc_id, n_assign, n_access, n_hex, base_sha256 and spans."""
    source = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(scanner(field), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str | None, scorer: Scorer, mark: str = "[SECRET]") -> str | None:
    """The text with every span replaced; of overlapping spans the union goes."""
    out, at = [], 0
    for start, end, _ in all_spans(text, scorer)[1]:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact(documents: DataFrame, field: Field, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``documents``, secrets replaced in the text and the length column following it."""
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(field)
        for batch in batches:
            k = names.index(text_column)
            old = batch.column(k).to_pylist()
            new = [redacted(t, scorer) for t in old]
            columns = list(batch.columns)
            columns[k] = pa.array(new, batch.schema.field(k).type)
            if length_column in names:
                n = names.index(length_column)
                kept = batch.column(n).to_pylist()
                columns[n] = pa.array([v if a == b else len(b) for v, a, b in zip(kept, old, new, strict=True)], batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return documents.mapInArrow(run, documents.schema)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return scan(documents, fitted(documents))
