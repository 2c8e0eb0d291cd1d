"""Chat formatting: minimum-cost role repair over a legal-turn automaton, then rendering.

States are the role of the last rendered turn (or the start). A turn may be appended, relabelled, merged into the turn
before, or preceded by one inserted empty turn; costs add up, and dynamic programming finds the cheapest way
from the start to an accepting state, ties to the option listed first.

A conversation is cut into segments of ``SEGMENT`` turn numbers; one that holds far more rows than numbers is cut further, by
turn, then by role and hash of the text, and equal rows, whose order means nothing, by a salt (``spread``). Every segment first gives its table of costs between
entry and exit states, (min, +) products of these tables fix the states at the cuts, and then each segment is
repaired and rendered by itself. So the longest conversation is neither sorted nor held in one task, nor are
the turns that share a number or have none.

Defined results: a null or unknown role must be relabelled; a null text is empty; a null turn number comes first;
rows that share a turn number stand in order of role and text, repeated rows too; a null conversation id is a
conversation of its own; ids may be of any type that can be compared; rules under which some conversation has no legal
repair are refused with a ValueError; an empty table gives an empty result; extra columns are not carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyspan.llm.shared import table, written

SEGMENT = 4096
NEVER = 1 << 40


@dataclass(frozen=True)
class Automaton:
    """Which role may follow which, where a conversation may end, and what repairs cost."""

    roles: tuple[str, ...] = ("system", "user", "assistant")
    follows: tuple[tuple[str, str], ...] = (("", "system"), ("", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"))
    ends: tuple[str, ...] = ("assistant",)
    merge: int = 2
    insert: int = 3
    relabel: int = 5

    def __post_init__(self) -> None:
        """Refuses rules under which some conversation has no legal repair."""
        finish, met, todo = self.finish(), {frozenset([0])}, [frozenset([0])]
        while todo:
            now = todo.pop()
            if all(finish[state][0] >= NEVER for state in now):
                raise ValueError("under these rules some conversation cannot be repaired")
            for role in (*self.roles, None):
                steps = self.steps(role)
                after = frozenset(option[0] for state in now for option in steps[state])
                if after not in met:
                    met.add(after)
                    todo.append(after)

    def states(self) -> list[str]:
        return ["", *self.roles]

    def steps(self, role: str | None) -> list[list[tuple[int, int, str | None, str | None, bool]]]:
        """For each state the options of a turn of this role: (next state, cost, inserted, given role, merged)."""
        states = self.states()
        legal = set(self.follows)
        out = []
        for state in states:
            options = []
            for given in self.roles:
                paid = 0 if given == role else self.relabel
                if state == given:
                    options.append((states.index(given), paid + self.merge, None, given, True))
                if (state, given) in legal:
                    options.append((states.index(given), paid, None, given, False))
                options += [(states.index(given), paid + self.insert, between, given, False) for between in self.roles if (state, between) in legal and (between, given) in legal]
            out.append(sorted(options, key=lambda o: o[1]))
        return out

    def finish(self) -> list[tuple[int, list[str]]]:
        """For each state the cost of ending there and the empty turns that it takes."""
        legal, out = set(self.follows), []
        for state in self.states():
            if state in self.ends or not state:
                out.append((0, []))
                continue
            one = [r for r in self.roles if (state, r) in legal and r in self.ends]
            two = [[a, b] for a in self.roles for b in self.roles if (state, a) in legal and (a, b) in legal and b in self.ends]
            out.append((self.insert, one[:1]) if one else (2 * self.insert, two[0]) if two else (NEVER, []))
        return out


class Repair:
    """Dynamic programming over the turns of one segment."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton
        self.known: dict[str | None, list] = {}
        self.size = len(automaton.roles) + 1

    def steps(self, role: str | None) -> list:
        role = role if role in self.automaton.roles else None
        if role not in self.known:
            self.known[role] = self.automaton.steps(role)
        return self.known[role]

    def costs(self, roles: list[str | None]) -> list[int]:
        """Cheapest cost from each entry state to each exit state, row by row."""
        table = []
        for entry in range(self.size):
            now = [NEVER] * self.size
            now[entry] = 0
            for role in roles:
                new = [NEVER] * self.size
                for state, options in enumerate(self.steps(role)):
                    if now[state] < NEVER:
                        for to, cost, *_ in options:
                            if now[state] + cost < new[to]:
                                new[to] = now[state] + cost
                now = new
            table += now
        return table

    def path(self, roles: list[str | None], entry: int, end: int) -> list[tuple[int, int, str | None, str | None, bool]]:
        """The chosen option of each turn on the cheapest way from ``entry`` to ``end``."""
        now, back = [NEVER] * self.size, []
        now[entry] = 0
        for role in roles:
            new, came = [NEVER] * self.size, [None] * self.size
            for state, options in enumerate(self.steps(role)):
                if now[state] < NEVER:
                    for option in options:
                        if now[state] + option[1] < new[option[0]]:
                            new[option[0]], came[option[0]] = now[state] + option[1], (state, option)
            back.append(came)
            now = new
        chosen, state = [], end
        for came in reversed(back):
            state, option = came[state]
            chosen.append(option)
        return chosen[::-1]


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first ``keys`` columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row)
    if rows:
        yield key, rows


def emitted(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    columns = list(zip(*held, strict=True)) if held else [()] * len(schema)
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _met(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """A join on equal values, null with null."""
    renamed = right.withColumnsRenamed({n: f"__{n}" for n in names})
    met = F.lit(True)
    for n in names:
        met &= F.col(n).eqNullSafe(F.col(f"__{n}"))
    return left.join(renamed, met, how).drop(*[f"__{n}" for n in names])


def spread(source: DataFrame, size: int) -> DataFrame:
    """Turns (conv_id, turn, role, text, mark) with ``segment``: numbers that put a conversation's segments in order.

    The first is the stretch of turn numbers. Where a stretch holds more than ``4 * size`` rows, turns are dealt to parts by
    the rows before them; a turn of more than ``size`` rows is dealt by role and leading bits of the text's hash, such a part
    by the whole hash, and rows of one hash by a salt. All of it is worked out on counts of equal rows of such stretches.
    """
    source = source.withColumn("base", F.coalesce(F.floor(F.col("turn") / size), F.lit(-1)).cast("long"))
    stretch, turn, part = ["conv_id", "base"], ["conv_id", "base", "turn"], ["conv_id", "base", "turn", "role", "bits"]
    count, total = F.count(F.lit(1)).alias("n"), F.sum("n").alias("m")

    def before(by: list[str], *order: str) -> Column:
        """Parts of ``size`` rows, by the rows that come before."""
        window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        rows = F.sum("n" if order == ("mark",) else "m").over(window)
        return F.floor(F.coalesce(rows, F.lit(0)) / size)

    hot = source.groupBy(*stretch).agg(count).where(F.col("n") > 4 * size).select(*stretch)
    equal = _met(source.drop("text"), hot, stretch, "left_semi").groupBy(*turn, "role", "mark").agg(count).withColumn("bits", F.shiftright("mark", 48))
    turns = equal.groupBy(*turn).agg(total).select(*turn, before(stretch, "turn").alias("p1"), (F.col("m") > size).alias("h1"))
    of_turn = _met(equal, turns, turn, "inner")
    parts = of_turn.where("h1").groupBy(*part).agg(total).select(*part, (1 + before(turn, "role", "bits")).alias("p2"), (F.col("m") > size).alias("h2"))
    of_part = _met(of_turn, parts, part, "left").withColumns({"p2": F.coalesce("p2", F.lit(0)), "h2": F.coalesce("h2", F.lit(False))})
    full = of_part.where("h2").withColumn("p3", 1 + before(part, "mark")).withColumn("copies", F.ceil(F.col("n") / size))
    plan = of_part.where("not h2").withColumns({"p3": F.lit(0).cast("long"), "copies": F.lit(1).cast("long")}).unionByName(full)
    joined = _met(source.withColumn("salt", F.monotonically_increasing_id()), plan.select(*turn, "role", "mark", "p1", "p2", "p3", "copies"), [*turn, "role", "mark"], "left")
    sub = F.when(F.col("copies") > 1, 1 + F.pmod("salt", "copies"))
    return joined.select("conv_id", F.array("base", *[F.coalesce(p, F.lit(0)).cast("long") for p in ("p1", "p2", "p3")], F.coalesce(sub, F.lit(0))).alias("segment"), "turn", "role", "text", "mark")


def format_chats(turns: DataFrame, automaton: Automaton = Automaton(), segment: int = SEGMENT, begin: str = "<|{role}|>\n", end: str = "<|end|>\n", joint: str = "\n") -> DataFrame:
    """One row per piece of the rendering, in order of (conv_id, segment, piece).

    Columns: conv_id, segment (from 0), piece, turn (of the input; null for an inserted turn), role (null or as given before),
    new_role, action (keep, relabel, merge, relabel+merge, insert) and rendered. The pieces of a conversation put
    together are its rendered text.
    """
    source = turns.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the salt of equal rows is fixed from here on
    source = written(spread(source.withColumn("mark", F.xxhash64("text")), segment), "turns")
    order = ["conv_id", "segment", "turn", "role", "mark"]
    kind = source.schema["conv_id"].dataType
    name, of_id = kind.simpleString(), to_arrow_type(kind)
    size = len(automaton.roles) + 1
    costs_schema = pa.schema([("conv_id", of_id), ("segment", pa.list_(pa.int64())), ("costs", pa.list_(pa.int64()))])
    cuts_schema = pa.schema([("c", of_id), ("s", pa.list_(pa.int64())), ("number", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()), ("last", pa.bool_())])
    out_schema = pa.schema([("conv_id", of_id), ("segment", pa.int64()), ("piece", pa.int32()), ("turn", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("action", pa.string()), ("rendered", pa.string())])

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = Repair(automaton)
        return emitted(((*key, repair.costs([r[3] for r in rows])) for key, rows in groups(batches, 2)), costs_schema)

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finish = automaton.finish()

        def of(rows: list[tuple]) -> list[tuple]:
            now, back = [0] + [NEVER] * (size - 1), []
            for _, _, table in rows:
                via = [min(range(size), key=lambda s, to=to: (now[s] + table[s * size + to], s)) for to in range(size)]
                back.append(via)
                now = [now[via[to]] + table[via[to] * size + to] for to in range(size)]
            state = min(range(size), key=lambda s: (now[s] + finish[s][0], s))
            found = []
            for k in range(len(rows) - 1, -1, -1):
                entry = back[k][state]
                found.append((rows[k][0], rows[k][1], k, entry, state, k == len(rows) - 1))
                state = entry
            return found

        return emitted((row for _, rows in groups(batches, 1) for row in of(rows)), cuts_schema)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, finish = Repair(automaton), automaton.finish()

        def of(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
            entry, to, last = rows[0][5:8]
            opened, piece = entry > 0, 0
            closing = [*finish[to][1]] if last else []
            path = repair.path([r[3] for r in rows], entry, to)
            for k, (row, (_, _, inserted, given, merged)) in enumerate(zip(rows, path, strict=True)):
                if inserted is not None:
                    yield (*key, piece, None, None, inserted, "insert", (end if opened else "") + begin.format(role=inserted))
                    opened, piece = True, piece + 1
                action = "+".join([*(["relabel"] if given != row[3] else []), *(["merge"] if merged else [])]) or "keep"
                head = joint if merged else (end if opened else "") + begin.format(role=given)
                tail = end if last and not closing and k == len(rows) - 1 else ""
                yield (*key, piece, row[2], row[3], given, action, head + row[4] + tail)
                opened, piece = True, piece + 1
            for k, role in enumerate(closing):
                yield (*key, piece, None, None, role, "insert", (end if opened else "") + begin.format(role=role) + (end if k == len(closing) - 1 else ""))
                opened, piece = True, piece + 1

        return emitted((row for key, rows in groups(batches, 2) for row in of(key, rows)), out_schema)

    roles = source.drop("text").repartition("conv_id", "segment").sortWithinPartitions(*order)
    costs = roles.select("conv_id", "segment", "turn", "role", "mark").mapInArrow(tables, f"conv_id {name}, segment array<long>, costs array<long>")
    met = costs.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    fixed = written(met.mapInArrow(cuts, f"c {name}, s array<long>, number long, entry int, exit int, last boolean"), "cuts")
    joined = source.join(fixed, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s")))
    joined = joined.repartition("conv_id", "segment").sortWithinPartitions(*order)
    pieces = joined.select("conv_id", F.col("number").alias("segment"), "turn", "role", "text", "entry", "exit", "last")
    return pieces.mapInArrow(render, f"conv_id {name}, segment long, piece int, turn long, role string, new_role string, action string, rendered string")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
