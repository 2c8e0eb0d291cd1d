"""Mixing sources to target weights: temperature mixing realised by budgeted block permutations.

1. Token totals of the sources are summed; their shares are raised to an exponent and normalised. The exponent is
   bisected: 1 keeps the corpus's shares, 0 makes all sources equal. It is the smallest that keeps every source within
   a limit of repetitions, or the one whose weights have a wanted entropy.
2. Budgets: the source that its weight favours least is taken once and whole, every other one as many times as its
   weight asks for, so no document is lost. A source's documents form ``BLOCKS`` hash blocks; each round over a source is a
   permutation of its blocks, and the last, partial round takes blocks in permuted order until the budget is spent.
3. Whole blocks are decided from block totals alone, documents only in the block where a budget ends; no source is sorted or
   gathered in one task, however large.

Defined results: a null source is a source of its own; null and empty texts have no tokens, are in every whole
round and in the partial one where their block is; rows without an id are placed by their text; repeated rows are
separate documents; an empty table gives an empty result. A source without any token is taken once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspan.llm.shared import table, words, written

BLOCKS = 1024
#: Most sources whose totals the driver takes; beyond, it takes a histogram of them.
MOST_SOURCES = 1_000_000
REPEATS = 2.0
#: Up to so many sources the plan (``BLOCKS`` rows a source) is sent to every executor; beyond, it is joined by key.
FEW_SOURCES = 100


def tempered(totals: dict, exponent: float, many: dict | None = None) -> dict:
    """Weights proportional to total ** exponent, of the sources that have tokens; ``many`` sources have that total each."""
    largest = max(totals.values(), default=0)
    raw = {s: (n / largest) ** exponent for s, n in totals.items() if n}
    whole = sum(v * many[s] for s, v in raw.items()) if many else sum(raw.values())
    return {s: v / whole for s, v in raw.items()}


def entropy(weights: dict, many: dict | None = None) -> float:
    return -sum((many[s] if many else 1) * w * math.log(w) for s, w in weights.items() if w)


def rounds(totals: dict, weights: dict) -> dict:
    """How many times each source is taken, 1 for the one that its weight favours least."""
    least = min((weights[s] / totals[s] for s in weights), default=1.0)
    return {s: max(1.0, weights[s] / totals[s] / least) if s in weights else 1.0 for s in totals}


def bisect(totals: dict, repeats: float | None = REPEATS, target_entropy: float | None = None, steps: int = 60, many: dict | None = None) -> float:
    """The exponent from 0 to 1: the smallest one within the repetition limit, or the one that meets the entropy.

    Repetitions and entropy both fall as the exponent rises. An entropy outside the reachable range gives the
    nearer end.
    """

    def enough(exponent: float) -> bool:
        weights = tempered(totals, exponent, many)
        if target_entropy is not None:
            return entropy(weights, many) <= target_entropy
        return max(rounds(totals, weights).values(), default=1.0) <= repeats

    low, high = 0.0, 1.0
    if enough(low):
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if enough(middle) else (middle, high)
    return high


def budgeted(totals: dict, repeats: float | None, target_entropy: float | None, many: dict | None = None) -> dict:
    """Each source's weight, whole rounds, and tokens of the partial round."""
    weights = tempered(totals, bisect(totals, repeats, target_entropy, many=many), many)
    taken = rounds(totals, weights)
    return {s: (float(weights.get(s, 0.0)), int(taken[s]), round((taken[s] - int(taken[s])) * totals[s])) for s in totals}


def word_tokens(text: Column) -> Column:
    """Words of a text, the token unit where no vocabulary is given."""
    return F.size(words(text)).cast("long")


def mix(documents: DataFrame, source: str = "source", text: str = "text", id_column: str = "doc_id", tokens: Column | None = None, repeats: float | None = REPEATS, target_entropy: float | None = None) -> DataFrame:
    """The mixture: a document's row once for each time it is taken.

    All columns of ``documents``, and ``mix_round`` (from 0), ``mix_place`` (its block's place in that round's permutation
    of the source's blocks, from 0), ``mix_tokens`` and ``mix_weight``; input columns of these names are replaced.
    """
    added = ("mix_round", "mix_place", "mix_tokens", "mix_weight")
    marked = documents.drop(*added)
    names = marked.columns
    fixed = F.xxhash64(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    marked = marked.withColumns({
        "mix_tokens": tokens if tokens is not None else word_tokens(F.col(text)),
        "__source": F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")),
        "__block": F.pmod(F.shiftright(fixed, 20), F.lit(BLOCKS)).cast("int"),
        "__at": fixed,
    })
    sums = written(marked.groupBy("__source", "__block").agg(F.sum("mix_tokens").alias("n")), "blocks")
    each_total = sums.groupBy("__source").agg(F.sum("n").alias("n"))
    found = each_total.limit(MOST_SOURCES + 1).collect()
    few = len(found) <= FEW_SOURCES
    schema = "mix_weight double, __whole int, __rest long"
    if len(found) <= MOST_SOURCES:
        totals = {r["__source"]: r["n"] for r in found}
        budgets = [(s, *b) for s, b in budgeted(totals, repeats, target_entropy).items()]
        asked = documents.sparkSession.createDataFrame(budgets, f"__source string, {schema}")
    else:  # a source's budget follows from its total: the driver takes the distinct totals alone, at most the root of twice all tokens
        many = {r["n"]: r["m"] for r in each_total.groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()}
        budgets = [(n, *b) for n, b in budgeted({n: n for n in many}, repeats, target_entropy, many).items()]
        asked = each_total.join(documents.sparkSession.createDataFrame(budgets, f"n long, {schema}"), "n").drop("n")

    # a permutation of each source's blocks for every round, and for the partial one the tokens of the blocks before
    order = Window.partitionBy("__source", "__round").orderBy("__draw", "__block")
    each = sums.withColumnRenamed("n", "__n").join(asked, "__source").withColumn("__round", F.explode(F.sequence(F.lit(0), F.col("__whole"))))
    each = each.withColumn("__draw", F.xxhash64("__source", "__block", "__round"))
    each = each.withColumn("__place", (F.row_number().over(order) - 1).cast("long"))
    each = each.withColumn("__before", F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    partial = F.col("__round") == F.col("__whole")
    blocks = each.groupBy("__source", "__block", "__n", "mix_weight", "__whole", "__rest").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__round", "__place"))), lambda x: x["__place"]).alias("__places"),
        F.max(F.when(partial, F.col("__before"))).alias("__before"),
    )
    blocks = written(blocks, "plan")

    # the block in which a budget ends gives its documents in hashed order while they fit
    ends = blocks.where("__before < __rest and __before + __n > __rest").select("__source", "__block", "__before", "__rest")
    running = Window.partitionBy("__source", "__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = marked.select("__source", "__block", "__at", "mix_tokens").join(F.broadcast(ends) if few else ends, ["__source", "__block"])
    spent = spent.groupBy("__source", "__block", "__at", "__before", "__rest").agg(F.sum("mix_tokens").alias("t"))
    spent = spent.where((F.col("__before") + F.col("t")) <= F.col("__rest")).withColumn("__sum", F.col("__before") + F.sum("t").over(running))
    limits = spent.where("__sum <= __rest").groupBy("__source", "__block").agg(F.max("__at").alias("__to"))

    plan = blocks.join(limits, ["__source", "__block"], "left")
    joined = marked.join(F.broadcast(plan) if few else plan, ["__source", "__block"])
    whole_block = (F.col("__rest") > 0) & (F.col("__before") + F.col("__n") <= F.col("__rest"))
    extra = F.when(F.coalesce(whole_block | (F.col("__at") <= F.col("__to")), F.lit(False)), 1).otherwise(0)
    taken_at = F.posexplode(F.slice("__places", F.lit(1), F.col("__whole") + extra)).alias("mix_round", "mix_place")
    return joined.select(*names, "mix_tokens", "mix_weight", taken_at).select(*names, *added)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_round").alias("round"), F.col("mix_place").alias("block_place"), F.round("mix_weight", 12).alias("weight"))
