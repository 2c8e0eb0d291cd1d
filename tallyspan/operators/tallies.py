"""Windowed conditional aggregates over checks, beats and assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspan.functions import rules


def window(rows: DataFrame, at: str, start: int | None, end: int) -> DataFrame:
    """Rows of [start, end], both ends included; without a start all up to the end."""
    return rows.where(F.col(at) <= end) if start is None else rows.where(F.col(at).between(start, end))


def without(rows: DataFrame, key: str, excluded: list) -> DataFrame:
    return rows.where(~F.col(key).isin(*excluded)) if excluded else rows


def attestation(rows: DataFrame) -> DataFrame:
    """Per validator how many promises it signed, did not sign, or cannot be told about (the best answer of a pair counts)."""
    pairs = rows.groupBy("validator", "promise_hash").agg(F.max("attested").alias("a"))
    return pairs.groupBy("validator").agg(F.count_if("a").alias("attested"), F.count_if(~F.col("a")).alias("not_attested"), F.count_if(F.col("a").isNull()).alias("unknown"))


def seen(rows: DataFrame) -> DataFrame:
    return rows.groupBy("validator").agg(F.count(F.lit(1)).alias("checks"), F.max("started_us").alias("last_us"), F.max(F.when(F.col("cls") == "HEALTHY", F.col("started_us"))).alias("last_healthy_us"))


def beat_counts(beats: DataFrame) -> DataFrame:
    verified = F.col("up") & (F.col("identity") == "verified")
    return beats.groupBy("validator").agg(
        F.count(F.lit(1)).alias("beats"), F.count_if("up").alias("up"), F.count_if(verified).alias("identity_up"),
        F.max(F.when(~F.col("up"), F.col("at_us"))).alias("last_down_us"), F.max(F.when(F.col("up"), F.col("at_us"))).alias("last_up_us"),
    )


def latest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key by a total order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def signing(publications: DataFrame, assignments: DataFrame) -> DataFrame:
    """Signing participation per validator, over promises that settled and assigned rows.

    An empty host says none was registered; a null host that it could not be read.
    """
    hosted = ~F.col("host_at_settlement").eqNullSafe(F.lit(""))
    joined = publications.where("tx_code = 0").join(assignments.where("row_count > 0"), "promise_hash")
    return joined.groupBy("validator").agg(
        F.count_if(hosted & F.col("attested").isNotNull()).alias("known"), F.count_if(hosted & F.coalesce("attested", F.lit(False))).alias("signed"),
        F.count_if(hosted & F.col("attested").isNull()).alias("unknown"), F.count_if(F.col("host_at_settlement") == "").alias("no_host"),
    )


def quorum(publications: DataFrame, assignments: DataFrame, powers: DataFrame) -> DataFrame:
    """Promises by the share of power that signed: exact integer edges at 2/3, 3/4, 9/10 and all."""
    joined = publications.where("tx_code = 0").join(assignments, "promise_hash").join(powers, "validator")
    each = joined.groupBy("promise_hash").agg(F.sum("power").alias("total"), F.sum(F.when(F.coalesce("attested", F.lit(False)), F.col("power")).otherwise(0)).alias("signed"))
    reached = lambda num, den: F.col("signed").cast("decimal(38,0)") * den >= F.col("total").cast("decimal(38,0)") * num
    edge = F.when(reached(1, 1), "all").when(reached(9, 10), "90%").when(reached(3, 4), "75%").when(reached(2, 3), "67%").otherwise("less")
    return each.groupBy(edge.alias("edge")).agg(F.count(F.lit(1)).alias("n"))


def newest_endorsements(publications: DataFrame, assignments: DataFrame, n: int = 20) -> DataFrame:
    """Per validator, of its newest n promises: how many it signed, and the newest one that it signed."""
    joined = publications.join(assignments.where("row_count > 0"), "promise_hash").withColumn("__signed", F.coalesce("attested", F.lit(False)))
    place = F.struct("height", "tx_index", "promise_hash")
    newest = Window.partitionBy("validator").orderBy(F.desc("height"), F.desc("tx_index"), F.desc("promise_hash"))
    # the limit is pushed into the sort: a task gives at most n rows of a validator to the next one
    few = joined.select("validator", "__signed", F.row_number().over(newest).alias("__n")).where(F.col("__n") <= n)
    counts = few.groupBy("validator").agg(F.count(F.lit(1)).alias("newest"), F.count_if("__signed").alias("newest_signed"))
    last = joined.where("__signed").groupBy("validator").agg(F.max(place)["promise_hash"].alias("last_signed"))
    return counts.join(last, "validator", "left")


def load(publications: DataFrame, assignments: DataFrame, start: int, end: int, now: int) -> DataFrame:
    """What a validator was assigned and signed for: promises, rows and bytes settled in [start, end], and bytes held at ``now``.

    Only promises that settled without an error count; held is what settled by ``now`` and must be served after it. A row
    carries size / needed rows bytes (none where that is unknown). Sums are exact integers per divisor; only the remainders,
    one a divisor, are added as fractions.
    """
    within = F.col("settled_us").between(start, end)
    held = (F.col("must_serve_us") > now) & (F.col("settled_us") <= now)
    chosen = publications.where((F.col("tx_code") == 0) & (within | held)).withColumns({"__in": within, "__held": held})
    joined = chosen.join(assignments.where("attested and row_count > 0"), "promise_hash")
    divisor = F.when(F.col("needed_rows") > 0, F.col("needed_rows"))
    scaled = F.when(divisor.isNotNull(), (F.col("row_count") * F.col("blob_size")).cast("decimal(38,0)"))
    parts = joined.groupBy("validator", divisor.alias("__by")).agg(
        F.count_if("__in").alias("promises"), F.sum(F.when(F.col("__in"), F.col("row_count"))).alias("rows"),
        F.sum(F.when(F.col("__in"), scaled)).alias("load"), F.sum(F.when(F.col("__held"), scaled)).alias("held"),
    )

    def whole(c: str) -> Column:
        rest = F.sum(F.expr(f"cast({c} % __by as double) / __by"))
        return F.coalesce((F.sum(F.expr(f"{c} div __by")) + F.floor(F.round(rest, 9))).cast("long"), F.lit(0))

    return parts.groupBy("validator").agg(F.sum("promises").alias("promises"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), whole("load").alias("load_bytes"), whole("held").alias("held_bytes"))


def retained(publications: DataFrame, assignments: DataFrame, at: int) -> DataFrame:
    """Promises each validator holds in retention at a moment."""
    joined = publications.where((F.col("settled_us") <= at) & (F.col("must_serve_us") > at)).join(assignments.where("row_count > 0"), "promise_hash")
    return joined.groupBy("validator").agg(F.count(F.lit(1)).alias("promises"), F.sum("row_count").alias("rows"))


# What an endpoint says of its readiness, and the words for it.
READY_WORDS = {"serving": "ready", "not_serving": "not_ready", "not_reported": "not_reported"}


def readiness(beats: DataFrame, depth: int = 4) -> DataFrame:
    """A word for each validator from its newest ``depth`` heartbeats, none where no heartbeat of them was answered.

    The newest decides. Not serving is ``not_ready`` only if the answer before it said so too, unmeasured ones skipped, else
    ``not_ready_once``. A newest heartbeat that was not measured or not verified is ``unchecked``, with the newest answer before
    it beside. An answer counts only from a verified heartbeat.
    """
    verified = F.col("up") & (F.col("identity") == "verified")
    newest = Window.partitionBy("validator").orderBy(F.desc("at_us"), F.desc("seq"))
    last = beats.select("validator", "at_us", verified.alias("verified"), F.when(verified, F.col("readiness")).otherwise("").alias("said"), F.row_number().over(newest).alias("n"))
    last = last.where(F.col("n") <= depth)
    n, said = F.col("n"), F.col("said")
    word = F.coalesce(*[F.when(said == k, w) for k, w in READY_WORDS.items()])
    seen = last.groupBy("validator").agg(
        F.max(F.when(n == 1, said)).alias("now"), F.max(F.when(n == 1, F.col("at_us"))).alias("checked_us"), F.bool_or((n == 1) & F.col("verified")).alias("verified"), F.bool_or(said != "").alias("answered"),
        F.min_by(said, F.when((n > 1) & (said != "unmeasured"), n)).alias("before"), F.min_by(word, F.when((n > 1) & word.isNotNull(), n)).alias("last_answer"),
    )
    state = (
        F.when(F.col("now") == "serving", "ready").when(F.col("now") == "not_reported", "not_reported")
        .when(F.col("now") == "not_serving", F.when(F.col("before") == "not_serving", "not_ready").otherwise("not_ready_once"))
        .when((F.col("now") == "unmeasured") | ~F.col("verified"), "unchecked")
    )
    known = seen.where("answered").withColumn("word", state).where("word is not null")
    return known.select("validator", "word", "checked_us", F.when(F.col("word") == "unchecked", F.col("last_answer")).alias("last_answer"))


def concentration(validators: DataFrame, dimensions: list[str]) -> DataFrame:
    """Shares of hosts and stake by each dimension: one unpivoted pass, totals by window."""
    long = validators.select("validator", "power", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("key")) for d in dimensions])).alias("d")).select("validator", "power", "d.*")
    found = long.groupBy("dimension", "key").agg(F.count(F.lit(1)).alias("hosts"), F.sum("power").alias("stake"))
    whole = Window.partitionBy("dimension")
    return found.withColumn("all_hosts", F.sum("hosts").over(whole)).withColumn("all_stake", F.sum("stake").over(whole))


def coefficient(shares: DataFrame) -> DataFrame:
    """Fewest keys of each dimension that together have strictly more than a third of the stake; null if none do."""
    order = Window.partitionBy("dimension").orderBy(F.desc("stake"), "key")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = shares.withColumn("__n", F.row_number().over(order)).withColumn("__sum", F.sum("stake").over(upto))
    return ranked.groupBy("dimension").agg(F.min(F.when(F.col("__sum") * 3 > F.col("all_stake"), F.col("__n"))).cast("long").alias("n"))
