"""Event-sourced histories: params and hosts in force, deadlines, snapshot differences, transitions, late verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspan.operators.ranges import overlapping


def key(height: str, tx: str) -> Column:
    return F.struct(F.col(height).cast("long").alias("h"), F.col(tx).cast("long").alias("t"))


def params_at(publications: DataFrame, params: DataFrame) -> DataFrame:
    """Promises with the params in force at their settlement (null before the first)."""
    return as_of_one_history(publications, params, key("height", "tx_index"), key("from_height", "from_tx"), ["timeout_days", "retention_days"])


def as_of_one_history(left: DataFrame, right: DataFrame, left_at: Column, right_at: Column, take: list[str], width: int = 64, by: list[str] | None = None) -> DataFrame:
    """As-of against a history: the history as spans, spans cut into height buckets, an equi-join on the bucket (and ``by``).

    Only the history is put in order, by key; the left rows of a key are dealt out by bucket. Of equal right keys the
    largest values of ``take`` win.
    """
    keys = by or []
    rows = right.select(*keys, right_at.alias("__from"), *take)
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__from", *take)  # without a key the history alone: few rows
    spans = rows.withColumn("__next", F.lead("__from").over(order))
    top = left.agg(F.max(left_at["h"])).scalar()
    until = F.least(F.coalesce(F.col("__next")["h"], top), top)
    cut = spans.where(F.col("__from")["h"] <= until).withColumn("__c", F.explode(F.sequence(F.floor(F.col("__from")["h"] / width), F.floor(until / width))))
    cut = cut.withColumnsRenamed({k: f"__{k}" for k in keys})
    marked = left.withColumn("__at", left_at).withColumn("__b", F.floor(F.col("__at")["h"] / width))
    met = (F.col("__b") == F.col("__c")) & (F.col("__at") >= F.col("__from")) & (F.col("__next").isNull() | (F.col("__at") < F.col("__next")))
    for k in keys:
        met &= F.col(k) == F.col(f"__{k}")
    return marked.join(cut, met, "left").drop("__b", "__c", "__at", "__from", "__next", *[f"__{k}" for k in keys])


def deadlines(publications: DataFrame, params: DataFrame, day: int) -> DataFrame:
    """The earliest deadline over every params value in force from the promise to its settlement, and whether they differ.

    A value bounds the deadline at creation + the longer of timeout and retention.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("from_height", "from_tx")
    spans = params.withColumns({"__nh": F.lead("from_height").over(order), "__nt": F.lead("from_tx").over(order)})
    top = publications.agg(F.max("height")).scalar()
    ranges = spans.withColumns({"lo": F.col("from_height"), "hi": F.coalesce("__nh", top, F.lit(0))}).withColumn("all", F.struct("from_height", "from_tx", "__nh", "__nt", "timeout_days", "retention_days"))
    wide = publications.select("promise_hash", (F.col("promise_height") - 1).alias("lo"), F.col("height").alias("hi"))
    met = overlapping(wide, ranges.select("lo", "hi", "all"), "promise_hash", keep="all").select("promise_hash", "all.*")
    joined = publications.select("promise_hash", "created_us", "promise_height", "height", "tx_index").join(met, "promise_hash")
    began = (F.col("from_height") < F.col("height")) | ((F.col("from_height") == F.col("height")) & (F.col("from_tx") <= F.col("tx_index")))
    gone = F.col("__nh").isNotNull() & ((F.col("__nh") < F.col("promise_height") - 1) | (F.col("__nh") == F.col("promise_height") - 1))
    inside = joined.where(began & ~gone)
    until = F.col("created_us") + F.greatest("timeout_days", "retention_days") * day
    return inside.groupBy("promise_hash").agg(F.min(until).alias("must_serve_us"), (F.count_distinct("timeout_days", "retention_days") > 1).alias("ambiguous"))


def hosts_at(publications: DataFrame, events: DataFrame, gaps: DataFrame) -> DataFrame:
    """(promise, validator) with the host in force at settlement and how it is known.

    ``source``: on_record, none (registered as empty), no_seed (nothing before), gap (a scan gap lies between).
    """
    left = publications.select("promise_hash", "validator", "height", "tx_index")
    found = as_of_one_history(left, events.withColumn("since", F.col("height")), key("height", "tx_index"), key("height", "tx_index"), ["host", "since"], by=["validator"])
    spans = found.select("promise_hash", "validator", (F.coalesce("since", F.lit(0)) + 1).alias("lo"), F.col("height").alias("hi")).withColumn("pair", F.struct("promise_hash", "validator"))
    hit = overlapping(spans, gaps.select(F.col("first").alias("lo"), F.col("last").alias("hi")), "pair").select("pair.*").withColumn("gap", F.lit(True))
    joined = found.join(hit, ["promise_hash", "validator"], "left")
    source = F.when(F.col("gap"), "gap").when(F.col("host").isNull(), "no_seed").when(F.col("host") == "", "none").otherwise("on_record")
    return joined.withColumn("source", source).withColumn("host", F.when(source == "on_record", F.col("host")).otherwise(""))


def endpoint_steps(events: DataFrame, gaps: DataFrame) -> DataFrame:
    """What each host event did: registered, changed, same, after_gap or before_record."""
    order = Window.partitionBy("validator").orderBy("height", "tx_index", "host")
    before = events.withColumns({"previous": F.lag("host").over(order), "previous_height": F.lag("height").over(order)})
    before = before.withColumns({"__lo": F.coalesce("previous_height", F.lit(0)) + 1, "__hi": F.col("height")})
    # by what lies between, not by event: repeated events differ in what is before them
    spans = before.select(F.col("__lo").alias("lo"), F.col("__hi").alias("hi")).distinct().withColumn("id", F.struct(F.col("lo").alias("__lo"), F.col("hi").alias("__hi")))
    hit = overlapping(spans, gaps.select(F.col("first").alias("lo"), F.col("last").alias("hi")), "id").select("id.*").withColumn("gap", F.lit(True))
    joined = before.join(hit, ["__lo", "__hi"], "left")
    step = F.when(F.col("gap"), "after_gap").when(F.col("previous").isNull(), "before_record").when(F.col("previous") == F.col("host"), "same").when(F.col("previous") == "", "registered").otherwise("changed")
    return joined.withColumn("step", step).drop("gap", "__lo", "__hi")


def paired_costs(events: DataFrame, costs: DataFrame) -> DataFrame:
    """Host events with the cost of their transaction: same height, an index one lower than the event's."""
    right = costs.groupBy("height", F.col("tx_index").alias("__t")).agg(F.min("gas").alias("gas"))
    return events.withColumn("__t", F.col("tx_index") - 1).join(right, ["height", "__t"], "left").drop("__t")


def snapshot_diff(before: DataFrame, now: DataFrame, by: str, value: str) -> DataFrame:
    """open, close or move for every key whose value differs between two snapshots."""
    old, new = before.select(by, F.col(value).alias("old")), now.select(by, F.col(value).alias("new"))
    joined = old.join(new, by, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return joined.withColumn("change", F.when(F.col("old").isNull(), "open").when(F.col("new").isNull(), "close").otherwise("move"))


def queue_changes(snapshots: DataFrame) -> DataFrame:
    """Changes of a queue over its snapshots (key, at_us, amount; a null amount: gone): appeared, reduced, raised, gone, reopened."""
    order = Window.partitionBy("key").orderBy("at_us")
    before = snapshots.withColumns({"was": F.lag("amount").over(order), "n": F.row_number().over(order), "ever": F.max("amount").over(order.rowsBetween(Window.unboundedPreceding, -1))})
    change = (
        F.when(F.col("amount").isNull() & F.col("was").isNotNull(), "gone").when(F.col("amount").isNotNull() & F.col("was").isNull() & F.col("ever").isNotNull(), "reopened")
        .when(F.col("amount").isNotNull() & F.col("was").isNull(), "appeared").when(F.col("amount") < F.col("was"), "reduced").when(F.col("amount") > F.col("was"), "raised")
    )
    return before.withColumn("change", change).where("change is not null").drop("n", "ever")


def runs(rows: DataFrame, by: list[str], order: list[str], value: str, carry: list[str]) -> DataFrame:
    """Runs of equal values in order: value, first row's order key and carried columns, length, number of the run."""
    window = Window.partitionBy(*by).orderBy(*order)
    changed = F.when(~F.col(value).eqNullSafe(F.lag(value).over(window)), 1).otherwise(0)
    numbered = rows.withColumn("__new", changed).withColumn("run", F.sum("__new").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = F.min(F.struct(*order, *[c for c in carry if c not in order]))
    found = numbered.groupBy(*by, "run", value).agg(F.count(F.lit(1)).alias("beats"), first.alias("__first"))
    return found.select(*by, "run", value, "beats", *[F.col(f"__first.{c}").alias(c) for c in dict.fromkeys([*order, *carry])])


def confirmed(found: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """Runs of n rows or more whose value differs from the confirmed one before; the first one is a baseline (``was`` null)."""
    long = found.where(F.col("beats") >= n)
    order = Window.partitionBy(*by).orderBy("run")
    return long.withColumn("was", F.lag(value).over(order)).where(~F.col(value).eqNullSafe(F.col("was")))


def transitions(beats: DataFrame, n: int = 3) -> DataFrame:
    """Reachability events: the start of a confirmed run that differs from the state before; ``since`` is when the outage began."""
    changed = confirmed(runs(beats, ["validator"], ["at_us", "seq"], "up", ["host"]), ["validator"], "up", n)
    since = F.lag("at_us").over(Window.partitionBy("validator").orderBy("run"))
    out = changed.withColumn("since_us", F.when(F.col("up"), since)).where("was is not null")
    return out.select("validator", F.when(F.col("up"), "recovered").otherwise("unreachable").alias("kind"), "at_us", "host", "since_us", "beats")


def identity_transitions(beats: DataFrame, n: int = 3) -> DataFrame:
    """Identity events over reachable, judged beats: a problem, another problem, restored (with since, when it left verified)."""
    judged = beats.where("up and identity <> ''")
    changed = confirmed(runs(judged, ["validator"], ["at_us", "seq"], "identity", ["host"]), ["validator"], "identity", n)
    order = Window.partitionBy("validator").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    left = F.last(F.when(F.col("was") == "verified", F.col("at_us")), ignorenulls=True).over(order)
    out = changed.withColumn("since_us", F.when(F.col("identity") == "verified", left)).where("was is not null")
    return out.select("validator", F.when(F.col("identity") == "verified", "identity_restored").otherwise("identity_problem").alias("kind"), "identity", "at_us", "since_us")


def late_verdicts(waiting: DataFrame, candidates: DataFrame, frontier: int, timeout: int, tolerance: int) -> DataFrame:
    """Verdicts of checks whose rows matched no known promise, once the frontier is past started + timeout.

    waiting: dedupe_key, validator, commitment, started_us, rows (array). candidates: promise_hash, validator, commitment,
    settled_us, must_serve_us, rows (null: not on record). Equal rows as multisets: SHADOWED_SHARD by the smallest promise;
    else PROBE_ERROR if a candidate's rows are not on record; else UNMATCHED_GENUINE.
    """
    due = waiting.where((F.size("rows") > 0) & (F.col("started_us") + timeout <= frontier)).withColumn("__rows", F.array_sort("rows"))
    alive = (F.col("settled_us") <= F.col("started_us") + timeout) & (F.col("must_serve_us") + tolerance >= F.col("started_us"))
    other = candidates.select("validator", "commitment", "promise_hash", "settled_us", "must_serve_us", F.array_sort("rows").alias("__theirs"))
    met = due.join(other, ["validator", "commitment"]).where(alive)
    found = met.groupBy("dedupe_key").agg(F.min(F.when(F.col("__rows") == F.col("__theirs"), F.col("promise_hash"))).alias("shadowed_by"), F.bool_or(F.col("__theirs").isNull() | (F.size("__theirs") == 0)).alias("unrecorded"))
    joined = due.join(found, "dedupe_key", "left")
    cls = F.when(F.col("shadowed_by").isNotNull(), "SHADOWED_SHARD").when(F.col("unrecorded"), "PROBE_ERROR").otherwise("UNMATCHED_GENUINE")
    return joined.select("dedupe_key", cls.alias("cls"), "shadowed_by")


def cascade(keys: DataFrame, sources: list[tuple[str, DataFrame]], by: str) -> DataFrame:
    """For each key the first source, in the order given, that has it, and that source's smallest detail."""
    every = None
    for place, (name, rows) in enumerate(sources):
        part = rows.select(by, F.lit(place).alias("place"), F.lit(name).alias("source"), F.col("detail").cast("long").alias("detail"))
        every = part if every is None else every.unionByName(part)
    best = every.groupBy(by).agg(F.min(F.struct("place", "detail", "source")).alias("b"))
    return keys.join(best, by, "left").select(by, F.coalesce("b.source", F.lit("unknown")).alias("source"), F.col("b.detail").alias("detail"))



def run_spans(events: DataFrame) -> DataFrame:
    """Runs of processes from their events (component, vantage, pid, at_us, kind): from each start to the first stop from then on,
    or while none came to the last beat before the next start. Equal starts are one."""
    key = ["component", "vantage", "pid"]
    rank = F.when(F.col("kind") == "started", 0).when(F.col("kind") == "beat", 1).otherwise(2)
    order = Window.partitionBy(*key).orderBy("at_us", rank)
    started = F.when(F.col("kind") == "started", F.col("at_us"))
    marked = events.distinct().withColumns({
        "__run": F.count(started).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "__stop": F.first(F.when(F.col("kind") == "stopped", F.col("at_us")), ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    found = marked.where("__run > 0").groupBy(*key, "__run").agg(
        F.min(started).alias("from_us"), F.max(F.when(F.col("kind") == "started", F.col("__stop"))).alias("stopped_us"), F.max(F.when(F.col("kind") == "beat", F.col("at_us"))).alias("beat_us")
    )
    return found.select(*key, "from_us", F.coalesce("stopped_us", "beat_us", "from_us").alias("to_us"), F.col("stopped_us").isNotNull().alias("stopped"))


def gaps_between(spans: DataFrame, by: list[str]) -> DataFrame:
    """Stretches between the first and the last span of each key that no span covers."""
    order = Window.partitionBy(*by).orderBy("from_us", "to_us").rowsBetween(Window.unboundedPreceding, -1)
    upto = spans.withColumn("__upto", F.max("to_us").over(order)).where(F.col("from_us") > F.col("__upto"))
    return upto.select(*by, F.col("__upto").alias("from_us"), F.col("from_us").alias("to_us"))


def confirmed_elsewhere(beats: DataFrame, within: int) -> DataFrame:
    """Every failed heartbeat with what else is known of it.

    ``flaky``: the heartbeat before it of the same vantage at the same host was answered. ``elsewhere``: up or down by the newest
    heartbeat of another vantage at the same host, less than ``within`` before; none without one.
    """
    own = Window.partitionBy("validator", "host", "vantage").orderBy("at_us", "seq")
    order = Window.partitionBy("validator", "host").orderBy("at_us", "seq")
    before = F.lag(F.struct("vantage", "at_us", "up")).over(order)
    marked = beats.select("seq", "validator", "host", "vantage", "at_us", "up", F.lag("up").over(own).alias("__own")).withColumn("__before", before)
    # in a row of heartbeats of one vantage, the newest of another is the one before the first of them
    other = F.when(F.col("__before")["vantage"] != F.col("vantage"), F.col("__before"))
    found = marked.withColumn("__other", F.last(other, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("not up")
    recent = F.col("__other")["at_us"] > F.col("at_us") - within
    elsewhere = F.when(recent, F.when(F.col("__other")["up"], "up").otherwise("down")).otherwise("none")
    return found.select("seq", "validator", F.coalesce("__own", F.lit(False)).alias("flaky"), elsewhere.alias("elsewhere"))
