"""Quality rules: a threshold table compiled into one projection of counts and comparisons.

Every metric is a built-in expression over the text; no user function and no shuffle. A rule compares two
integer metrics by cross multiplication, so no verdict depends on rounding.

Defined results: a null or empty text has no words and every count 0, and fails the base rules; texts of any
length are read whole; repeated rows are judged alike; an empty table gives an empty result; columns of the
input that clash with result names are not carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan.llm.shared import let, table, words

SYMBOLS = r"[#*$%&|<>]"

# Frequent function words of the corpus languages.
STOP_WORDS = {
    "en": "the of and to in is was for that it on with as be at by this from are or",
    "de": "der die und das von zu mit den im auf ist nicht ein eine des dem sich",
    "fr": "le la les de et un une des en du que qui dans est pour par sur au pas",
    "es": "el los las y del se por con no para su al lo una que de la en",
}


@dataclass(frozen=True)
class Rule:
    """Keeps a text while ``100 * metric`` is ``>=`` or ``<=`` ``percent * per`` (``per`` empty: the constant 1)."""

    metric: str
    sense: str
    percent: int
    per: str = ""

    def holds(self, columns: dict[str, Column]) -> Column:
        left = columns[self.metric] * 100
        right = (columns[self.per] if self.per else F.lit(1)) * self.percent
        return left >= right if self.sense == ">=" else left <= right

    def sql(self) -> str:
        return f"100 * {self.metric} {self.sense} {self.percent} * {self.per or 1}"


#: What fails the base whatever the table says.
BASE = (Rule("n_words", ">=", 5000), Rule("n_repeat_words", "<=", 50, "n_words"))

#: Production thresholds, in percent: length, symbol, stop-word and line ratios.
TABLE = (
    Rule("word_chars", ">=", 250, "n_words"),
    Rule("word_chars", "<=", 1400, "n_words"),
    Rule("n_symbols", "<=", 6, "word_chars"),
    Rule("n_bangs", "<=", 40, "n_words"),
    Rule("n_stop_words", ">=", 4, "n_words"),
    Rule("n_dup_lines", "<=", 35, "n_lines"),
)


def stop_forms(languages: dict[str, str] = STOP_WORDS) -> list[str]:
    """Every stop word as written in running text: lower case, capitalised and in capitals."""
    plain = sorted({w for line in languages.values() for w in line.split()})
    return sorted({form for w in plain for form in (w, w.capitalize(), w.upper())})


#: Up to so many distinct repeated windows are looked up one by one; more are found by sorting.
FEW = 24


def repeated_words(found: Column) -> Column:
    """Number of words that lie in a 3-word window occurring twice or more; 64-bit hashes stand for windows."""

    def spread(places: Column) -> Column:
        return F.size(F.array_distinct(F.concat(places, F.transform(places, lambda i: i + 1), F.transform(places, lambda i: i + 2))))

    def by_lookup(grams: Column, twins: Column) -> Column:
        places = F.transform(grams, lambda g, i: F.when(F.array_contains(twins, g), i))
        return let(F.filter(places, lambda i: i.isNotNull()), spread)

    def by_sort(grams: Column) -> Column:
        def inside(p: Column) -> Column:
            twins = F.filter(p, lambda x, j: (F.get(p, j - 1)["g"] == x["g"]) | (F.get(p, j + 1)["g"] == x["g"]))
            return let(F.transform(twins, lambda x: x["i"]), spread)

        return let(F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))), inside)

    def some(grams: Column) -> Column:
        twins = let(F.sort_array(grams), lambda s: F.array_distinct(F.filter(s, lambda x, j: F.get(s, j + 1) == x)))
        return let(twins, lambda t: F.when(F.size(t) <= FEW, by_lookup(grams, t)).otherwise(by_sort(grams)))

    def within(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        counted = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(some(g)))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(counted)

    return let(found, within)


def metrics(text: Column) -> Column:
    """All counts of a text as one struct of longs."""
    text = F.coalesce(text, F.lit(""))
    stops = stop_forms()

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(stops))).cast("long").alias("n_stop_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    worded = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        let(words(text), of_words).alias("w"),
        let(worded, of_lines).alias("l"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
    )


def judge(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = TABLE) -> DataFrame:
    """Counts and verdict of every row: the id, the counts, ``base_failed``, ``kept`` and ``failed_rules``."""
    counted = documents.select(F.col(id_column).alias("doc_id"), metrics(F.col(text_column)).alias("m"))
    at = {n: F.col(f"m.{n}") for n in ("n_symbols", "n_bangs")}
    at |= {n: F.col(f"m.w.{n}") for n in ("n_words", "word_chars", "n_repeat_words", "n_stop_words")}
    at |= {n: F.col(f"m.l.{n}") for n in ("n_lines", "n_dup_lines")}
    base_failed = ~(BASE[0].holds(at) & BASE[1].holds(at))
    failed = F.concat_ws(",", *[F.when(~r.holds(at), F.lit(f"{r.metric}{r.sense}{r.percent}%{r.per}")) for r in rules])
    return counted.select(
        "doc_id",
        *[at[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed.alias("base_failed"),
        (~base_failed & (failed == "")).alias("kept"),
        failed.alias("failed_rules"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same counts from DuckDB, over the same rule table."""
    stops = ", ".join(f"'{w}'" for w in stop_forms())
    failed = ", ".join(f"CASE WHEN NOT ({r.sql()}) THEN '{r.metric}{r.sense}{r.percent}%{r.per}' END" for r in TABLE)
    base = " AND ".join(r.sql() for r in BASE)
    return f"""
WITH texts AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
worded AS (SELECT k, doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
                  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM texts),
grams AS (SELECT k, unnest(range(1, len(w) - 1)) AS i, w FROM worded WHERE len(w) >= 3),
spelled AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM grams),
twins AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM spelled) WHERE c > 1),
covered AS (SELECT k, count(DISTINCT i + d) AS n FROM twins, (SELECT unnest([0, 1, 2]) AS d) GROUP BY k),
counted AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(t) - length(replace(t, '!', '')) AS n_bangs,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop_words
  FROM worded LEFT JOIN covered USING (k)),
judged AS (SELECT *, NOT ({base}) AS base_failed, concat_ws(',', {failed}) AS failed_rules FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND failed_rules = '') AS kept, failed_rules FROM judged
"""
