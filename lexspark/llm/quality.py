"""Quality rules in a short-circuit cascade, whose order comes from cost and selectivity on a sample.

All of it is built-in SQL functions. ``STATS`` derive counts from a text, rules are conditions on
counts. ``rule_order`` measures on a bounded sample what a rule costs, the derivation of its counts
included, and what it rejects, and puts the most rejection per second first. ``cascade`` joins the
rules into one CASE, which stops at the first that rejects. ``keep_good`` derives counts inside the
CASE where it can, and repeats, which cost most, only for texts that the rules ordered before them have left. ``judged``
has all counts as columns and decides on these. The order changes the time and the name of the rule
that is reported, never the verdict.
"""

from __future__ import annotations

import functools
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import n_words, set_aside, stored, table

_SPACE = " \t\n\x0b\x0c\r"
_SPACES = r"[\x20\x09-\x0D]+"
_SYMBOLS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(_SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPACES))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def windows_of(words: Column, width: int = 3) -> Column:
    """XXH64 of each window of ``width`` words."""
    last = F.size(words) - width
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)]))
    )


def repeats_of(placed: Column) -> Column:
    """Places, in order, of the windows that equal another one. ``placed``: a column of (h, i) in order of h."""
    same = lambda x, k: (F.get(placed, k - 1)["h"] == x["h"]) | (F.get(placed, k + 1)["h"] == x["h"])
    return F.sort_array(F.transform(F.filter(placed, lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"]))


def covered_words(places: Column, width: int = 3) -> Column:
    """Words that windows at ``places`` cover: each its whole width but for what the next one covers too."""
    own = F.transform(places, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(places, k + 1) - p, F.lit(width))))
    return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)


#: What ``text_stats`` adds.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _places(df: DataFrame) -> DataFrame:
    """``_places`` from ``_words``, in projections of their own, so that nothing is computed again in a lambda."""
    h = F.transform(windows_of(F.col("_words")), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("_placed", F.sort_array(h))
    return df.withColumn("_places", repeats_of(F.col("_placed"))).drop("_placed")


def _once(value: Column) -> Column:
    """``value``, in a projection that filters above it are not moved below: moved into the lambdas, it would be derived for every element."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def text_stats(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of ``text``, all long.

    A window of three words counts as repeated if its XXH64 is found twice in the text. Null and
    blank texts have 0 everywhere (symbols of a null text too). Columns of these names are replaced.
    """
    df = _places(docs.drop(*COUNTS).withColumn("_words", words_of(F.col("text"))))
    return df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.coalesce(F.regexp_count("text", F.lit(_SYMBOLS)), F.lit(0)).cast("long"),
        "n_dup_lines": duplicate_lines(F.col("text")),
        "n_repeat_words": _once(covered_words(F.col("_places"))),
    }).drop("_words", "_places")


#: What rules look at besides repeats, each from a text that is not null.
STATS: dict[str, Callable[[Column], Column]] = {
    "n_words": n_words,
    "word_chars": lambda t: F.length(F.regexp_replace(t, _SPACES, "")).cast("long"),
    "n_symbols": lambda t: F.regexp_count(t, F.lit(_SYMBOLS)).cast("long"),
    "n_dup_lines": duplicate_lines,
    "n_lines": lambda t: F.size(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))),
    "n_upper": lambda t: F.regexp_count(t, F.lit(r"\p{Lu}")),
    "n_exclamations": lambda t: F.regexp_count(t, F.lit("!")),
    "n_digits": lambda t: F.regexp_count(t, F.lit("[0-9]")),
}
Stat = Callable[[str], Column]


def derived(name: str) -> Column:
    """A statistic of the column ``text``, derived where it is used."""
    return STATS[name](F.coalesce(F.col("text"), F.lit("")))


def at_hand(columns: list[str]) -> Stat:
    """Statistics of ``text_stats`` that are columns already; the others are derived."""
    return lambda name: F.col(name) if name in COUNTS and name in columns else derived(name)


@dataclass(frozen=True)
class Rule:
    """A name, the condition on statistics under which a text is rejected, and whether ``n_repeat_words`` is one of them."""

    name: str
    rejects: Callable[[Stat], Column]
    repeats: bool = False


#: The base of the verdict.
BASE = (
    Rule("few_words", lambda s: s("n_words") < 50),
    Rule("repetition", lambda s: 100 * s("n_repeat_words") > 50 * s("n_words"), repeats=True),
)
#: The method's own, with limits that flowing prose keeps far from.
RULES = (
    Rule("symbols", lambda s: 10 * s("n_symbols") > s("n_words")),
    Rule("shouting", lambda s: 5 * s("n_upper") > 2 * s("word_chars")),
    Rule("exclamations", lambda s: 5 * s("n_exclamations") > s("n_words")),
    Rule("word_length", lambda s: (s("word_chars") > 12 * s("n_words")) | (2 * s("word_chars") < 5 * s("n_words"))),
    Rule("lines_again", lambda s: 2 * s("n_dup_lines") > s("n_lines")),
    Rule("digits", lambda s: 5 * s("n_digits") > s("word_chars")),
)


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = BASE + RULES, sample_rows: int = 2_000, seed: int = 7) -> list[tuple[Rule, float, float]]:
    """Rules with the seconds and the rejected share of each on a sample, the most rejection per cost first.

    The sample is a Bernoulli sample of about ``sample_rows`` rows (a documented bound: it sets the
    order only). Cost: the time that Spark takes to evaluate the rule with all that it derives over
    the stored texts, beyond the time of reading them. Ties go to the cheaper rule. An empty table
    leaves the rules as given.
    """
    rows = docs.count()
    if not rows:
        return [(r, 0.0, 0.0) for r in rules]
    sample = stored(docs.select("text").sample(min(1.0, sample_rows / rows), seed), "quality_sample").repartition(2).cache()
    total = max(1, sample.count())

    def timed(source: DataFrame, value: Column) -> tuple[float, int]:
        began = time.perf_counter()
        found = source.agg(value).first()[0]
        return time.perf_counter() - began, found or 0

    idle = min(timed(sample, F.count(F.col("text")))[0] for _ in range(2))
    found = []
    for r in rules:
        source, stat = (_repeats(_words(sample)), _own) if r.repeats else (sample, derived)
        seconds, rejected = timed(source, F.count_if(r.rejects(stat)))
        found.append((r, max(1e-4, seconds - idle), rejected / total))
    sample.unpersist()
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1]))


def first_reason(order: list[tuple[Rule, float, float]], stat: Stat) -> Column:
    """The first rule in the order that rejects, else null; a CASE, which stops there."""
    reason = F.lit(None).cast("string")
    for rule, _, _ in reversed(order):
        reason = F.when(rule.rejects(stat), F.lit(rule.name)).otherwise(reason)
    return reason


def cascade(docs: DataFrame, order: list[tuple[Rule, float, float]]) -> DataFrame:
    """``docs`` with ``rejected_by``; statistics that ``docs`` has as columns are not derived again."""
    return docs.withColumn("rejected_by", first_reason(order, at_hand(docs.columns)))


def judged(docs: DataFrame, sample_rows: int = 2_000) -> DataFrame:
    """``docs`` with its ``text_stats``, base_failed, rejected_by and kept.

    Every row gets a verdict. Null and blank texts fail the base for want of words. Columns with the names of new ones are
    replaced, all others stay. No rows: no rows.
    """
    docs, back = set_aside(docs, ("_words", "_places"))
    stats = text_stats(docs.drop("base_failed", "rejected_by", "kept"))
    base = functools.reduce(lambda a, b: a | b, [r.rejects(at_hand(stats.columns)) for r in BASE])
    own = cascade(stats, rule_order(docs, BASE + RULES, sample_rows))
    return own.withColumn("base_failed", base).withColumn("kept", F.col("rejected_by").isNull()).withColumnsRenamed(back)


def _words(df: DataFrame) -> DataFrame:
    df = df.withColumn("_words", _once(words_of(F.col("text"))))
    return df.withColumns({"_n_words": _once(F.size("_words").cast("long")), "_word_chars": _once(F.length(F.array_join("_words", "")).cast("long"))})


def _repeats(df: DataFrame) -> DataFrame:
    return _places(df).withColumn("_n_repeat_words", _once(covered_words(F.col("_places"))))


def _own(name: str) -> Column:
    return F.col(f"_{name}") if name in {"n_words", "word_chars", "n_repeat_words"} else derived(name)


def keep_good(docs: DataFrame, sample_rows: int = 2_000) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, its columns unchanged, whatever their names."""
    docs, back = set_aside(docs, ("_words", "_places", *[f"_{c}" for c in COUNTS]))
    order = rule_order(docs, BASE + RULES, sample_rows)
    late = next(i for i, (r, _, _) in enumerate(order) if r.repeats)
    left = _words(docs).where(first_reason(order[:late], _own).isNull())
    return _repeats(left).where(first_reason(order[late:], _own).isNull()).select(docs.columns).withColumnsRenamed(back)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)`` of every document."""
    found = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), lines AS (
  SELECT doc_id, text, words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM w
), windows AS (
  SELECT doc_id, g.i AS i, words[g.i] || chr(10) || words[g.i + 1] || chr(10) || words[g.i + 2] AS win
  FROM w, unnest(range(1, greatest(len(words) - 1, 1))) AS g(i)
), again AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM again, (VALUES (0), (1), (2)) AS t(o) GROUP BY doc_id
), stats AS (
  SELECT l.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_lines, len(regexp_extract_all(text, '\p{Lu}')) AS upper, len(regexp_extract_all(text, '!')) AS excl, len(regexp_extract_all(text, '[0-9]')) AS digits
  FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 5 * upper > 2 * word_chars OR 5 * excl > n_words
            OR word_chars > 12 * n_words OR 2 * word_chars < 5 * n_words OR 2 * n_dup_lines > n_lines OR 5 * digits > word_chars) AS kept
FROM stats
"""
