"""Queries over sentences: carriers, n-grams, expressions, association, text scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.operators import association as A
from lexspark.operators import cards as C
from lexspark.operators import corpus, ngrams
from lexspark.storage import stored
from lexspark.plans.tables import EVERYDAY, LINES, lines, read

#: Occurrences that an n-gram or a pair needs, and words of the vocabulary.
FLOOR, WORDS = 5, 20_000
FUNCTION_WORDS = ["the", "of", "and", "to", "in", "is", "that", "with", "der", "die", "und", "la", "de", "le", "que", "y"]


def sentences_plausible(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("source", "line_id", "text")


def _priority():
    return F.substring("source", 4, 9).cast("int")


def sentences_owned(spark: SparkSession, d: str) -> DataFrame:
    return corpus.owned(lines(spark, d), _priority()).select("source", "line_id", "text", "copies")


def sentences_sampled(spark: SparkSession, d: str) -> DataFrame:
    return corpus.seeded_sample(lines(spark, d), 200).select("line_id", "text")


def sentence_shapes(spark: SparkSession, d: str) -> DataFrame:
    held = corpus.sentences(read(spark, d, "documents")).withColumn("reason", F.coalesce(X.shape_reason(F.col("text")), F.lit("fine")))
    return held.groupBy("source", "reason").agg(F.count("*").alias("n"))


def sentences_gated(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that are held in the benchmark too."""
    gate = read(spark, d, "benchmark").select(F.explode(X.sentences_of(F.col("text"))).alias("text")).distinct()
    return corpus.sentences(read(spark, d, "documents")).join(gate, "text", "left_semi").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts"))


def _ngrams(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    held = stored(lines(spark, d).select("source", "text"))
    words = stored(ngrams.vocabulary(held, WORDS))
    grams = ngrams.ngram_counts(held, words, EVERYDAY, FLOOR)
    return held, words, grams


def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    return _ngrams(spark, d)[2]


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    held, words, grams = _ngrams(spark, d)
    grams = stored(grams)
    total = held.agg(F.count("*").alias("total"))
    scored = ngrams.min_split_pmi(grams.crossJoin(F.broadcast(total)), words, F.col("total"))
    return grams, scored


def expressions_pmi(spark: SparkSession, d: str) -> DataFrame:
    """n-grams of everyday and other sources with their weakest seam in bits and their everyday share."""
    scored = _scored(spark, d)[1]
    return scored.select("ngram", "n", F.round("score", 6).alias("score"), F.round(F.col("everyday") / F.col("n"), 6).alias("everyday_share"))


def _candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    grams, scored = _scored(spark, d)
    scored = scored.withColumn("score", F.round("score", 6)).where("score >= 3").where(ngrams.carries_vocabulary(F.col("ngram"), FUNCTION_WORDS))
    return grams, stored(scored.select("ngram", "n", "score"))


def expressions_grown(spark: SparkSession, d: str) -> DataFrame:
    grams, chosen = _candidates(spark, d)
    return ngrams.grown(chosen, grams)


def expressions_selected(spark: SparkSession, d: str) -> DataFrame:
    """Grown expressions that are not part of a better one, with a share of everyday speech."""
    grams, chosen = _candidates(spark, d)
    kept = ngrams.without_contained(stored(ngrams.grown(chosen, grams)))
    held = kept.join(grams.select(F.col("ngram").alias("text"), "everyday", F.col("n").alias("all")), "text")
    return held.where(F.col("everyday") >= 0.05 * F.col("all")).select("text", "n", "score")


def word_sentences(spark: SparkSession, d: str) -> DataFrame:
    return A.word_sentences(lines(spark, d))


def pair_association(spark: SparkSession, d: str) -> DataFrame:
    held = A.pair_association(lines(spark, d), FLOOR)
    return held.withColumn("g2", F.round("g2", 4)).withColumn("lift", F.round("lift", 6))


def _totals(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).groupBy("source").agg(F.count("*").alias("sentences"))


def words_per_million(spark: SparkSession, d: str) -> DataFrame:
    weight = F.when(F.col("source").isin(EVERYDAY), 10.0).otherwise(1.0)
    return A.per_million(A.word_sentences(lines(spark, d)), _totals(spark, d), weight).withColumn("per_million", F.round("per_million", 3))


def expression_spread(spark: SparkSession, d: str) -> DataFrame:
    return A.register_spread(ngram_counts(spark, d), _totals(spark, d), EVERYDAY)


def text_keys(spark: SparkSession, d: str) -> DataFrame:
    """Normal forms, keys and ids of part names."""
    n = F.col("p_name")
    return read(spark, d, "part").select(
        "p_partkey", X.normalise(n).alias("normal"), X.slug(n).alias("slug"), X.ascii_fold(n).alias("folded"), X.transliterate(n).alias("spelled"),
        X.card_id(F.col("p_brand"), n).alias("card_id"), X.reserve_letter(n).alias("letter"), F.size(X.letter_tokens(n)).cast("long").alias("tokens"),
    )


def answer_slips(spark: SparkSession, d: str) -> DataFrame:
    """Words of the vocabulary and words one or two edits away: how they differ, and whether that is a slip."""
    words = stored(ngrams.vocabulary(lines(spark, d), 2_000).where(F.col("word").rlike("^[a-z]{4,}$")))
    # words that share a head or a tail of three letters; two edits leave one of them in longer words
    keys = F.explode(F.array(F.concat(F.lit("h"), F.substring("word", 1, 3)), F.concat(F.lit("t"), F.expr("right(word, 3)")))).alias("k")
    a, b = words.select("word", keys), words.select(F.col("word").alias("typed"), keys)
    pairs = a.join(b, "k").where("word <> typed and abs(length(word) - length(typed)) <= 1").select("word", "typed").distinct()
    near = pairs.where(F.levenshtein("word", "typed") <= 2)
    w, t = F.col("word"), F.col("typed")
    return near.select("word", "typed", F.levenshtein(w, t).alias("distance"), X.adjacent_transposition(w, t).alias("swapped"), X.common_prefix(w, t).alias("prefix"), X.typo(t, w).alias("slip"))


def carrier_cards(spark: SparkSession, d: str) -> DataFrame:
    """Six example sentences of each of the commonest longer words, with diverse forms, glossed ones first."""
    held = lines(spark, d)
    units = stored(ngrams.vocabulary(held, 3_000).where(F.length("word") >= 5).select(F.col("word").alias("unit_id")))
    tokens = held.select("source", "doc_id", "pos", "text", F.explode(X.letter_tokens(F.col("text"))).alias("unit_id"))
    occ = C.hosting_once(tokens.join(F.broadcast(units), "unit_id"))  # the vocabulary has a fixed bound
    glossed = F.pmod(F.crc32("text"), F.lit(3)) > 0
    score = C.sentence_score(F.col("text"), F.contains("text", F.lit(",")), glossed, F.when(F.col("source").isin(EVERYDAY), 0.0).otherwise(5.0))
    order = F.row_number().over(Window.partitionBy("unit_id").orderBy("doc_id", "pos"))
    rows = occ.withColumn("score", score).withColumn("ord", order).withColumn("form_key", F.pmod(F.length("text"), F.lit(4)))
    rows = rows.withColumn("kept", glossed & (F.pmod(F.col("doc_id"), F.lit(7)) == 0)).select("unit_id", "ord", "form_key", "score", "kept", "text")
    chosen = C.picked(rows, F.lit(6))
    return chosen.select("unit_id", "phase", "place", X.card_id(F.col("unit_id"), F.col("text")).alias("card_id"), "score")


QUERIES = {
    f.__name__: f
    for f in (
        sentences_plausible, sentences_owned, sentences_sampled, sentence_shapes, sentences_gated, ngram_counts, expressions_pmi, expressions_grown,
        expressions_selected, word_sentences, pair_association, words_per_million, expression_spread, text_keys, answer_slips, carrier_cards,
    )
}

def shape_sql(x: str) -> str:
    """The rules of shape as one CASE over a text."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    listed = lambda words: "(" + ", ".join(map(quoted, words)) + ")"
    low = "lower(w)"
    word = (
        f"{low} IN {listed(X.SWISS)} OR w IN {listed(X.SWISS_SMALL)} OR regexp_matches({low}, {quoted(X.SWISS_STEM)}) "
        f"OR (regexp_matches({low}, '(?:ei|eu|äu|ie)ss') AND {low} NOT IN {listed(X.OWN_DOUBLE_S)} AND NOT (starts_with({low}, 'weiss') AND w <> {low}))"
    )
    return (
        rf"CASE WHEN regexp_matches(regexp_extract({x}, '\p{{L}}'), '^[^\p{{Lu}}]') THEN 'not_capitalized' WHEN NOT regexp_matches({x}, {quoted(X.TERMINAL)}) THEN 'no_terminal_punctuation' "
        rf"WHEN len(list_filter(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+'), lambda w: {word})) > 0 OR regexp_matches({x}, {quoted(X.SWISS_NUMBER)}) THEN 'swiss_spelling' "
        rf"WHEN regexp_matches({x}, {quoted(X.MID_QUOTATION)}) THEN 'opens_mid_quotation' END"
    )


_WORD_COUNTS = r""", words AS (
  SELECT replace(w, 'ß', 'ss') AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM lines) GROUP BY 1 ORDER BY n DESC, word LIMIT 20000
)"""
_GRAMS = _WORD_COUNTS + r""", runs AS (
  SELECT source, string_split(replace(unnest(regexp_extract_all(lower(text), '\p{L}+(?: \p{L}+)*')), 'ß', 'ss'), ' ') AS r FROM lines
), raw AS (
  SELECT source, array_to_string(r[g.i : g.i + s.k - 1], ' ') AS ngram FROM runs, (VALUES (2), (3), (4)) AS s(k), unnest(range(1, greatest(len(r) - s.k + 2, 1))) AS g(i)
), counted AS (
  SELECT ngram, count(*) AS n, count(*) FILTER (source IN ('src0', 'src1', 'src2', 'src3')) AS everyday FROM raw GROUP BY ngram HAVING count(*) >= 5
), grams AS (
  SELECT * FROM counted WHERE ngram NOT IN (SELECT ngram FROM (SELECT ngram, unnest(string_split(ngram, ' ')) AS w FROM counted) WHERE w NOT IN (SELECT word FROM words))
)"""
_SCORED = _GRAMS + r""", halves AS (SELECT ngram AS part, n FROM grams UNION ALL SELECT word, n FROM words),
cuts AS (
  SELECT g.ngram, g.n, g.everyday, array_to_string(t[1 : c.i], ' ') AS l, array_to_string(t[c.i + 1 : len(t)], ' ') AS r
  FROM (SELECT *, string_split(ngram, ' ') AS t FROM grams) g, unnest(range(1, len(g.t))) AS c(i)
), scored AS (
  SELECT c.ngram, any_value(c.n) AS n, any_value(c.everyday) AS everyday,
         CASE WHEN bool_or(a.n IS NULL OR b.n IS NULL) THEN 0.0::DOUBLE
              ELSE min(log2((c.n / s.total::DOUBLE) / ((a.n / s.total::DOUBLE) * (b.n / s.total::DOUBLE)))) END AS score
  FROM cuts c LEFT JOIN halves a ON c.l = a.part LEFT JOIN halves b ON c.r = b.part, (SELECT count(*) AS total FROM lines) s GROUP BY c.ngram
)"""
_FUNCTION = ", ".join(f"'{w}'" for w in FUNCTION_WORDS)
_GROWN = _SCORED + rf""", chosen AS (
  SELECT ngram, n, round(score, 6) AS score FROM scored WHERE round(score, 6) >= 3
    AND CASE WHEN len(string_split(ngram, ' ')) = 2 THEN len(list_filter(string_split(ngram, ' '), lambda w: w NOT IN ({_FUNCTION}))) = 2
             ELSE len(list_filter(string_split(ngram, ' '), lambda w: w NOT IN ({_FUNCTION}))) >= 1 END
), longer AS (
  SELECT unnest(list_distinct([array_to_string(t[1 : len(t) - 1], ' '), array_to_string(t[2 : len(t)], ' ')])) AS text, ngram AS longer, n AS longer_n
  FROM (SELECT *, string_split(ngram, ' ') AS t FROM grams) WHERE len(t) > 2
), best AS (SELECT text, longer, longer_n FROM longer QUALIFY row_number() OVER (PARTITION BY text ORDER BY longer_n DESC, longer) = 1),
one AS (SELECT CASE WHEN longer_n >= 0.9 * n THEN longer ELSE ngram END AS text, CASE WHEN longer_n >= 0.9 * n THEN longer_n ELSE n END AS n, score FROM chosen LEFT JOIN best ON ngram = best.text),
two AS (SELECT CASE WHEN longer_n >= 0.9 * n THEN longer ELSE one.text END AS text, CASE WHEN longer_n >= 0.9 * n THEN longer_n ELSE n END AS n, score FROM one LEFT JOIN best ON one.text = best.text)"""
_WS = r""", ws AS (
  SELECT source, word, count(*) AS n FROM (SELECT source, unnest(list_distinct(regexp_extract_all(lower(text), '\p{L}+'))) AS word FROM lines) GROUP BY ALL
), totals AS (SELECT source, count(*) AS sentences FROM lines GROUP BY source)"""

ORACLES = {
    "sentences_plausible": f"WITH {LINES} SELECT source, line_id, text FROM lines",
    "sentences_owned": f"""WITH {LINES}
SELECT source, line_id, text, copies FROM (SELECT *, count(*) OVER (PARTITION BY text) AS copies FROM lines)
QUALIFY row_number() OVER (PARTITION BY text ORDER BY CAST(substr(source, 4) AS INTEGER), doc_id, pos) = 1""",
    "sentences_sampled": f"WITH {LINES} SELECT line_id, text FROM lines ORDER BY sha256('1:' || text), line_id LIMIT 200",
    "sentence_shapes": f"WITH {LINES} SELECT source, coalesce({shape_sql('text')}, 'fine') AS reason, count(*) AS n FROM sent GROUP BY ALL",
    "sentences_gated": rf"""WITH {LINES}, gate AS (SELECT DISTINCT unnest(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda x: trim(x))) AS text FROM benchmark)
SELECT source, count(*) AS n, count(DISTINCT text) AS texts FROM sent WHERE text IN (SELECT text FROM gate) GROUP BY source""",
    "ngram_counts": f"WITH {LINES}{_GRAMS} SELECT ngram, n, everyday FROM grams",
    "expressions_pmi": f"WITH {LINES}{_SCORED} SELECT ngram, n, round(score, 6) AS score, round(everyday / n, 6) AS everyday_share FROM scored",
    "expressions_grown": f"WITH {LINES}{_GROWN} SELECT text, n, max(score) AS score FROM two GROUP BY text, n",
    "word_sentences": f"WITH {LINES}{_WS} SELECT source, word, n FROM ws",
    "pair_association": rf"""WITH {LINES}, t AS (SELECT row_number() OVER () AS id, regexp_extract_all(lower(text), '\p{{L}}+') AS t FROM lines),
single AS (SELECT w, count(*) AS n FROM (SELECT id, unnest(list_distinct(t)) AS w FROM t) GROUP BY w),
pairs AS (SELECT a, b, count(DISTINCT id) AS pair FROM (SELECT id, t[g.i] AS a, t[g.i + 1] AS b FROM t, unnest(range(1, greatest(len(t), 1))) AS g(i)) GROUP BY a, b HAVING count(DISTINCT id) >= 5),
c AS (SELECT a, b, pair, x.n AS n_a, y.n AS n_b, (SELECT count(*) FROM lines) AS total, pair::DOUBLE AS o11, (x.n - pair)::DOUBLE AS o12, (y.n - pair)::DOUBLE AS o21, ((SELECT count(*) FROM lines) - x.n - y.n + pair)::DOUBLE AS o22
  FROM pairs JOIN single x ON a = x.w JOIN single y ON b = y.w),
e AS (SELECT *, n_a::DOUBLE * n_b / total AS e11, n_a::DOUBLE * (total - n_b) / total AS e12, (total - n_a)::DOUBLE * n_b / total AS e21, (total - n_a)::DOUBLE * (total - n_b) / total AS e22 FROM c)
SELECT a, b, pair, n_a, n_b, total,
  round(CASE WHEN least(o11, o12, o21, o22) < 0 THEN 0 ELSE 2 * (CASE WHEN o11 > 0 THEN o11 * ln(o11 / e11) ELSE 0 END + CASE WHEN o12 > 0 THEN o12 * ln(o12 / e12) ELSE 0 END
    + CASE WHEN o21 > 0 THEN o21 * ln(o21 / e21) ELSE 0 END + CASE WHEN o22 > 0 THEN o22 * ln(o22 / e22) ELSE 0 END) END, 4) AS g2,
  round((pair::DOUBLE / total) / ((n_a::DOUBLE / total) * (n_b::DOUBLE / total)), 6) AS lift FROM e""",
    "words_per_million": f"""WITH {LINES}{_WS}, w AS (SELECT *, CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM totals)
SELECT word, round(sum(w.w * 1e6 * ws.n / w.sentences) / (SELECT sum(w) FROM w), 3) AS per_million FROM ws JOIN w ON ws.source = w.source GROUP BY word""",
    "expression_spread": f"""WITH {LINES}{_GRAMS}, totals AS (SELECT source, count(*) AS sentences, source IN ('src0', 'src1', 'src2', 'src3') AS e FROM lines GROUP BY source),
r AS (SELECT *, sum(sentences) OVER (PARTITION BY e) AS register FROM totals)
SELECT ngram, source, CAST(round_even((CASE WHEN e THEN everyday ELSE n - everyday END) * sentences / register, 0) AS BIGINT) AS n
FROM grams, r WHERE CASE WHEN e THEN everyday ELSE n - everyday END > 0""",
    "text_keys": r"""SELECT p_partkey, replace(lower(trim(p_name)), 'ß', 'ss') AS normal,
  trim(regexp_replace(replace(replace(replace(replace(lower(p_name), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
  replace(translate(p_name, 'äöüÄÖÜ', 'aouAOU'), 'ß', 'ss') AS folded, replace(replace(replace(replace(lower(p_name), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss') AS spelled,
  substr(sha1(p_brand || chr(10) || p_name), 1, 12) AS card_id,
  CASE WHEN regexp_matches(translate(lower(substr(p_name, 1, 1)), 'äöüß', 'aous'), '^[a-z]$') THEN translate(lower(substr(p_name, 1, 1)), 'äöüß', 'aous') ELSE '_' END AS letter,
  CAST(len(regexp_extract_all(lower(p_name), '\p{L}+')) AS BIGINT) AS tokens FROM part""",
    "answer_slips": f"""WITH {LINES}{_WORD_COUNTS.replace("LIMIT 20000", "LIMIT 2000")}, w AS (SELECT word FROM words WHERE regexp_matches(word, '^[a-z]{{4,}}$')),
p AS (SELECT a.word AS word, b.word AS typed, levenshtein(a.word, b.word) AS distance FROM w a JOIN w b ON a.word <> b.word AND abs(length(a.word) - length(b.word)) <= 1
  AND (left(a.word, 3) = left(b.word, 3) OR right(a.word, 3) = right(b.word, 3)) WHERE levenshtein(a.word, b.word) <= 2),
q AS (SELECT *, (length(word) = length(typed) AND distance = 2 AND damerau_levenshtein(word, typed) = 1) AS swapped,
  (SELECT count(*) FROM unnest(range(1, least(length(word), length(typed)) + 1)) AS g(i) WHERE left(word, CAST(g.i AS INTEGER)) = left(typed, CAST(g.i AS INTEGER))) AS prefix FROM p)
SELECT word, typed, CAST(distance AS INTEGER) AS distance, swapped, CAST(prefix AS INTEGER) AS prefix,
  length(word) > 3 AND ((distance = 1 AND prefix < greatest(length(word), length(typed)) - 2) OR swapped) AS slip FROM q""",
}
