"""Queries over units: modes, caps, ranks, lookups, rivals, exclusions, decks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.operators import association as A
from lexspark.operators import matching as K
from lexspark.operators import ranking as R
from lexspark.sources import deck
from lexspark.plans.tables import read


def event_modes(spark: SparkSession, d: str) -> DataFrame:
    return A.first_seen_mode(read(spark, d, "events"), ["user_id"], "event_type", F.col("event_id"))


def event_majorities(spark: SparkSession, d: str) -> DataFrame:
    return A.majority(read(spark, d, "events"), ["user_id"], "event_type", F.col("event_id"), 0.5)


def settled_variants(spark: SparkSession, d: str) -> DataFrame:
    """Part types under a noun: one variant wins a noun if it has a fifth of it; STANDARD is the bare noun."""
    p = read(spark, d, "part").select(F.element_at(F.split("p_name", " "), -1).alias("pair"), F.when(F.col("p_type") != "STANDARD", F.col("p_type")).alias("variant"), "p_partkey")
    stats = p.groupBy("pair", "variant").agg(F.count("*").alias("n"), F.min("p_partkey").alias("ord"))
    return A.settled_variants(stats, 0.22)


def capped_parts(spark: SparkSession, d: str) -> DataFrame:
    """Caps for each noun and then each adjective of part names, dearest first; large parts are excluded but hold their slots."""
    words = F.split("p_name", " ")
    p = read(spark, d, "part").select("p_partkey", "p_retailprice", "p_size", words[0].alias("adjective"), words[1].alias("noun"), (F.col("p_type") != "PROMO").alias("mined"))
    gone, rows = p.where("p_size > 48"), p.where("p_size <= 48")
    order = [F.desc("p_retailprice"), F.col("p_partkey")]
    taken = lambda head: gone.groupBy(head).agg(F.count("*").alias("n"))
    held = R.capped(rows, "noun", 60, order, taken("noun"), F.col("mined"))
    return R.capped(held, "adjective", 40, order, taken("adjective"), F.col("mined")).select("p_partkey", "adjective", "noun")


# How far a word's level pulls its count, from the easiest level on (survey W5).
LEVEL_PULL = (1.6, 1.25, 1.0, 0.75)


def _ranked_parts(spark: SparkSession, d: str) -> DataFrame:
    a, b, c, other = LEVEL_PULL
    weight = F.when(F.col("p_size") <= 10, a).when(F.col("p_size") <= 20, b).when(F.col("p_size") <= 35, c).otherwise(other)
    p = read(spark, d, "part").withColumn("score", F.round(F.col("p_retailprice") * weight, 4))
    return R.ranked(p, [(-F.col("score")), F.col("p_name"), F.col("p_partkey")])


def ranked_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts by price, pulled up or down by size, in one order over all."""
    return _ranked_parts(spark, d).select("p_partkey", "score", "rank")


def interleaved_parts(spark: SparkSession, d: str) -> DataFrame:
    """Six words to four phrases, each list in its own order."""
    held = _ranked_parts(spark, d).select("p_partkey", "p_type", "rank")
    words = R.ranked(held.where("p_type <> 'PROMO'"), [F.col("rank")], "place", 0)
    phrases = R.ranked(held.where("p_type = 'PROMO'"), [F.col("rank")], "place", 0)
    return R.interleaved(words, phrases, 0.6).select("p_partkey", "is_phrase", F.round("slot", 4).alias("slot"))


def pushed_back_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of the last size class out of the first three hundred."""
    held = _ranked_parts(spark, d).select("p_partkey", "p_size", "rank")
    return R.pushed_back(held, F.col("p_size") > 30, 300).select("p_partkey", "rank")


def first_of_names(spark: SparkSession, d: str) -> DataFrame:
    """The best ranked part of each name; later ones go and their ranks stay empty."""
    held = _ranked_parts(spark, d).select("p_name", "p_partkey", "rank")
    return R.first_rows(held, ["p_name"], [F.col("rank")])


def word_list(spark: SparkSession, d: str) -> DataFrame:
    """Words of benchmark passages looked up among part names: as a whole name, as a word of one, by its first letters."""
    words = read(spark, d, "benchmark").select(F.explode(F.array_distinct(X.letter_tokens(F.col("text")))).alias("word"))
    extra = read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    words = words.union(extra).distinct()
    units = read(spark, d, "part").select(F.col("p_partkey").alias("unit_id"), F.col("p_partkey").alias("rank"), "p_name")
    first = lambda c: F.substring(c, 1, 3)
    probes = [("name", F.col("word"), F.col("p_name")), ("token", F.col("word"), F.split("p_name", " ")), ("stem", first("word"), first("p_name"))]
    return K.matched_by_probes(words, units, probes)


def rival_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a brand and size that share a sense, under another noun."""
    p = read(spark, d, "part")
    units = p.select(
        F.col("p_partkey").alias("unit_id"), F.col("p_partkey").alias("rank"), F.col("p_brand").alias("kind"), F.element_at(F.split("p_name", " "), -1).alias("head"),
        F.concat(F.element_at(F.split("p_name", " "), 1), F.lit("/ to "), F.col("p_type"), F.lit("; a "), F.col("p_size")).alias("gloss"),
    )
    return K.rivals(units)


def grouped_parts(spark: SparkSession, d: str) -> DataFrame:
    """Names of one brand and size as curated groups; a group has as many names as the brand has in that size."""
    p = read(spark, d, "part")
    groups = p.groupBy(F.concat_ws(":", "p_brand", "p_size").alias("id")).agg(F.array_sort(F.collect_set("p_name")).alias("keys"))
    units = p.groupBy(F.col("p_name").alias("lemma_key")).agg(F.min("p_partkey").alias("unit_id")).where("unit_id % 2 = 0")
    return K.group_members(groups, units)


def prefix_extensions(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return K.prefix_extensions(p.select(F.col("p_name").alias("key")).union(p.select(F.element_at(F.split("p_name", " "), 1))).distinct())


def suffix_bases(spark: SparkSession, d: str) -> DataFrame:
    words = read(spark, d, "benchmark").select(F.explode(X.letter_tokens(F.col("text"))).alias("word")).distinct()
    return K.suffix_bases(words)


def candidate_hits(spark: SparkSession, d: str) -> DataFrame:
    """Order lines' parts: the first of three candidates that is a unit."""
    units = read(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("unit_id"))
    ids = F.array(F.col("l_partkey"), F.col("l_partkey") + 1, F.col("l_partkey") + 2)
    return K.candidate_hits(read(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("occ"), ids.alias("candidates")), units)


def kept_parts(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    units = p.select("p_partkey", F.col("p_type").alias("kind"), F.col("p_name").alias("key"))
    gone = p.where("p_partkey % 97 = 0").select(F.col("p_name").alias("entry")).union(p.where("p_partkey % 31 = 0").select(F.concat_ws(":", "p_type", "p_name")))
    return K.without_excluded(units, gone).select("p_partkey", "kind", "key")


def deck_problems(spark: SparkSession, d: str) -> DataFrame:
    """Parts as units and order lines as their cards: what an export would refuse."""
    units = read(spark, d, "part").where("p_partkey % 50 <> 7").select(F.col("p_partkey").cast("string").alias("unit_id"), F.pmod("p_partkey", F.lit(1990)).alias("rank"), (30 + F.pmod("p_partkey", F.lit(2))).alias("card_count"))
    cards = read(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("card_id"), F.col("l_partkey").cast("string").alias("unit_id"),
        F.concat_ws(" ", F.lit("to"), "l_returnflag", "l_linestatus").alias("gloss"), F.when(F.col("l_quantity") > 49, F.col("l_linestatus")).otherwise("zz").alias("answer"),
    )
    return deck.problems(units, cards).groupBy("problem").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def deck_hash(spark: SparkSession, d: str) -> DataFrame:
    return deck.content_hash(read(spark, d, "part"))


def shard_sizes(spark: SparkSession, d: str) -> DataFrame:
    held = _ranked_parts(spark, d).withColumn("band", deck.shard_of(F.col("rank")))
    return held.groupBy("band").agg(F.count("*").alias("n"), F.min("rank").alias("first"), F.max("rank").alias("last"))


def label_audit(spark: SparkSession, d: str) -> DataFrame:
    """For each source, documents that lack a review, are labelled low, or are toxic."""
    docs = read(spark, d, "documents").select("doc_id", "source")
    held = docs.join(read(spark, d, "labels"), "doc_id", "left")
    return held.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNull()).alias("unreviewed"), F.count_if(F.col("quality") == 0).alias("low"), F.count_if(F.col("toxic") == 1).alias("toxic"))


def shortest_texts(spark: SparkSession, d: str) -> DataFrame:
    """The shortest text of each source and language, of equals the first."""
    docs = read(spark, d, "documents").where("text is not null")
    best = F.min_by(F.struct("doc_id", F.length("text").alias("chars")), F.struct(F.length("text"), F.col("doc_id")))
    return docs.groupBy("source", "lang").agg(best.alias("b")).select("source", "lang", "b.doc_id", "b.chars")


def gloss_checks(spark: SparkSession, d: str) -> DataFrame:
    """Each turn as the gloss of the one before it."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    held = read(spark, d, "conversations").withColumn("english", F.lead("text").over(by)).where("english is not null")
    return held.select("conv_id", "turn", X.gloss_ok(F.col("text"), F.col("english")).alias("ok"))


def last_glosses(spark: SparkSession, d: str) -> DataFrame:
    """One row for each text of conversations, the one written last."""
    c = read(spark, d, "conversations")
    return c.groupBy("text").agg(F.max(F.struct("conv_id", "turn")).alias("m"), F.count("*").alias("n")).select("text", "m.conv_id", "m.turn", "n")


QUERIES = {
    f.__name__: f
    for f in (
        event_modes, event_majorities, settled_variants, capped_parts, ranked_parts, interleaved_parts, pushed_back_parts, first_of_names, word_list, rival_parts, grouped_parts,
        prefix_extensions, suffix_bases, candidate_hits, kept_parts, deck_problems, deck_hash, shard_sizes, label_audit, shortest_texts, gloss_checks, last_glosses,
    )
}

_MODE = """WITH p AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL),
m AS (SELECT user_id, event_type AS mode, n, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS share, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS i FROM p)"""
_RANKED = """WITH s AS (SELECT *, round(p_retailprice * CASE WHEN p_size <= 10 THEN 1.6::DOUBLE WHEN p_size <= 20 THEN 1.25::DOUBLE WHEN p_size <= 35 THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END, 4) AS score FROM part),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, p_name, p_partkey) AS rank FROM s)"""

ORACLES = {
    "event_modes": f"{_MODE} SELECT user_id, mode, n, share FROM m WHERE i = 1",
    "event_majorities": f"{_MODE} SELECT user_id, CASE WHEN share >= 0.5 THEN mode END AS mode, n, share FROM m WHERE i = 1",
    "settled_variants": """WITH s AS (SELECT string_split(p_name, ' ')[-1] AS pair, CASE WHEN p_type <> 'STANDARD' THEN p_type END AS variant, count(*) AS n, min(p_partkey) AS ord FROM part GROUP BY ALL),
t AS (SELECT pair, sum(n) AS total FROM s GROUP BY pair), b AS (SELECT pair, variant, n FROM s WHERE variant IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pair ORDER BY n DESC, ord) = 1)
SELECT s.pair, CASE WHEN any_value(b.n) / any_value(t.total) >= 0.22 THEN any_value(b.variant) END AS winner, CAST(sum(s.n) AS BIGINT) AS n, count(*) AS merged FROM s JOIN t ON s.pair = t.pair LEFT JOIN b ON s.pair = b.pair GROUP BY s.pair""",
    "capped_parts": """WITH p AS (SELECT p_partkey, p_retailprice, p_size, string_split(p_name, ' ')[1] AS adjective, string_split(p_name, ' ')[2] AS noun, p_type <> 'PROMO' AS mined FROM part),
g AS (SELECT * FROM p WHERE p_size > 48),
a AS (SELECT *, row_number() OVER (PARTITION BY mined, noun ORDER BY p_retailprice DESC, p_partkey) AS i FROM p WHERE p_size <= 48),
b AS (SELECT a.* FROM a WHERE NOT mined OR i <= greatest(60 - (SELECT count(*) FROM g WHERE g.noun = a.noun), 0)),
c AS (SELECT *, row_number() OVER (PARTITION BY mined, adjective ORDER BY p_retailprice DESC, p_partkey) AS j FROM b)
SELECT p_partkey, adjective, noun FROM c WHERE NOT mined OR j <= greatest(40 - (SELECT count(*) FROM g WHERE g.adjective = c.adjective), 0)""",
    "ranked_parts": f"{_RANKED} SELECT p_partkey, score, rank FROM r",
    "interleaved_parts": f"""{_RANKED}, l AS (SELECT p_partkey, CAST(p_type = 'PROMO' AS INTEGER) AS is_phrase, row_number() OVER (PARTITION BY p_type = 'PROMO' ORDER BY rank) - 1 AS place FROM r)
SELECT p_partkey, is_phrase, round(place / CASE WHEN is_phrase = 1 THEN 1.0::DOUBLE - 0.6::DOUBLE ELSE 0.6::DOUBLE END, 4) AS slot FROM l""",
    "pushed_back_parts": f"""{_RANKED}, h AS (SELECT p_partkey, rank, CAST(p_size > 30 AS INTEGER) AS m, coalesce(sum(CAST(p_size <= 30 AS INTEGER)) OVER w, 0) AS others, coalesce(sum(CAST(p_size > 30 AS INTEGER)) OVER w, 0) + CAST(p_size > 30 AS INTEGER) AS moved
  FROM r WINDOW w AS (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, (others < 300 AND moved > 0) AS inside FROM h), n AS (SELECT *, row_number() OVER (PARTITION BY inside ORDER BY m, rank) AS k, row_number() OVER (PARTITION BY inside ORDER BY rank) AS o FROM i)
SELECT a.p_partkey, b.rank FROM n a JOIN n b ON a.inside AND b.inside AND a.k = b.o UNION ALL SELECT p_partkey, rank FROM n WHERE NOT inside""",
    "first_of_names": f"{_RANKED} SELECT p_name, p_partkey, rank FROM r QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY rank) = 1",
    "word_list": r"""WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM benchmark UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part)),
h AS (SELECT w.word, 0 AS p, 'name' AS probe, p_partkey AS u FROM w JOIN part ON w.word = p_name
  UNION ALL SELECT w.word, 1, 'token', t.p_partkey FROM w JOIN (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS k FROM part) t ON w.word = t.k
  UNION ALL SELECT w.word, 2, 'stem', p_partkey FROM w JOIN part ON substr(w.word, 1, 3) = substr(p_name, 1, 3)),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY word ORDER BY p, u) = 1)
SELECT w.word, b.probe, b.u AS unit_id, b.u AS rank FROM w LEFT JOIN b ON w.word = b.word""",
    "rival_parts": """WITH s AS (SELECT p_partkey AS u, p_brand AS kind, string_split(p_name, ' ')[-1] AS head, unnest(list_distinct([string_split(p_name, ' ')[1], lower(p_type), CAST(p_size AS VARCHAR)])) AS sense FROM part),
g AS (SELECT kind, sense FROM s GROUP BY ALL HAVING count(*) BETWEEN 2 AND 12), h AS (SELECT s.* FROM s JOIN g ON s.kind = g.kind AND s.sense = g.sense),
p AS (SELECT DISTINCT a.u AS unit_id, b.u AS rival FROM h a JOIN h b ON a.kind = b.kind AND a.sense = b.sense AND a.u <> b.u AND a.head <> b.head)
SELECT * FROM (SELECT unit_id, rival, CAST(row_number() OVER (PARTITION BY unit_id ORDER BY rival) AS INTEGER) AS place FROM p) WHERE place <= 10""",
    "grouped_parts": """WITH g AS (SELECT DISTINCT p_brand, p_size, p_name FROM part), u AS (SELECT p_name, min(p_partkey) AS unit_id FROM part GROUP BY p_name HAVING min(p_partkey) % 2 = 0),
p AS (SELECT DISTINCT a.p_name AS key, b.p_name AS other FROM g a JOIN g b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_name <> b.p_name) SELECT key, other, unit_id FROM p LEFT JOIN u ON other = u.p_name""",
    "prefix_extensions": """WITH k AS (SELECT DISTINCT p_name AS key FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[1] FROM part) SELECT a.key, b.key AS longer FROM k a JOIN k b ON starts_with(b.key, a.key || ' ')""",
    "suffix_bases": r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM benchmark),
c AS (SELECT word, left(word, k) AS prefix, substr(word, k + 1) AS base FROM w, (VALUES (3), (4), (5), (6)) AS t(k) WHERE length(substr(word, k + 1)) >= 3)
SELECT c.word, c.prefix, c.base FROM c JOIN w ON c.base = w.word QUALIFY row_number() OVER (PARTITION BY c.word ORDER BY length(c.base) DESC) = 1""",
    "candidate_hits": """WITH c AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS occ, l_partkey + o AS unit_id, o AS place FROM lineitem, (VALUES (0), (1), (2)) AS t(o)), u AS (SELECT p_partkey FROM part WHERE p_size > 25)
SELECT occ, unit_id, CAST(place AS INTEGER) AS place FROM c JOIN u ON unit_id = p_partkey QUALIFY row_number() OVER (PARTITION BY occ ORDER BY place) = 1""",
    "kept_parts": """SELECT p_partkey, p_type AS kind, p_name AS key FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 97 = 0) AND p_type || ':' || p_name NOT IN (SELECT p_type || ':' || p_name FROM part WHERE p_partkey % 31 = 0)""",
    "deck_problems": """WITH u AS (SELECT CAST(p_partkey AS VARCHAR) AS unit_id, p_partkey % 1990 AS rank, 30 + p_partkey % 2 AS card_count FROM part WHERE p_partkey % 50 <> 7),
c AS (SELECT l_orderkey || '-' || l_linenumber AS card_id, CAST(l_partkey AS VARCHAR) AS unit_id, 'to ' || l_returnflag || ' ' || l_linestatus AS gloss, CASE WHEN l_quantity > 49 THEN l_linestatus ELSE 'zz' END AS answer FROM lineitem),
n AS (SELECT unit_id, count(*) AS n FROM c GROUP BY unit_id),
p AS (SELECT 'orphan card' AS problem, card_id AS id FROM c WHERE unit_id NOT IN (SELECT unit_id FROM u)
 UNION ALL SELECT 'card count', u.unit_id FROM u LEFT JOIN n ON u.unit_id = n.unit_id WHERE coalesce(n, 0) <> card_count
 UNION ALL SELECT 'repeated card', card_id FROM c GROUP BY card_id HAVING count(*) > 1
 UNION ALL SELECT 'repeated rank', min(unit_id) FROM u GROUP BY rank HAVING count(*) > 1
 UNION ALL SELECT 'gloss leak', card_id FROM c WHERE contains(lower(gloss), lower(answer)))
SELECT problem, count(*) AS n, min(id) AS first FROM p GROUP BY problem""",
    "shard_sizes": f"{_RANKED} SELECT CAST(floor((rank - 1) / 200) AS BIGINT) AS band, count(*) AS n, min(rank) AS first, max(rank) AS last FROM r GROUP BY 1",
    "label_audit": """SELECT source, count(*) AS n, count(*) FILTER (quality IS NULL) AS unreviewed, count(*) FILTER (quality = 0) AS low, count(*) FILTER (toxic = 1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source""",
    "shortest_texts": """SELECT source, lang, doc_id, CAST(length(text) AS INTEGER) AS chars FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY length(text), doc_id) = 1""",
    "gloss_checks": """WITH l AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS english FROM conversations)
SELECT conv_id, turn, coalesce(trim(english) <> '' AND NOT contains(english, chr(10)) AND length(text) > 0 AND length(english) / length(text) BETWEEN 0.4 AND 2.5, FALSE) AS ok FROM l WHERE english IS NOT NULL""",
    "last_glosses": """SELECT text, conv_id, turn, n FROM (SELECT *, count(*) OVER (PARTITION BY text) AS n FROM conversations) QUALIFY row_number() OVER (PARTITION BY text ORDER BY conv_id DESC, turn DESC) = 1""",
}
