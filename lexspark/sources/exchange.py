"""Files that stages and devices exchange: occurrences, glosses, wanted carriers, word lists, pasted logs, decks; and joins that they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions.text import normalise
from lexspark.sources import readers
from lexspark.storage import stored

OCCURRENCES = (
    "kind STRING, unit_key STRING, parts ARRAY<STRING>, tokens ARRAY<STRUCT<i: INT, start: INT, end: INT, text: STRING>>, source STRING, line_id STRING, text STRING, "
    "form_key STRING, `case` STRING, evidence MAP<STRING, STRING>"
)
#: Units of the second mode of study have ids that begin with this.
DRILL_PREFIX = "pf:"
#: Escaped characters of JSON strings, which never end a string.
_ESCAPED = r"\\."


def write_occurrences(found: DataFrame, path: str) -> None:
    """Occurrences as JSON lines, one object each."""
    found.write.mode("errorifexists").json(path)


def read_occurrences(spark: SparkSession, *paths: str) -> DataFrame:
    """Occurrences of several stages as one table; lines that are none are left out."""
    found = None
    for path in paths:
        rows, _ = readers.json_rows(spark, path, OCCURRENCES)
        found = rows if found is None else found.unionByName(rows)
    return spark.createDataFrame([], OCCURRENCES) if found is None else found


def write_glosses(glosses: DataFrame, path: str) -> None:
    """One gloss for each sentence, the one written last, in the order of sentences over all files, so that equal tables give equal files.

    ``path`` must be new: readers see a table only once it is whole, and the table before stays as it is.
    """
    last = F.max_by(F.struct("english", "source", "written_at"), F.struct("written_at", "english"))
    one = glosses.where("german is not null and english is not null").groupBy("german").agg(last.alias("g")).select("german", "g.*")
    one.repartitionByRange("german").sortWithinPartitions("german").write.mode("errorifexists").json(path)


def wanted_carriers(spark: SparkSession, path: str) -> DataFrame:
    """``(source, line_id, text)`` of lines of source, id and text between tabs, or of a text alone, whose source and id are empty."""
    part = F.split(F.regexp_replace("value", r"\r+$", ""), "\t")
    whole = F.size(part) >= 3
    field = lambda i: F.when(whole, F.trim(F.get(part, F.lit(i)))).otherwise(F.lit(""))
    return spark.read.text(path).select(field(0).alias("source"), field(1).alias("line_id"), F.trim(F.element_at(part, -1)).alias("text")).where("text <> ''")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``(word)``: distinct words of a list with one a line, in normal form."""
    return spark.read.text(path).where("trim(value) <> ''").select(normalise(F.col("value")).alias("word")).distinct()


def _carried(pieces: DataFrame, value: Column, name: str) -> DataFrame:
    """``pieces`` with the sum of ``value`` over all pieces before: inside a split, and over the splits before, which are few rows a file."""
    held = pieces.withColumn("_value", value.cast("long"))
    own = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    splits = held.groupBy("file", "block").agg(F.sum("_value").alias("_total"))
    before = F.coalesce(F.sum("_total").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.join(splits.select("file", "block", before.alias("_before")), ["file", "block"])
    return held.withColumn(name, F.col("_before") + F.coalesce(F.sum("_value").over(own), F.lit(0))).drop("_value", "_before")


def concatenated_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON objects that stand one after the other with or without line ends, and ``(file, text)`` of what is no object of the schema, such as a cut tail.

    Files are read in splits like any text. They are cut at closing braces; whether a piece begins inside a string, how deep
    it is nested and how many objects ended before it are sums over the pieces before, carried from split to split. The pieces
    of an object are then put together, and only these.
    """
    raw = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    plain = F.regexp_replace("value", _ESCAPED, "")
    pieces = stored(raw.withColumn("parts", F.split(plain, '"')))
    pieces = _carried(pieces, F.size("parts") - 1, "quotes").withColumn("inside", F.col("quotes") % 2)
    outside = F.filter("parts", lambda x, i: (i + F.col("inside")) % 2 == 0)
    ends_outside = (F.col("inside") + F.size("parts") - 1) % 2 == 0
    opened = F.aggregate(outside, F.lit(0), lambda n, x: n + F.length(x) - F.length(F.replace(x, F.lit("{"))))
    pieces = stored(pieces.withColumn("delta", opened - ends_outside.cast("int")).withColumn("closes", ends_outside))
    pieces = _carried(pieces, F.col("delta"), "depth")
    done = F.col("closes") & (F.col("depth") + F.col("delta") == 0)
    pieces = _carried(stored(pieces.withColumn("done", done.cast("int"))), F.col("done"), "object")
    whole = pieces.groupBy("file", "object").agg(F.array_sort(F.collect_list(F.struct("block", "id", "value"))).alias("p"), F.max("done").alias("done"))
    text = F.concat(F.array_join(F.transform("p", lambda x: x["value"]), "}"), F.when(F.col("done") == 1, F.lit("}")).otherwise(F.lit("")))
    whole = stored(whole.select("file", F.trim(F.translate(text, "\r\n\t", "   ")).alias("text")).where("text <> ''"))
    held = whole.select("file", "text", F.from_json(F.expr("substring(text, greatest(locate('{', text), 1))"), f"{schema}, _bad STRING", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"))
    good = F.col("r").isNotNull() & F.col("r._bad").isNull()
    return held.where(good).select("r.*").drop("_bad"), held.where(~good).select("file", "text")


def append_log(entries: DataFrame, path: str, held: DataFrame | None = None) -> DataFrame:
    """Append ``entries`` as JSON lines, numbered on from ``held`` for each learner in the order of ``ts``; returns what was written."""
    place = F.row_number().over(Window.partitionBy("learner").orderBy("ts", "unit_id", "type"))
    numbered = entries.drop("seq").withColumn("seq", place.cast("long"))
    if held is not None:
        last = held.groupBy("learner").agg(F.max("seq").alias("_last"))
        numbered = numbered.join(last, "learner", "left").withColumn("seq", F.col("seq") + F.coalesce("_last", F.lit(0))).drop("_last")
    numbered = stored(numbered)
    numbered.write.mode("append").json(path)
    return numbered


def entries_of_mode(entries: DataFrame, verbs: bool) -> DataFrame:
    """The entries that one mode of study replays: those of its units, and entries without a unit."""
    drill = F.col("unit_id").startswith(DRILL_PREFIX)
    return entries.where(F.col("unit_id").isNull() | (drill if verbs else ~drill))


def corrected(entries: DataFrame) -> DataFrame:
    """``entries(learner, type, unit_id, ts, seq, rating, review_ts, ...)`` without corrections, reviews with the ratings that corrections give them.

    A correction names a unit and the time of its review; of several the one written last holds, whenever it came in. Corrections of
    reviews that are not there change nothing. Joined on learner, unit and time, so no learner's log is one task.
    """
    is_correction = F.col("type") == "correction"
    told = entries.where(is_correction).groupBy("learner", "unit_id", F.col("review_ts").alias("ts")).agg(F.max_by("rating", F.struct("ts", "seq")).alias("_rating"))
    told = told.withColumn("type", F.lit("review"))
    held = entries.where(F.coalesce(~is_correction, F.lit(True))).join(told, ["learner", "unit_id", "ts", "type"], "left")
    return held.withColumn("rating", F.coalesce("_rating", "rating")).select(*entries.columns)


def paired_glosses(lines: DataFrame, pairs: DataFrame, owner: str) -> DataFrame:
    """``lines(source, line_id, text)`` with ``english`` from ``pairs(id, german, english)``, null where nothing fits.

    Ids mean something only in the corpus that gave them, so only lines of ``owner`` are joined by id; all lines may match by their
    text. Of several translations the shortest holds, then the first by the alphabet. ``guard`` fails a table in which that was not kept.
    """
    shortest = F.min_by("english", F.struct(F.length("english"), "english"))
    by_id = pairs.groupBy(F.col("id").alias("line_id")).agg(shortest.alias("_by_id")).withColumn("source", F.lit(owner))
    by_text = pairs.groupBy(F.col("german").alias("text")).agg(shortest.alias("_by_text"))
    held = lines.join(by_id, ["source", "line_id"], "left").join(by_text, "text", "left")
    return held.select(*lines.columns, F.coalesce("_by_id", "_by_text").alias("english"))


def guard(glossed: DataFrame, pairs: DataFrame, owner: str) -> DataFrame:
    """``glossed(source, line_id, text, english)`` as it is; reading it fails if a line of another corpus has a gloss of ``pairs`` without having its text there.

    Lines without a source are of unknown corpora and pass; they can only have matched by text. The check is part of the plan, so no row leaves before its own check.
    """
    texts = pairs.select(F.col("german").alias("text")).distinct().withColumn("_known", F.lit(True))
    held = glossed.join(texts, "text", "left")
    wrong = F.col("english").isNotNull() & (F.coalesce("source", F.lit("")) != "") & (F.col("source") != owner) & F.col("_known").isNull()
    message = F.concat(F.lit("gloss of another corpus by id: "), F.coalesce("source", F.lit("")), F.lit(" "), F.coalesce("line_id", F.lit("")))
    checked = F.when(wrong, F.raise_error(message).cast("string")).otherwise(F.col("english"))
    return held.withColumn("english", checked).select(*glossed.columns)


def read_deck(spark: SparkSession, path: str, cards: str, units: str) -> tuple[DataFrame, DataFrame]:
    """Cards and units of a deck that ``deck.export`` wrote, by their schemas, without the columns of its folders."""
    return tuple(spark.read.schema(schema).json(f"{path}/{name}") for name, schema in (("cards", cards), ("units", units)))


def issue_reports(issues: DataFrame, units: DataFrame, cards: DataFrame) -> DataFrame:
    """``issues(ts, unit_id, card_id, note)`` as the learner met them: the unit, the sentence with its gaps in brackets, and what is no longer there.

    Cards have ``gaps``, structs of start and end in code points; gaps that overlap are taken as they come.
    """
    held = issues.join(units.select("unit_id", "display", "gloss", F.lit(True).alias("_unit")), "unit_id", "left").join(cards.select("card_id", "sentence", "gaps", F.lit(True).alias("_card")), "card_id", "left")
    back = F.reverse(F.array_sort("gaps"))
    around = lambda s, g: F.concat(F.substr(s, F.lit(1), g["start"]), F.lit("["), F.substr(s, g["start"] + 1, g["end"] - g["start"]), F.lit("]"), F.substr(s, g["end"] + 1))
    shown = F.aggregate(F.coalesce(back, F.array().cast(cards.schema["gaps"].dataType)), F.col("sentence"), around)
    gone = F.array_compact(F.array(F.when(F.col("_unit").isNull(), F.lit("unit")), F.when(F.col("_card").isNull(), F.lit("card"))))
    return held.select("ts", "unit_id", "card_id", "display", "gloss", F.when(F.col("_card"), shown).alias("sentence"), gone.alias("gone"), "note")
