"""Readers of the formats that corpora, logs, glosses and bills come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW_LOG = (
    "learner STRING, type STRING, seq BIGINT, ts TIMESTAMP, unit_id STRING, card_id STRING, rating STRING, outcome STRING, "
    "answers ARRAY<STRING>, expected ARRAY<STRING>, elapsed_ms BIGINT, deck_version STRING, known BOOLEAN, note STRING, review_ts TIMESTAMP"
)
GLOSSES = "german STRING, english STRING, source STRING, written_at TIMESTAMP"
COSTS = (
    "timestamp TIMESTAMP, model STRING, lane STRING, prompt_tokens BIGINT, completion_tokens BIGINT, cost_usd DOUBLE, "
    "purpose STRING, mode STRING, outcome STRING, attempt INT, call_id STRING, quota_type STRING"
)


def corpus_lines(spark: SparkSession, path: str, layout: str, source: str) -> DataFrame:
    """``(source, line_id, text)``. ``tatoeba``: id, language and text between tabs, shorter lines left out; ``lines``: id, tab, text or bare text."""
    raw = spark.read.text(path).where("trim(value) <> ''")
    part = F.split("value", "\t", 3 if layout == "tatoeba" else 2)
    if layout == "tatoeba":
        held = raw.where(F.size(part) >= 3).select(F.get(part, F.lit(0)).alias("line_id"), F.get(part, F.lit(2)).alias("text"))
    elif layout == "lines":
        bare = F.size(part) == 1
        held = raw.select(F.when(bare, F.lit("")).otherwise(F.get(part, F.lit(0))).alias("line_id"), F.when(bare, F.get(part, F.lit(0))).otherwise(F.get(part, F.lit(1))).alias("text"))
    else:
        raise ValueError(f"no such layout: {layout}")
    return held.select(F.lit(source).alias("source"), F.trim("line_id").alias("line_id"), F.trim("text").alias("text")).where("text <> ''")


def json_rows(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON-lines file, and ``(line)`` of those that are no such rows."""
    raw = spark.read.text(path).where("trim(value) <> ''")
    held = raw.select("value", F.from_json("value", f"{schema}, _bad STRING", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"))
    good = F.col("r").isNotNull() & F.col("r._bad").isNull()
    return held.where(good).select("r.*").drop("_bad"), held.where(~good).select(F.col("value").alias("line"))


def gloss_store(spark: SparkSession, path: str) -> DataFrame:
    """One gloss for each German sentence, the one written last; lines that are no glosses are left out."""
    rows, _ = json_rows(spark, path, GLOSSES)
    last = F.max_by(F.struct("english", "source", "written_at"), F.struct("written_at", "english"))
    return rows.where("german is not null and english is not null").groupBy("german").agg(last.alias("g")).select("german", "g.*")


def carriers(spark: SparkSession, path: str) -> DataFrame:
    """``(text, is_object)`` of lines that hold a JSON object with ``german`` or a sentence itself."""
    raw = spark.read.text(path).where("trim(value) <> ''").select(F.trim("value").alias("value"))
    held = F.from_json("value", "german STRING")["german"]
    is_object = F.startswith("value", F.lit("{"))
    return raw.select(F.when(is_object, held).otherwise(F.col("value")).alias("text"), is_object.alias("is_object")).where("text is not null")


def sentence_pairs(links: DataFrame, german: DataFrame, english: DataFrame) -> DataFrame:
    """``(german_id, german, english)``: linked sentences, of several the shortest translation."""
    held = links.join(german.select(F.col("id").alias("german_id"), F.col("text").alias("german")), "german_id")
    held = held.join(english.select(F.col("id").alias("english_id"), F.col("text").alias("english")), "english_id")
    return held.groupBy("german_id", "german").agg(F.min_by("english", F.struct(F.length("english"), "english")).alias("english"))


def frequency_ranks(spark: SparkSession, path: str) -> DataFrame:
    """``(word, rank)`` of a list of ``word count`` lines in order; letters only, each word at its first place."""
    from lexspark.functions.text import normalise

    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line"))
    words = lines.select("ord", normalise(F.get(F.split(F.trim("line"), r"\s+"), F.lit(0))).alias("word")).where(F.col("word").rlike(r"^\p{L}+$"))
    first = words.groupBy("word").agg(F.min("ord").alias("ord"))
    from pyspark.sql import Window

    return first.select("word", F.row_number().over(Window.orderBy("ord")).alias("rank"))


def billing(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(day, model, mode, direction, tokens, cost)`` of a bill, and ``(sku)`` that could not be read; undated rows are left out."""
    raw = spark.read.csv(path, header=True).where("try_to_timestamp(Date) is not null")
    sku = F.col("SKU description")
    number = lambda c: F.expr(f"try_cast(replace(`{c}`, ',', '') as double)")
    model = F.lower(F.regexp_extract(sku, r"(?i)(\w+(?:[ -][\w.]+)*?) (?:batch )?(input|output) token", 1))
    held = raw.select(
        F.to_date("Date").alias("day"), sku.alias("sku"), model.alias("model"), F.when(F.lower(sku).contains("batch"), "batch").otherwise("sync").alias("mode"),
        F.lower(F.regexp_extract(sku, r"(?i)(input|output) token", 1)).alias("direction"), number("Usage amount").alias("tokens"), number("Unrounded subtotal ($)").alias("cost"),
    )
    return held.where("direction <> ''").drop("sku"), held.where("direction = ''").select("sku").distinct()
