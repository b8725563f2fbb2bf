"""Two-pass external shuffle into shards: scatter into memory-sized buckets, shuffle each, write it.

Pass one deals records into buckets by a seeded hash of doc_id and text; pass two puts each bucket
into a seeded random order (Fisher-Yates) and writes it. The buckets one after the other are one
random order of all records, which is cut into shards whose counts are at most one apart.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.llm.common import checkpoint, set_aside, shared_dir, table

#: Bytes of text that a bucket is meant to hold.
BUCKET_BYTES = 16 << 20


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A random order of n records that depends on the seed and the bucket only."""
    order = np.arange(n)
    np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)  # numpy's shuffle is Fisher-Yates
    return order


def _told_apart(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with ``_key``, a hash of the whole row and, for rows that repeat, of their number.

    Rows that repeat are found by their hashes and, if there are any, counted and set out again; the count
    is combined in each task first, however often a row repeats.
    """
    names = docs.columns
    docs = docs.withColumn("_row", F.xxhash64(F.lit(seed), *names))
    again = checkpoint(docs.groupBy("_row").agg(F.count("*").alias("n")).where("n > 1").select("_row"))
    single = docs.withColumn("_key", F.col("_row")).drop("_row")
    if again.isEmpty():
        return single
    single = docs.join(again, "_row", "left_anti").withColumn("_key", F.col("_row"))
    counted = docs.join(again, "_row", "left_semi").groupBy("_row", *names).agg(F.count("*").alias("_n"))
    several = counted.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).withColumn("_key", F.xxhash64("_row", "_i"))
    return single.select(*names, "_key").unionByName(several.select(*names, "_key"))


def shuffled_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 10, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write ``docs`` as Parquet to ``path``/shard=k in a random order and return what was written.

    Columns: those of ``docs`` and ``shard`` and ``slot`` (place in the shard, from 0, without
    gaps); columns of ``docs`` with these two names are replaced, all others stay (names that the work itself needs are written as ``aside0_...``). Counts of shards are at most one apart. The
    order depends on the seed, the rows and the number of buckets, not on partitioning; reruns
    agree. Equal texts are dealt apart, because doc_id is hashed too: law ``rows`` leaves no room to keep a
    group of copies in one shard. Rows that repeat as a whole are told apart by numbers, so a row that
    repeats without end is dealt over all buckets too. A text longer than a bucket is in one of its
    own size. Null ids and texts are hashed as such. No rows: an empty table.
    """
    spark = docs.sparkSession
    docs, back = set_aside(docs.drop("shard", "slot"), ("_bucket", "_key", "_row", "_n", "_i", "_start", "_place"))
    rows, size = docs.agg(F.count("*"), F.sum(record_size(F.col("text")))).first()
    if not rows:
        return docs.withColumns({"slot": F.lit(0).cast("long"), "shard": F.lit(0)}).where("false").withColumnsRenamed(back)
    buckets = max(1, -(-size // bucket_bytes))
    bucket = F.pmod(F.shiftright("_key", 20), F.lit(buckets)).cast("int")
    keyed = _told_apart(docs, seed)
    dealt = keyed.withColumn("_bucket", bucket)
    counts = checkpoint(keyed.select(bucket.alias("_bucket")).groupBy("_bucket").agg(F.count("*").alias("n")))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("_start"))
    schema = T.StructType([*docs.schema.fields, T.StructField("_bucket", T.IntegerType()), T.StructField("_place", T.LongType())])
    names = docs.columns

    def shuffle(t: pa.Table) -> pa.Table:
        bucket = t["_bucket"][0].as_py()
        t = t.sort_by("_key")
        t = t.take(pa.array(fisher_yates(len(t), seed, bucket)))
        return t.select([*names, "_bucket"]).append_column("_place", pa.array(np.arange(len(t))))

    mixed = dealt.groupBy("_bucket").applyInArrow(shuffle, schema)
    least, more = divmod(rows, shards)
    at = F.col("_start") + F.col("_place")
    cut = F.lit(more * (least + 1))
    shard = F.when(at < cut, F.floor(at / (least + 1))).otherwise(more + F.floor((at - cut) / max(least, 1)))
    slot = F.when(at < cut, F.pmod(at, F.lit(least + 1))).otherwise(F.pmod(at - cut, F.lit(max(least, 1))))
    placed = mixed.join(F.broadcast(starts) if buckets <= 100_000 else starts, "_bucket").withColumns({"shard": shard.cast("int"), "slot": slot.cast("long")})
    placed.select(*names, "slot", "shard").write.partitionBy("shard").parquet(path)
    written = T.StructType([*docs.schema.fields, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    return spark.read.schema(written).parquet(path).withColumnsRenamed(back)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of every document, read back from its shard."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    written = shuffled_shards(docs, f"{shared_dir(spark)}/lexspark-{uuid.uuid4().hex}/shards")
    return written.select(
        "doc_id", record_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
