"""What several operators of this subpackage share: reading, lineage cuts, hashes of words."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every contract of this subpackage has it: white space is these six ASCII characters only.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one only where that is unset and everything runs in one JVM."""
    sc = spark.sparkContext
    held = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not held:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        held = f"file://{tempfile.mkdtemp(prefix='lexspark-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(held)
    return held


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: smaller than a checkpoint, column-pruned later."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexspark-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns of these names renamed to fresh ones, and the way back for ``withColumnsRenamed``; case does not tell names apart."""
    taken, asked, fresh = {c.lower() for c in df.columns}, {n.lower() for n in names}, {}
    for c in df.columns:
        if c.lower() in asked:
            fresh[c] = next(f"aside{i}_{c}" for i in itertools.count() if f"aside{i}_{c}".lower() not in taken)
    return df.withColumnsRenamed(fresh), {new: old for old, new in fresh.items()}


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_unit(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the parts only: 32 bits of MD5, the same in any SQL engine."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


class WordHashes(dict):
    """XXH64 of words, kept for the words seen last; emptied when it has grown to ``most`` entries."""

    def __init__(self, most: int = 400_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 42)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash, so that all of its bits depend on all bits of ``x``."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[j : j + n]
    return mix(out)
