"""Substring dedup: repeated spans of words found on a De Bruijn graph of k-word edges, verified at their source.

A window of k words is an edge from its first k - 1 words to its last k - 1. Only repeated edges
matter, and few are, so a cheap superset comes first: each window has a seed, the least hash among
its shorter runs of words. Equal windows have equal seeds, and neighbours mostly share theirs, so
there is about one seed row for five windows. Windows whose seed no other document holds are done.

The rest become edge rows with their coordinates and a second, independent hash. The first
occurrence of an edge, by doc_id and place, is its source; an edge counts as repeated there only if
the second hash at the source's coordinates agrees. A document that
holds an edge several times sends the first place alone, and a flag; what its spans cover is looked
up again in its text when they are removed. Consecutive edges of a document whose sources
advance in step are a nonbranching path; it compacts into one span (start, length, source document,
source start), in the task where that is known there, and spans are joined back to the documents. Whole texts that equal an earlier one are
a span already and make no edges.

Both shuffles of hashes are combined before they start: a task sends one row a hash for what it
does not know yet, and answers itself what it can, so a passage found in all documents is at most
one row a task under its hash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.llm.common import mix, rolling, set_aside, table, WordHashes

#: Words in a seed, and hashes that a task gathers before it sends them.
SEED_WORDS, GATHERED = 5, 4_000_000
_TOKEN = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def seeds_of(hashes: np.ndarray, window: int, short: int) -> np.ndarray:
    """The seed of each window of word hashes: its least rolling hash of ``short`` words."""
    least = rolling(hashes, short)
    width, done = window - short + 1, 1
    while done < width:  # minimum over runs of 1, 2, 4, ... and the rest
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    return least


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _scan_seeds(window: int, short: int):
    """Rows (key, doc_id, sure): a seed with the only document that holds it here, without one for several, and those several as sure."""

    def sent(parts: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        seed = np.concatenate([s for _, s in parts])
        doc = np.repeat(np.array([d for d, _ in parts], np.int64), [len(s) for _, s in parts])
        order = np.lexsort((doc, seed))
        seed, doc = seed[order], doc[order]
        new = np.r_[True, (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])]
        seed, doc = seed[new], doc[new]
        heads = _runs(seed)
        size = np.diff(np.r_[heads, len(seed)])
        alone, many = heads[size == 1], heads[size > 1]
        sure = np.repeat(size > 1, size)
        key = np.concatenate([seed[alone], seed[many], seed[sure] ^ mix(doc[sure].view(np.uint64) + _GOLD)])
        docs = np.concatenate([doc[alone], doc[many], doc[sure]])
        known = np.zeros(len(key), np.int8)
        known[len(alone) : len(alone) + len(many)], known[len(alone) + len(many) :] = 1, 2
        order = np.argsort(docs, kind="stable")
        key, docs, known = key[order], docs[order], known[order]
        return pa.RecordBatch.from_arrays([_long(key), pa.array(docs, mask=known == 1), pa.array(known)], names=["key", "doc_id", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, parts, held = WordHashes(), [], 0
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = (t.as_py() or "").encode().split()
                if len(words) < window:
                    continue
                found = np.unique(seeds_of(hashes.of(words), window, short))
                parts.append((d, found))
                held += len(found)
                if held >= GATHERED:
                    yield sent(parts)
                    parts, held = [], 0
        if parts:
            yield sent(parts)

    return run


#: ``at``: the place in the upper half, the second hash in the lower one; ``path``: a source that is known, and edges along it.
_EDGE = "key long, doc_id long, at long, path struct<src_doc:long,src_pos:int,n:int>"
_LOWER_HALF = 0xFFFFFFFF


def _scan_edges(window: int, short: int, names: list[str]):
    """Rows of ``_EDGE`` for windows with a marked seed. Those that a smaller document here has are known, and come as whole paths of n edges."""
    ids, texts, at_marks = names.index("doc_id"), names.index("text"), len(names)

    def sent(parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        edge, check, pos = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        doc = np.repeat(np.array([p[0] for p in parts], np.int64), [len(p[1]) for p in parts])
        order = np.lexsort((pos, doc, check, edge))
        edge, check, doc, pos = edge[order], check[order], doc[order], pos[order].astype(np.int32)
        again = np.r_[False, (edge[1:] == edge[:-1]) & (check[1:] == check[:-1]) & (doc[1:] == doc[:-1])]
        flagged = np.unique(doc[again])
        edge, check, doc, pos = edge[~again], check[~again], doc[~again], pos[~again]
        heads = np.flatnonzero(np.r_[True, (edge[1:] != edge[:-1]) | (check[1:] != check[:-1])]) if len(edge) else np.empty(0, np.int64)
        first = np.repeat(heads, np.diff(np.r_[heads, len(edge)]))
        later = doc > doc[first]
        # paths of edges whose source is here, as one row each
        d, p, sd, sp = doc[later], pos[later], doc[first][later], pos[first][later]
        order = np.lexsort((p, p - sp, sd, d))
        d, p, sd, sp = d[order], p[order], sd[order], sp[order]
        starts = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (sd[1:] != sd[:-1]) | (p[1:] - p[:-1] != 1) | (sp[1:] - sp[:-1] != 1)]) if len(d) else np.empty(0, np.int64)
        long = np.diff(np.r_[starts, len(d)]).astype(np.int32)
        flags = np.full(len(flagged), -1, np.int32)
        d, p, sd, sp = np.r_[d[starts], flagged], np.r_[p[starts], flags], np.r_[sd[starts], flagged], np.r_[sp[starts], flags]
        long = np.r_[long, flags + 1]
        ask = ~later
        key = np.r_[edge[ask], mix(d.view(np.uint64) + _GOLD)]
        docs = np.r_[doc[ask], d]
        at = np.r_[pos[ask].astype(np.int64) << 32 | check[ask].view(np.uint32), p.astype(np.int64) << 32]
        none = np.zeros(int(ask.sum()), np.int64)
        path = [np.r_[none, sd], np.r_[none, sp].astype(np.int32), np.r_[none, long].astype(np.int32)]
        known = np.r_[none.astype(bool), np.ones(len(d), bool)]
        order = np.lexsort((at, docs))  # neighbours of a document, which shuffle files then hold in few bytes
        struct = pa.StructArray.from_arrays([pa.array(x[order]) for x in path], ["src_doc", "src_pos", "n"], mask=pa.array(~known[order]))
        return pa.RecordBatch.from_arrays([_long(key[order]), pa.array(docs[order]), pa.array(at[order]), struct], names=["key", "doc_id", "at", "path"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, parts, held = WordHashes(), [], 0
        for b in batches:
            for d, t, marked in zip(b.column(ids).to_pylist(), b.column(texts), b.column(at_marks)):
                if d is None or not marked.is_valid:
                    continue
                h = hashes.of((t.as_py() or "").encode().split())
                at = np.flatnonzero(np.isin(seeds_of(h, window, short), np.asarray(marked.values).view(np.uint64)))
                parts.append((d, rolling(h, window)[at], (rolling(mix(h + _GOLD), window)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32), at))
                held += len(at)
                if held >= GATHERED:
                    yield sent(parts)
                    parts, held = [], 0
        if held:
            yield sent(parts)

    return run


def _unsalted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds of a document from keys; a sure key is the seed under the document's own mask."""
    for b in batches:
        doc, lists = np.asarray(b.column(0), np.int64), b.column(1)
        flat = lists.flatten()
        seed, known = np.asarray(flat.field(0)).view(np.uint64), np.asarray(flat.field(1))
        own = np.repeat(doc, np.diff(np.asarray(lists.offsets)))
        seed = np.where(known == 2, seed ^ mix(own.view(np.uint64) + _GOLD), seed)
        offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _long(seed))], names=["doc_id", "marks"])


def repeated_spans(docs: DataFrame, window: int = 13, seed_words: int = SEED_WORDS) -> DataFrame:
    """``(doc_id, start, n, src_doc, src_start)`` of ``docs(doc_id, text, ...)``.

    Words start..start+n of a document are windows of ``window`` words that all start in the smaller
    document src_doc, from src_start on. ``n`` is null for a text that equals src_doc's whole text. A
    window that a document holds several times is listed at its first place. No rows: no rows.
    """
    return _spans(docs, window, seed_words).where("start >= 0")


def _spans(docs: DataFrame, window: int = 13, seed_words: int = SEED_WORDS) -> DataFrame:
    """``repeated_spans``, and a row with start -1 for a document that holds windows several times."""
    if window <= seed_words:
        raise ValueError("a window must be longer than a seed")
    named = docs.where("doc_id is not null")
    # whole texts again: the SHA-256 of a text with its smallest doc_id
    sums = named.where("text is not null").select("doc_id", F.sha2("text", 256).alias("sum"))
    least = sums.groupBy("sum").agg(F.min("doc_id").alias("src_doc"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = sums.join(least, "sum").where("src_doc < doc_id").select("doc_id", "src_doc").distinct()
    # seeds that other documents hold too
    seeds = named.select("doc_id", "text").mapInArrow(_scan_seeds(window, seed_words), "key long, doc_id long, known byte")
    asked = seeds.withColumn("n", F.count("*").over(Window.partitionBy("key")))
    marked = asked.where("doc_id is not null and (known = 2 or n > 1)").withColumnRenamed("key", "seed")
    marks = marked.groupBy("doc_id").agg(F.collect_list(F.struct("seed", "known")).alias("marks"))  # a document's own seeds
    marks = marks.join(copies.select("doc_id"), "doc_id", "left_anti").mapInArrow(_unsalted, "doc_id long, marks array<long>")
    # edges with the first place that has them; the join keeps all columns, so that its shuffle serves the last join too
    held = docs.join(marks.withColumnRenamed("doc_id", "_doc"), F.col("doc_id") == F.col("_doc"), "left").drop("_doc")
    edges = held.mapInArrow(_scan_edges(window, seed_words, docs.columns), _EDGE)
    source = F.min(F.struct("doc_id", "at")).over(Window.partitionBy("key"))
    same = F.col("s.at").bitwiseAND(F.lit(_LOWER_HALF)) == F.col("at").bitwiseAND(F.lit(_LOWER_HALF))
    edges = edges.withColumn("s", source).where(F.col("path").isNotNull() | ((F.col("s.doc_id") < F.col("doc_id")) & same))
    place = lambda at: F.shiftright(at, 32).cast("int")
    edges = edges.select(
        "doc_id", place(F.col("at")).alias("pos"), F.coalesce("path.src_doc", "s.doc_id").alias("src_doc"),
        F.when(F.col("path").isNull(), place(F.col("s.at"))).otherwise(F.col("path.src_pos")).alias("src_pos"), F.coalesce("path.n", F.lit(1)).alias("n"),
    )
    # paths: edges one after the other in the document and in the source
    edges = edges.withColumn("shift", F.col("pos") - F.col("src_pos"))
    along = Window.partitionBy("doc_id").orderBy("src_doc", "shift", "pos")
    follows = (F.lag("src_doc").over(along) == F.col("src_doc")) & (F.lag("shift").over(along) == F.col("shift")) & (F.col("pos") <= F.lag(F.col("pos") + F.col("n")).over(along))
    paths = edges.withColumn("starts", (~F.coalesce(follows, F.lit(False))).cast("int")).withColumn("path", F.sum("starts").over(along))
    spans = paths.groupBy("doc_id", "path").agg(F.min("pos").alias("start"), (F.max(F.col("pos") + F.col("n")) - F.min("pos") + (window - 1)).alias("n"), F.min("src_doc").alias("src_doc"), F.min("src_pos").alias("src_start"))
    whole = copies.select("doc_id", F.lit(0).alias("start"), F.lit(None).cast("int").alias("n"), "src_doc", F.lit(0).alias("src_start"))
    return spans.select(whole.columns).unionByName(whole)


def _removal(schema: T.StructType, names: list[str], window: int):
    """Rows of ``names`` and spans to rows without the words of spans."""
    at = names.index("text")

    def elsewhere(words: list[bytes], keep: np.ndarray, spans: list[dict], hashes: WordHashes) -> None:
        """Take out the other places of the windows that spans hold."""
        told = rolling(hashes.of(words), window)
        held = np.zeros(len(told), bool)
        for s in spans:
            if s["start"] >= 0:
                held[s["start"] : s["start"] + s["n"] - window + 1] = True
        for i in np.flatnonzero(np.isin(told, np.unique(told[held]))).tolist():
            keep[i : i + window] = False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            texts, counts, removed, digests = [], [], [], []
            for t, spans in zip(b.column(at), b.column(len(names))):
                raw = t.as_py()
                data = (raw or "").encode()
                words = data.split()
                keep = np.ones(len(words), bool)
                own = spans.as_py() or []
                if any(s["n"] is None for s in own):
                    keep[:] = keep[:] & (len(words) < window)
                elif any(s["start"] >= 0 for s in own):
                    for s in own:
                        if s["start"] >= 0:
                            keep[s["start"] : s["start"] + s["n"]] = False
                    if any(s["start"] < 0 for s in own):
                        elsewhere(words, keep, own, hashes)
                gone = len(words) - int(keep.sum())
                if gone:
                    tokens = _TOKEN.findall(data)
                    held = [tokens[i] for i in np.flatnonzero(keep)]
                    raw = b"".join(held).decode()
                    words = [words[i] for i in np.flatnonzero(keep)]
                texts.append(raw)
                counts.append(len(keep))
                removed.append(gone)
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            cols = [pa.array(texts, b.column(at).type) if i == at else b.column(i) for i in range(len(names))]
            cols += [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return run


def without_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """``docs`` with ``text`` less its repeats, and n_words (before), n_removed, kept_sha256 (words joined by a space).

    A word goes if it is in a window of ``window`` words that also starts in a document with a
    smaller doc_id; windows are those of the input. The white space after a removed word goes with
    it. Texts that lose nothing stay as they are, null too. Rows with one doc_id are one document:
    their windows do not remove each other's. Rows without a doc_id are neither cut nor sources. doc_id must be a
    long. Columns with the names of the three new ones are replaced, all others stay. No rows: no rows.
    """
    docs, back = set_aside(docs.drop("n_words", "n_removed", "kept_sha256"), ("_doc", "_spans", "marks"))
    if docs.schema["doc_id"].dataType != T.LongType():
        raise TypeError("doc_id must be a long")
    spans = _spans(docs, window).groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("start", "n")).alias("_spans"))
    new = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType([*docs.schema.fields, *new])
    held = docs.join(spans, F.col("doc_id") == F.col("_doc"), "left").drop("_doc")
    return held.mapInArrow(_removal(schema, docs.columns, window), schema).withColumnsRenamed(back)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, g.i AS i, array_to_string(words[g.i : g.i + 12], ' ') AS win FROM w, unnest(range(1, greatest(len(words) - 11, 1))) AS g(i)
), again AS (
  SELECT doc_id, i FROM windows QUALIFY min(doc_id) OVER (PARTITION BY win) < doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + o AS i FROM again, range(0, 13) AS t(o)
), each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w
), kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS text, count(*) AS n FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(len(w.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
