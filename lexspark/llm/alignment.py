"""Alignment of two tokenizers over a corpus, in Arrow arrays inside tasks and by Spark between them.

Both tokenizers cut the same bytes. Inside a task the tokens of a slice of texts are two list arrays: flattened, with the
parent index of each token, lengths in bytes and their cumulative sums that start anew in every document. Where tokens of
both end at the same byte of a document, an Acero hash join on (document, end) links them, and these
ends cut the document into groups. ``Table.group_by`` counts the linked pairs of each document; Spark
merges these partial counts to those of the corpus and brings them back to the documents.

A pair that is linked very often (" the" with "▁the") is on nearly every document. Pairs of more than one
``HOT_PAIRS``-th of all links, of which there are ``HOT_PAIRS`` at most, come back by a broadcast; the
rest, each on a small share of the rows, by a join on the pair.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import stored, table
from lexspark.llm.tokens import PATTERN

BYTE_LEVEL, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that are aligned at once; a longer text is a slice of its own.
SLICE = 1 << 20
#: Pairs with at least one in so many of all links are broadcast. There cannot be more of them than this.
HOT_PAIRS = 100_000
_LINKS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())]))


@functools.cache
def byte_level(path: str) -> tuple[object, pa.Array]:
    """The encoder of a byte-level vocabulary, without special tokens, and the bytes of each id."""
    import tiktoken

    with open(path, encoding="utf-8") as lines:
        model = json.load(lines)["model"]
    # Bytes that byte-level vocabularies write as themselves; all others are written from U+0100 on
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    entries = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte_of for c in token)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ranks = {entry: entries[entry] for entry in [bytes([b]) for b in range(256)] + [bytes(byte_of[c] for c in a + b) for a, b in pairs]}
    merged = list(ranks.values())[256:]
    if merged != sorted(merged) or len(merged) != len(pairs) or max(list(ranks.values())[:256]) > merged[0]:
        raise ValueError(f"{path}: the ids of the vocabulary do not follow its merges")
    return tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), _by_id({i: entry for entry, i in ranks.items()})


@functools.cache
def pieces(path: str) -> tuple[object, pa.Array]:
    """The encoder of a SentencePiece model and the bytes of each id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    of = lambda i: bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    return model, _by_id({i: of(i) for i in range(model.get_piece_size())})


def _by_id(entries: dict[int, bytes]) -> pa.Array:
    return pa.array([entries.get(i, b"") for i in range(max(entries) + 1)], pa.binary())


class _Tokens:
    """Tokens of several documents: ids, parents, ends in bytes from the start of their document."""

    def __init__(self, ids: pa.ListArray, entries: pa.Array) -> None:
        self.ids, self.parents = pc.list_flatten(ids), pc.list_parent_indices(ids)
        held = entries.take(self.ids)
        self.bytes = memoryview(held.buffers()[2] or b"")
        ends = pc.cumulative_sum(pc.cast(pc.binary_length(held), pa.int64()))
        self.places = np.asarray(ids.offsets)
        self.bounds = np.concatenate([[0], np.asarray(ends)])[self.places]
        self.ends = pc.subtract(ends, pa.array(self.bounds[:-1]).take(self.parents))

    def keyed(self, name: str) -> pa.Table:
        """``key`` (document and end), the id and the place of each token."""
        key = pc.add(pc.shift_left(pc.cast(self.parents, pa.int64()), pa.scalar(40, pa.int64())), self.ends)
        return pa.table({"key": key, name: self.ids, f"{name}_at": pa.array(np.arange(len(self.ids)))})


def aligned_texts(texts: list[str | None], a_path: str, b_path: str) -> pa.Table:
    """``(n_a, n_b, n_groups, n_links, groups, links)`` of each text."""
    (encoder, a_entries), (model, b_entries) = byte_level(a_path), pieces(b_path)
    asked = [i for i, t in enumerate(texts) if t]
    wanted = [f" {texts[i]}" for i in asked]
    of = pa.list_(pa.int32())
    a_ids = pa.array([encoder.encode_ordinary(t) for t in wanted], of)
    b_ids = pa.array(model.encode([t[1:] for t in wanted], num_threads=1) if wanted else [], of)
    a, b = _Tokens(a_ids, a_entries), _Tokens(b_ids, b_entries)
    same = np.ones(len(asked), bool)
    for i, t in enumerate(wanted):
        told = t.encode()
        same[i] = all(bytes(x.bytes[x.bounds[i] : x.bounds[i + 1]]) == told for x in (a, b))
    if not same.all():
        mask = pa.array(same)
        a, b = _Tokens(a_ids.filter(mask), a_entries), _Tokens(b_ids.filter(mask), b_entries)
    asked = np.array(asked, np.int64)[same]
    linked = a.keyed("a").join(b.keyed("b"), "key", join_type="inner", use_threads=False).sort_by([("key", "ascending"), ("a_at", "ascending"), ("b_at", "ascending")])
    keys = np.asarray(linked["key"])
    last = np.flatnonzero(np.diff(keys, append=-1))  # of each group; more than one link only where tokens have no bytes
    docs = keys >> 40
    joined = []
    for tokens, name in ((a, "a_at"), (b, "b_at")):
        ends = np.concatenate([[0], np.asarray(linked[name])[last] + 1])
        joined.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pc.cast(tokens.ids, pa.string())), ","))
    starts = np.searchsorted(docs[last], np.arange(len(asked) + 1))
    groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pc.binary_join_element_wise(*joined, "|")), ";")
    counted = pa.table({"doc": pa.array(docs), "a": linked["a"], "b": linked["b"]}).group_by(["doc", "a", "b"], use_threads=False).aggregate([([], "count_all")]).sort_by([(c, "ascending") for c in ("doc", "a", "b")])
    pairs = pa.StructArray.from_arrays([pc.cast(counted[c], pa.int32()).combine_chunks() for c in ("a", "b", "count_all")], ["a", "b", "n"])
    links = pa.ListArray.from_arrays(pa.array(np.searchsorted(np.asarray(counted["doc"]), np.arange(len(asked) + 1)), pa.int32()), pairs)

    # all texts again: those without tokens have none of anything
    place = np.full(len(texts), len(asked))
    place[asked] = np.arange(len(asked))
    spread = lambda values, none, kind: pa.concat_arrays([values, pa.array([none], kind)]).take(pa.array(place))
    count = lambda bounds: spread(pa.array(np.diff(bounds), pa.int64()), 0, pa.int64())
    return pa.table(
        {
            "n_a": count(a.places), "n_b": count(b.places), "n_groups": count(starts), "n_links": count(np.searchsorted(docs, np.arange(len(asked) + 1))),
            "groups": spread(groups, "", pa.string()), "links": spread(links, [], _LINKS),
        }
    )


def aligned(docs: DataFrame, text_col: str = "text", byte_level_path: str = BYTE_LEVEL, pieces_path: str = PIECES) -> DataFrame:
    """``docs`` without their texts, with ``n_a, n_b, n_groups, n_links, groups, links``.

    A reads a blank and the text, B the text, before which it puts the blank itself; special tokens'
    strings are ordinary text. ``groups`` has the ids of the tokens between common ends, as
    ``a1,a2|b1;a3|b2,b3``; ``links`` has ``(a, b, n)`` for each pair of ids whose tokens end together, n times in the
    text. Texts that are null, empty or that either tokenizer does not give back byte by byte have zeros, an empty
    string and an empty array. Whole texts are read. Columns with the names of new ones are replaced, others stay, repeated
    rows too. No rows: no rows.
    """
    made = ["n_a", "n_b", "n_groups", "n_links", "groups", "links"]
    names = [c for c in docs.columns if c not in {text_col, *made}]
    kinds = "array<struct<a:int,b:int,n:int>>"
    schema = docs.select(*names, *[F.lit(0).cast("long").alias(c) for c in made[:4]], F.lit("").alias("groups"), F.lit(None).cast(kinds).alias("links")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        for b in batches:
            filled = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(len(names))), 0), np.int64))
            at = 0
            while at < b.num_rows:
                upto = max(at + 1, int(np.searchsorted(filled, (filled[at - 1] if at else 0) + SLICE, side="right")))
                part = b.slice(at, upto - at)
                told = aligned_texts(part.column(len(names)).to_pylist(), byte_level_path, pieces_path)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *[told[c].combine_chunks() for c in made]], names=[*names, *made])
                at = upto

    return docs.select(*names, F.col(text_col)).mapInArrow(run, schema)


def pair_counts(alignments: DataFrame) -> DataFrame:
    """``(a, b, count, is_best)`` of all linked pairs of ids: their links in all documents, and whether no other pair of the same b has more."""
    counts = stored(alignments.select(F.inline("links")).groupBy("a", "b").agg(F.sum("n").alias("count")), "pair_counts")
    best = counts.groupBy("b").agg(F.max("count").alias("most"))  # as many rows as B has ids, at most
    return counts.join(F.broadcast(best), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("is_best"))


def with_counts(alignments: DataFrame) -> DataFrame:
    """``alignments`` with ``n_best`` (links whose pair is the commonest of its b) and ``count_sum`` (counts over all links).

    ``alignments`` should be a stored table: it is read once to count and once for each way back. Repeated rows count each; zeros without links.
    """
    row = "_" + max([*alignments.columns, "row"], key=len)  # longer than all other names, so another one
    alignments = stored(alignments.drop("n_best", "count_sum").withColumn(row, F.monotonically_increasing_id()), "alignments")
    rated = stored(pair_counts(alignments), "rated_pairs")
    least = (rated.agg(F.sum("count")).first()[0] or 0) / HOT_PAIRS
    links = alignments.select(F.col(row).alias("row"), F.inline("links"))
    hot, cold = F.broadcast(rated.where(F.col("count") >= least)), rated.where(F.col("count") < least)
    met = [links.join(hot, ["a", "b"]), links.join(hot, ["a", "b"], "left_anti").join(cold, ["a", "b"])]
    sums = [x.groupBy("row").agg(F.sum(F.when(F.col("is_best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")) for x in met]
    sums = sums[0].union(sums[1]).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    held = alignments.join(sums.withColumnRenamed("row", f"{row}_"), F.col(row) == F.col(f"{row}_"), "left")
    return held.select(*[c for c in alignments.columns if c != row], F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every document; the hash is of ``groups``, empty without tokens."""
    found = aligned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    hashed = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    told = with_counts(found.withColumn("groups_sha256", hashed).drop("groups"))
    return told.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
