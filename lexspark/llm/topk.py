"""Exact top-k search by integer inner product: columnar branch-and-bound over blocks of dimensions.

Queries and candidates are dealt into blocks of bounded size; each pair of blocks meets in one
cogrouped task. A candidate is sent once for each ``QUERY_BLOCK`` queries, so what is shuffled is the
product of both tables only beyond that many. There, scores are accumulated dimension block by dimension block over columns of
the candidates (vertical layout). After each block, Cauchy-Schwarz on what is left of both vectors
(their remaining mass) bounds the final score, and the candidates that can still be among the best
of a query are compacted for its next block. The best of each pair of blocks meet in a last ranking.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.llm.codes import usable, whole
from lexspark.llm.common import checkpoint, table

#: Queries and candidates that meet in a task, queries that are scored at once there, dimensions in a block.
QUERY_BLOCK, CANDIDATE_BLOCK, SCORED_AT_ONCE, DIMENSIONS = 8_192, 8_192, 256, 16
#: Components are multiplied by this before they are rounded down.
SCALE = 256


def _place(n: int) -> str:
    """A text that sorts as the whole number does, of any size."""
    digits = str(abs(n))
    key = f"{len(digits):06d}{digits}"
    return "1" + key if n >= 0 else "0" + key.translate(str.maketrans("0123456789", "9876543210"))


def _tails(m: np.ndarray, step: int) -> np.ndarray:
    """Lengths of the rows of ``m`` from dimension 0, step, 2 * step, ... on; a last column of 0."""
    squares = np.square(m.astype(np.float64))  # below 2 ** 126
    starts = np.arange(0, m.shape[1], step)
    parts = np.add.reduceat(squares, starts, axis=1)
    return np.sqrt(np.concatenate([np.cumsum(parts[:, ::-1], axis=1)[:, ::-1], np.zeros((len(m), 1))], axis=1))


def best_of_block(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, step: int = DIMENSIONS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (candidate ids, scores) of its k best candidates, ties to the smaller id, none with the query's own id.

    The first block of dimensions is one product for all queries; then each query keeps its own
    survivors: those whose score so far plus remaining mass reaches the k-th best of score so far
    less remaining mass. Integers in float64 are exact below 2 ** 53; larger ones stay integers, and where
    a product may leave 63 bits, scores are summed in Python's whole numbers, without bounds.
    """
    dims = q.shape[1]
    if int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * dims >= 2**62:
        exact = [[sum(map(operator.mul, x, y)) for y in c.tolist()] for x in q.tolist()]
        ids = c_ids.tolist()
        tops = [sorted((-s, at, n) for n, (s, at) in enumerate(zip(own, ids)) if at != one)[:k] for own, one in zip(exact, q_ids.tolist())]
        return [(np.array([at for _, at, _ in top], np.int64), np.array([*[-s for s, _, _ in top], None], dtype=object)[:-1]) for top in tops]
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * dims < 2**53:
        q, c = q.astype(np.float64), c.astype(np.float64)
    heavy = np.argsort(-np.square(c.astype(np.float64)).sum(0) * np.square(q.astype(np.float64)).sum(0), kind="stable")
    q, c = q[:, heavy], c[:, heavy]
    q_tail, c_tail, columns = _tails(q, step), _tails(c, step), np.ascontiguousarray(c.T)
    first = q[:, :step] @ columns[:step]
    found = []
    for i in range(len(q)):
        alive = np.flatnonzero(c_ids != q_ids[i])
        score = first[i, alive]
        for n, at in enumerate(range(step, dims, step), 1):
            if len(alive) > 4 * k:
                mass = (q_tail[i, n] * (1 + 1e-9)) * c_tail[alive, n] + 1e-6
                floor = np.partition(score - mass, len(alive) - k)[len(alive) - k]
                useful = score + mass >= floor
                alive, score = alive[useful], score[useful]
            score = score + q[i, at : at + step] @ columns[at : at + step, alive]
        if len(score) > k:
            tied = score >= np.partition(score, len(score) - k)[len(score) - k]
            alive, score = alive[tied], score[tied]
        top = np.lexsort((c_ids[alive], -score))[:k]
        found.append((c_ids[alive][top], score[top].astype(np.int64)))
    return found


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best rows other than the query's own for each row where ``queries``.

    Vectors that are null, empty or hold null or non-finite components take no part, as do rows without
    an id; vectors of different lengths never meet. Ties go to the smaller id; fewer rows than k: all of
    them. Rows of a repeated id are candidates of their own, none of them for a query of that id, and
    a repeated query counts once, by its smallest vector. Finite components may have any size: vectors are then
    sent as they are and scored in whole numbers of Python; a score that a long cannot hold is null, in its right rank.
    Other columns are not read. No rows: no rows.
    """
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"), queries.alias("is_query"))
    kept = kept.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("n", F.size("v")).where("n > 0")
    size = kept.agg(F.max(F.array_max(F.transform("v", F.abs))).alias("largest"), F.max("n").alias("dims")).first()
    largest = (size.largest or 0.0) * SCALE
    plain = largest < 2**52 and largest * largest * (size.dims or 0) < 2**62
    if plain:  # as integers; half the bytes on the way where they are small
        kept = kept.withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE).cast("int" if largest < 2**31 else "long")))
    kept = checkpoint(kept)
    asked = kept.where("is_query").groupBy("id", "n").agg(F.min("v").alias("v"))
    n_rows, n_asked = kept.count(), asked.count()
    parts, groups = -(-n_rows // CANDIDATE_BLOCK) or 1, -(-n_asked // QUERY_BLOCK) or 1
    one_of = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("id", "v", "n", one_of(groups, 1).alias("g"), every(parts).alias("p"))
    right = kept.select(*[F.col(c).alias(c) for c in ("id", "v", "n")], every(groups).alias("g"), one_of(parts, 2).alias("p"))

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(a) and len(b):
            dims = key[2].as_py()
            q, c = (np.asarray(t["v"].combine_chunks().flatten()).reshape(-1, dims) for t in (a, b))
            q, c = (m.astype(np.int64) if plain else whole(m, SCALE) for m in (q, c))
            q_ids, c_ids = (np.asarray(t["id"], dtype=np.int64) for t in (a, b))
            for i in range(0, len(q), SCORED_AT_ONCE):
                part = slice(i, i + SCORED_AT_ONCE)
                out += [(np.full(len(ids), one), ids, s) for one, (ids, s) in zip(q_ids[part], best_of_block(q[part], q_ids[part], c, c_ids, k))]
        cols = [np.concatenate(x) if out else np.empty(0, np.int64) for x in (zip(*out) if out else ([], [], []))]
        scores = [int(x) for x in cols[2]] if not plain else None
        fits = pa.array(cols[2], pa.int64()) if plain else pa.array([x if -(1 << 63) <= x < 1 << 63 else None for x in scores], pa.int64())
        place = pa.nulls(len(cols[0]), pa.string()) if plain else pa.array([_place(x) for x in scores], pa.string())
        return pa.table({"query_id": pa.array(cols[0]), "vec_id": pa.array(cols[1]), "score": fits, "place": place})

    keys = ("g", "p", "n")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long, place string")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score" if plain else "place"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the five best rows for each row of ``embeddings`` whose vec_id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
