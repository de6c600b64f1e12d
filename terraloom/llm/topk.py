"""Exact top-k search by inner product with distributed histogram selection.

Queries go in blocks of a bounded number of rows (``query_block``, the only thing that is broadcast). For each block every
candidate is scored where it lies, in numpy, and only counts leave a task: a histogram of scores per query, from the
highest bin down until the task's own k best are covered (lower bins can't hold the global k-th score). Summed over all
tasks, the histograms locate the bin of each query's k-th score; that bin becomes the next range, until it is one score wide
or holds few rows. The last pass emits the rows at or above the bin, at most the k best of each task, ties to the
smaller id, and a window ranks them.

Memory of a task: query_block x 1024 scores and query_block x bins counts. A very common vector makes long ties; a task
still emits k rows a query at most.

Defined cases: vectors that are null, empty or hold null or non-finite values take no part, as query or candidate; vectors
of another length than the query's are no candidates of it; null ids take no part; rows that repeat an id count as
candidates each, but never for a query of that id, and equal query rows are asked once; fewer than k candidates: all are
returned; an empty table gives an empty result; scores beyond 63 bits are out of range and raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import written

CHUNK = 1024


def _matrix(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and the length of each row."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat, np.diff(column.offsets.to_numpy())


def quantised(flat: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * flat)


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while every partial sum is below 2^53, else in 63-bit integers, checked."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)
    if bound < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    raise OverflowError("a score has more than 63 bits")


def _chunks(batches: Iterator[pa.RecordBatch], dim: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        flat, sizes = _matrix(batch.column("vec"))
        ids = batch.column("id").to_numpy()
        keep = sizes == dim
        c = quantised(flat[np.repeat(keep, sizes)].reshape(-1, dim), scale)
        ids = ids[keep]
        for i in range(0, len(ids), CHUNK):
            yield ids[i : i + CHUNK], c[i : i + CHUNK]


def _scored(ids: np.ndarray, q: np.ndarray, qid: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and the mask of a query's own row."""
    return product(q, c), qid[:, None] == ids[None, :]


def best(qi: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query."""
    order = np.lexsort((ids, -score, qi))
    s = qi[order]
    rank = np.arange(len(s)) - np.searchsorted(s, s, side="left")
    return order[rank < k]


def _counting(sent, k: int, bins: int, scale: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q, low, width = sent.value
        table = np.zeros((len(qid), bins), np.int64)
        for ids, c in _chunks(batches, q.shape[1], scale):
            s, own = _scored(ids, q, qid, c)
            at = (s - low[:, None]) // width[:, None]
            at[own | (at < 0)] = -1
            at[at >= bins] = bins - 1
            rows, _ = np.nonzero(at >= 0)
            np.add.at(table, (rows, at[at >= 0]), 1)
        from_top = np.cumsum(table[:, ::-1], axis=1)[:, ::-1]
        qi, b = np.nonzero((table > 0) & (from_top - table < k))
        yield pa.RecordBatch.from_arrays([pa.array(qi, pa.int32()), pa.array(b, pa.int32()), pa.array(table[qi, b], pa.int64())], names=["q", "bin", "n"])

    return count


def _emitting(sent, k: int, scale: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q, low, _ = sent.value
        have = [np.zeros(0, np.int64)] * 3
        for ids, c in _chunks(batches, q.shape[1], scale):
            s, own = _scored(ids, q, qid, c)
            rows, cols = np.nonzero((s >= low[:, None]) & ~own)
            have = [np.concatenate(x) for x in zip(have, (rows, ids[cols], s[rows, cols]))]
            top = best(*have, k)
            have = [x[top] for x in have]
        yield pa.RecordBatch.from_arrays([pa.array(qid[have[0]], pa.int64()), pa.array(have[1], pa.int64()), pa.array(have[2], pa.int64())], names=["query_id", "vec_id", "score"])

    return emit


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, query_block: int = 4096, bins: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for every row that is_query (an expression over the id) selects."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", finite))
    asked = written(vectors.where(is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", finite)).distinct(), "queries")
    found = asked.groupBy(F.size("vec").alias("dim")).count().collect()
    out = []
    for dim, total in sorted((r["dim"], r["count"]) for r in found):
        blocks = -(-total // query_block)
        for b in range(blocks):
            here = asked.where((F.size("vec") == dim) & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).orderBy("id", "vec").toArrow()
            if here.num_rows:
                qid = here.column("id").to_numpy()
                flat, _ = _matrix(here.column("vec").combine_chunks())
                block = _block(spark, rows, qid, quantised(flat.reshape(-1, dim), scale), k, scale, bins)
                out.append(written(block, "top") if blocks > 1 else block)
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    both = out[0]
    for x in out[1:]:
        both = both.unionByName(x)
    return both


def _block(spark, rows: DataFrame, qid: np.ndarray, q: np.ndarray, k: int, scale: int, bins: int) -> DataFrame:
    """The k best of one block of queries."""
    sc = spark.sparkContext
    # |score| <= |query| * largest |candidate| (one number for all); the range is opened by one for rounding.
    longest = rows.select(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.pow(F.floor(F.lit(float(scale)) * x).cast("double"), 2))))).first()[0] or 0.0
    reach = np.ceil(np.sqrt((q**2).sum(axis=1)) * longest * (1 + 1e-9)).astype(np.int64) + 1
    low, width = -reach, np.maximum(1, -(-(2 * reach + 1) // bins))
    open_ = np.ones(len(qid), bool)
    need = np.full(len(qid), k)
    while open_.any():
        sent = sc.broadcast((qid, q, low, width))
        counts = rows.mapInArrow(_counting(sent, k, bins, scale), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.desc("bin"))
        held = counts.withColumn("upto", F.sum("n").over(down))
        # The first bin from the top that holds the k-th row; with fewer rows than k, the lowest bin that has any.
        reached = held.groupBy("q").agg(
            F.max(F.when(F.col("upto") >= k, F.col("bin"))).alias("bin"), F.min("bin").alias("least"), F.min(F.when(F.col("upto") >= k, F.col("upto"))).alias("upto")
        ).collect()
        seen = np.zeros(len(qid), bool)
        for r in reached:
            i = r["q"]
            seen[i] = True
            if not open_[i]:
                continue
            b = r["bin"] if r["bin"] is not None else r["least"]
            low[i] += b * width[i]
            if width[i] == 1 or r["bin"] is None or r["upto"] <= 4 * need[i]:
                open_[i] = False
            else:
                width[i] = max(1, -(-width[i] // bins))
        open_ &= seen
        sent.unpersist()
    sent = sc.broadcast((qid, q, low, width))
    near = rows.mapInArrow(_emitting(sent, k, scale), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
