"""SimHash near-duplicates: 64-bit fingerprints of three-word shingles, linked within a Hamming distance, by vantage-point trees.

1. Fingerprints are made where the documents are read; only (id, text hash, fingerprint) goes on.
2. Distinct fingerprints are dealt to shards by a vantage-point tree. Its vantage points and radii come from a bounded sample,
   which decides only how even the shards are, never which pairs are found: by the triangle inequality, two fingerprints
   within ``reach`` of each other have distances to a vantage point that differ by ``reach`` at most, so everything
   within the boundary strip goes to both sides and each close pair meets in some shard.
3. Each shard goes on splitting in the same way down to small leaves, which are compared pair by pair. A shard returns
   a spanning forest of its links, never all pairs of a dense group.
4. Components of the forests' union give the groups.

Exact copies share a fingerprint, so a group of copies is one row in steps 2 to 4 however large it is.

Defined cases: a null text counts as empty; texts without words have fingerprint zero and are linked like any other;
null ids are kept, and a group without any id has a null component; rows that repeat an id are fingerprinted one by one;
an empty table gives an empty table; other columns are ignored by groups() and kept by unique().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import attach, parts, written
from terraloom.llm.components import components

SEED = 42
SLICE = 1 << 16
LEAF = 192


def shingle_hashes(text: str | None, n: int = 3) -> np.ndarray:
    """XXH64 of every n-word shingle, repeats included; bytes.lower and bytes.split know ASCII only, as is wanted."""
    w = (text or "").encode().lower().split()
    if len(w) <= n:
        shingles = [b" ".join(w)] if w else []
    else:
        shingles = map(b" ".join, zip(*(w[i:] for i in range(n))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], dtype=np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), SLICE):
        ones += np.unpackbits(h[i : i + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = np.array([majority(shingle_hashes(t.as_py())) for t in b.column("text")], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h"), pa.array(made, pa.int64())], names=["id", "h", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, fp) of every row: h is a hash of the text, fp the fingerprint as a signed number."""
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col), F.length(F.col(text_col))).alias("h"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(_fingerprints, "id long, h long, fp long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def split(points: np.ndarray, reach: int, tries: int = 8) -> tuple[np.uint64, int] | None:
    """A vantage point and radius: inside is at most the radius + reach - 1 away, outside at least the radius; None if no split helps."""
    best, found = 0.9 * len(points), None
    for vp in points[:: max(1, len(points) // tries)][:tries]:
        d = distance(points, vp)
        r = int(np.median(d))
        larger = max(int((d <= r + reach - 1).sum()), int((d >= r).sum()))
        if larger < best:
            best, found = larger, (vp, r)
    return found


def tree(sample: np.ndarray, reach: int, leaves: int, least: int = 16) -> list:
    """Nodes (vantage point, radius, inner child, outer child), children negative for shards: -1 - shard."""
    nodes: list = []
    shards = 0

    def grow(points: np.ndarray, share: float) -> int:
        nonlocal shards
        cut = split(points, reach) if share >= 2 and len(points) >= 2 * least else None
        if cut is None:
            shards += 1
            return -shards
        at = len(nodes)
        nodes.append(None)
        d = distance(points, cut[0])
        inner, outer = points[d <= cut[1] + reach - 1], points[d >= cut[1]]
        nodes[at] = (cut[0], cut[1], grow(inner, share * len(inner) / len(points)), grow(outer, share * len(outer) / len(points)))
        return at

    grow(sample, float(leaves))
    return nodes


def deal(fp: np.ndarray, nodes: list, reach: int) -> list[tuple[int, np.ndarray]]:
    """(shard, positions) of all fingerprints, those in a boundary strip in more than one shard."""
    out, todo = [], [(0 if nodes else -1, np.arange(len(fp)))]
    while todo:
        at, rows = todo.pop()
        if at < 0:
            out.append((-1 - at, rows))
        elif len(rows):
            vp, r, inner, outer = nodes[at]
            d = distance(fp[rows], vp)
            todo += [(inner, rows[d <= r + reach - 1]), (outer, rows[d >= r])]
    return out


def _dealing(sent, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            for shard, rows in deal(fp, sent.value, reach):
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), shard), pa.int32()), pa.array(fp[rows].view(np.int64))], names=["shard", "fp"])

    return run


def forest(fp: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) that connect all fingerprints of a shard that close pairs connect."""
    parent = np.arange(len(fp))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(a, b) -> None:
        for i, j in zip(a, b):
            i, j = root(i), root(j)
            if i != j:
                parent[max(i, j)] = min(i, j)

    def leaf(rows: np.ndarray) -> None:
        for i in range(0, len(rows), LEAF):
            here = rows[i : i + LEAF]
            for j in range(i, len(rows), LEAF):
                there = rows[j : j + LEAF]
                close = distance(fp[here][:, None], fp[there][None, :]) <= reach
                if i == j:  # a square: only the component of each row is needed
                    np.fill_diagonal(close, False)
                    if not close.any():
                        continue
                    label, old = np.arange(len(here)), None
                    close |= np.eye(len(here), dtype=bool)
                    while old is None or (label != old).any():
                        old, label = label, np.where(close, label[None, :], len(here)).min(axis=1)
                    moved = np.nonzero(label != np.arange(len(here)))[0]
                    join(here[moved], here[label[moved]])
                else:
                    for k in np.nonzero(close.any(axis=1))[0]:
                        near = there[close[k]]
                        join(np.full(len(near), here[k]), near)

    todo = [np.arange(len(fp))]
    while todo:
        rows = todo.pop()
        cut = split(fp[rows], reach) if len(rows) > LEAF else None
        if cut is None:
            leaf(rows)
        else:
            d = distance(fp[rows], cut[0])
            todo += [rows[d <= cut[1] + reach - 1], rows[d >= cut[1]]]
    roots = np.array([root(i) for i in range(len(fp))], dtype=np.int64)
    moved = np.nonzero(roots != np.arange(len(fp)))[0]
    return moved, roots[moved]


def _linking(reach: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        fp = np.unique(rows["fp"].to_numpy())
        a, b = forest(fp.view(np.uint64), reach)
        return pd.DataFrame({"u": fp[a], "v": fp[b]})

    return run


def links(distinct: DataFrame, reach: int = 2, shard_rows: int = 20_000, sample: int = 65_536) -> DataFrame:
    """(u, v): a spanning forest of the links between distinct fingerprints (column fp)."""
    n = distinct.count()
    leaves = max(1, n // shard_rows)
    # A share by hash rather than the first by hash: about ``sample`` numbers reach the driver in all, not from each task.
    share = int(min(1.0, sample / max(n, 1)) * (1 << 30))
    rows = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < share).select("fp").collect() if leaves > 1 else []
    drawn = np.sort(np.array([r["fp"] for r in rows], dtype=np.int64)).view(np.uint64)
    sent = distinct.sparkSession.sparkContext.broadcast(tree(drawn, reach, leaves) if len(drawn) else [])
    dealt = distinct.select("fp").mapInArrow(_dealing(sent, reach), "shard int, fp long")
    return dealt.repartition(parts(distinct), "shard").groupBy("shard").applyInPandas(_linking(reach), "u long, v long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, reach: int) -> tuple[DataFrame, DataFrame]:
    """All rows (id, h, fp), and (fp, first) for every distinct fingerprint: the smallest (id missing, id, h) of its group."""
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("missing"), F.col("id"), F.col("h"))).alias("first")
    distinct = written(rows.groupBy("fp").agg(first), "distinct")
    roots = components(links(distinct, reach))
    named = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    tops = named.groupBy("root").agg(F.min("first").alias("top"))
    return rows, named.join(tops, "root").select("fp", F.col("top").alias("first"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 2) -> DataFrame:
    """Per row: fingerprint in 16 hex digits, and component_id, the smallest id reachable over links."""
    rows, named = _grouped(docs, id_col, text_col, reach)
    out = rows.join(named, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"))


def unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 2) -> DataFrame:
    """One row of docs, with all its columns, for each group: the one of the smallest id, ties by the hash of the text."""
    _, named = _grouped(docs, id_col, text_col, reach)
    keep = named.select("first.id", "first.h").distinct().withColumn("kept", F.lit(True))
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col), F.length(F.col(text_col))).alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    chosen = attach(whole, keep, ["id", "h"]).where("kept")
    # Rows that repeat both id and text are the same document.
    order = F.row_number().over(Window.partitionBy("id", "h").orderBy(F.xxhash64(F.to_json("row"))))
    return chosen.withColumn("n", order).where("n = 1").select("row.*")
