"""Whitening of embeddings from exact integer covariances, counted on bit planes.

An entry c becomes the integer x = floor(1024 * c) + 100000. Shifted by its dimension's least value it is a short non-negative number, and the bits
of one place, over the rows of a block, are a bit plane: packed words of one bit a row. The sum of products of two dimensions is the sum over their
planes a and b of 2^(a + b) times the ones in the AND of both, so sums and cross-products of a block are counts of ones, exact whatever the
number of rows. Tasks add their blocks up and send one row per pair of dimensions, in limbs of 40 bits, which Spark sums; the driver
gets dimensions^2 / 2 numbers, whatever the rows. There n * (sum of products) - (product of sums) centres them as integers, and only then
they become doubles, for eigh.

Three passes read the vectors: for the least and largest values, for the planes, and for the result (with the covariance of the result,
``identity_error``, before it). No vector is shuffled. Work is rows x planes^2 / 128 words, some 10 microseconds a row for 64 dimensions of 13 bits.

Defined cases: vectors that are null, empty or hold a null or non-finite entry are dropped. If lengths differ, the commonest one (of those, the
longest) makes the space and vectors of others, which have no place in it, are dropped too. Null and repeated ids stay rows. Entries beyond the range of a long are
kept as exact wide integers. A component without variance (all, for a single vector or equal ones) has ``whitened`` null and ``explained`` 0; ``identity_error``
is over the others and null if there are none. ``deviation`` is null where it is too large for a long; ``deviation_digits`` has it always. Other columns of the input are
ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

SCALE, SHIFT = 1024, 100000
BLOCK = 4096
LIMB = 40


def _vectors(rows: DataFrame, vec_col: str) -> DataFrame:
    """rows whose vectors can take part, whatever their length."""
    entry = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return rows.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & F.forall(vec_col, lambda x: F.coalesce(entry(x.cast("double")), F.lit(False))))


def _floors(column: pa.Array, dims: int) -> np.ndarray:
    """floor(1024 * c) / 1024 as doubles, which hold it exactly and don't overflow; from 2^52 on that is c itself."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    small = np.abs(c) < 2.0**52
    return np.where(small, np.floor(np.where(small, c, 0.0) * SCALE) / SCALE, c)


def _integer(floor: float) -> int:
    return int(Fraction(floor) * SCALE)


def _shifted(floors: np.ndarray, low: list[int], narrow: bool) -> np.ndarray:
    """Integers from 0 up: int64 where every dimension's range fits, else Python's."""
    if narrow:
        # Both are exact as doubles and so is a difference below 2^53; wider ones go the other way.
        return (floors * SCALE - np.array([float(v) for v in low])).astype(np.int64)
    return np.array([[_integer(v) - s for v, s in zip(row, low)] for row in floors.tolist()], dtype=object).reshape(floors.shape)


def _planes(values: np.ndarray, widths: list[int]) -> np.ndarray:
    """(planes, words): for each dimension the bits of each place over the rows, packed into 64-bit words."""
    out = np.zeros((sum(widths), -(-len(values) // 64) * 8), np.uint8)
    at = 0
    for d, width in enumerate(widths):
        column = values[:, d]
        for a in range(width):
            bits = np.packbits(((column >> a) & 1).astype(np.uint8))
            out[at, : len(bits)] = bits
            at += 1
    return out.view(np.uint64)


def _weighted(ones: np.ndarray, starts: list[int], widths: list[int], i: int, j: int) -> int:
    """The cross-product of two dimensions from the counts of ones of their planes' ANDs."""
    part = ones[starts[i] : starts[i] + widths[i], starts[j] : starts[j] + widths[j]]
    return sum(int(part[a, b]) << (a + b) for a in range(widths[i]) for b in range(widths[j]))


def _scatter(dims: int, low: list[int], widths: list[int], narrow: bool):
    """Arrow batches of vectors -> one set of rows (i, j, limb, v) a task; j = -1 holds the sums of dimension i."""
    starts = [sum(widths[:d]) for d in range(dims)]

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(widths)
        pairs, single = np.zeros((total, total), np.int64), np.zeros(total, np.int64)
        for batch in rows:
            floors = _floors(batch.column(0), dims)
            for k in range(0, len(floors), BLOCK):
                planes = _planes(_shifted(floors[k : k + BLOCK], low, narrow), widths)
                single += np.bitwise_count(planes).sum(axis=1, dtype=np.int64)
                for p in range(total):
                    pairs[p, p:] += np.bitwise_count(planes[p] & planes[p:]).sum(axis=1, dtype=np.int64)
        pairs = np.maximum(pairs, pairs.T)
        out: list[tuple[int, int, int, int]] = []
        for i in range(dims):
            named = [(-1, sum(int(single[starts[i] + a]) << a for a in range(widths[i])))]
            named += [(j, _weighted(pairs, starts, widths, i, j)) for j in range(i, dims)]
            for j, v in named:
                for limb in range(max(1, -(-v.bit_length() // LIMB))):
                    out.append((i, j, limb, v >> (LIMB * limb) & (1 << LIMB) - 1))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["i", "j", "limb", "v"])

    return count


def _project(low: list[int], sums: list[int], n: int, unit: int, ways: np.ndarray, narrow: bool):
    """floors -> (whitened of each component, n * x - S as integers)."""
    # x - low has the sum S - n * low, so n * (x - low) - (S - n * low) is n * x - S.
    rest = [s - n * v for s, v in zip(sums, low)]

    def project(floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = _shifted(floors, low, narrow)
        big = narrow and n * int(values.max(initial=0)) + max(map(abs, rest)) >= 2**62
        if big or not narrow:
            values = values.astype(object)
        around = values * n - np.array(rest, dtype=values.dtype)
        centred = (around / (n * unit)).astype(np.float64)
        return centred @ ways, around

    return project


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8) -> DataFrame:
    """A row per vector and component: (id, component, n, deviation, whitened, explained, identity_error, deviation_digits)."""
    spark = vectors.sparkSession
    id_field: StructField = vectors.schema[id_col]
    schema = StructType([id_field]).add("component", "integer").add("n", "long").add("deviation", "long").add("whitened", "double").add("explained", "double").add("identity_error", "double").add("deviation_digits", "string")
    usable = _vectors(vectors, vec_col)
    size = usable.groupBy(F.size(vec_col).alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if size is None:
        return spark.createDataFrame([], schema)
    dims, n = size.dims, size.n
    usable = usable.where(F.size(vec_col) == dims)
    column = usable.select(F.transform(vec_col, lambda x: x.cast("double")).alias("v"))

    def ranges(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(dims, np.inf), np.full(dims, -np.inf)
        for batch in rows:
            floors = _floors(batch.column(0), dims)
            low, high = np.minimum(low, floors.min(axis=0, initial=np.inf)), np.maximum(high, floors.max(axis=0, initial=-np.inf))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(low), pa.array(high)], ["d", "low", "high"])

    found = column.mapInArrow(ranges, "d int, low double, high double").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()
    low, high = [_integer(r.low) for r in found], [_integer(r.high) for r in found]
    widths = [max(1, (b - a).bit_length()) for a, b in zip(low, high)]
    narrow = max(map(abs, low + high)) < 2**52
    counted = column.mapInArrow(_scatter(dims, low, widths, narrow), "i int, j int, limb int, v long").groupBy("i", "j", "limb").agg(F.sum("v").alias("v")).collect()
    exact: dict[tuple[int, int], int] = {}
    for r in counted:
        exact[r.i, r.j] = exact.get((r.i, r.j), 0) + (r.v << (LIMB * r.limb))

    # Centred as integers: n^2 times the covariance.
    scatter = [[n * exact[min(i, j), max(i, j)] - exact[i, -1] * exact[j, -1] for j in range(dims)] for i in range(dims)]
    # In units of which the squares of huge entries are doubles too; 1 but for entries beyond 10^130.
    unit = 1 << max(0, max(scatter[i][i] // (n * n) for i in range(dims)).bit_length() - 900) // 2
    cov = np.array([[float(Fraction(v, (n * unit) ** 2)) for v in row] for row in scatter])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    trace = float(Fraction(sum(scatter[i][i] for i in range(dims)), (n * unit) ** 2))
    shown = min(components, dims)
    alive = [bool(values[k] > dims * np.finfo(float).eps * values[0]) for k in range(shown)]
    ways = np.stack([axes[:, k] / np.sqrt(values[k]) if alive[k] else np.zeros(dims) for k in range(shown)], axis=1)
    explained = [float(values[k] / trace) if alive[k] else 0.0 for k in range(shown)]
    sums = [exact[i, -1] + n * low[i] for i in range(dims)]
    project = _project(low, sums, n, unit, ways, narrow)

    def moments(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(shown), np.zeros((shown, shown))
        for batch in rows:
            white, _ = project(_floors(batch.column(0), dims))
            total += white.sum(axis=0)
            square += white.T @ white
        at = [(i, j) for i in range(shown) for j in range(-1, shown)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in at], pa.int32()), pa.array([j for _, j in at], pa.int32()), pa.array([float(total[i] if j < 0 else square[i, j]) for i, j in at])], ["i", "j", "v"])

    sent = {(r.i, r.j): r.v for r in column.mapInArrow(moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    off = [abs(sent[i, j] / n - sent[i, -1] / n * (sent[j, -1] / n) - (i == j)) for i in range(shown) for j in range(shown) if alive[i] and alive[j]]
    error = max(off) if off else None

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            white, around = project(_floors(batch.column(1), dims))
            if around.dtype != object and int(np.abs(around).max(initial=0)) ** 2 * dims >= 2**63:
                around = around.astype(object)
            deviation = [int(v) for v in (around * around).sum(axis=1)]
            m = len(deviation)
            pick = np.repeat(np.arange(m), shown)
            dead = np.tile([not x for x in alive], m)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(pick)),
                    pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * shown, n, np.int64)),
                    pa.array([v if v < 2**63 else None for v in deviation], pa.int64()).take(pa.array(pick)),
                    pa.array(white.reshape(-1), mask=dead),
                    pa.array(np.tile(explained, m)),
                    pa.array([error] * (m * shown), pa.float64()),
                    pa.array([str(v) for v in deviation]).take(pa.array(pick)),
                ],
                schema.names,
            )

    return usable.select(id_col, F.transform(vec_col, lambda x: x.cast("double")).alias("v")).mapInArrow(emit, schema)
