"""Spatial joins by grid cells: both sides are dealt out by the cells that they touch, then tested exactly.

Cells bound what meets what, so there is no cross join; a pair that shares several cells is tested in one of them, that of the low corner of what their boxes share. A hot cell is one
side of a plain equi-join, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom.functions import cutting, geo, meeting

# Executors get the numpy helpers with the job and need no installed package for them.
cloudpickle.register_pickle_by_value(cutting)
cloudpickle.register_pickle_by_value(meeting)

CELL = 0.004


def _cells(ring: Column, size: float) -> Column:
    """All grid cells of a ring's box."""
    span = lambda c: F.sequence(F.floor(F.array_min(F.transform(ring, lambda p: p[c])) / size).cast("int"), F.floor(F.array_max(F.transform(ring, lambda p: p[c])) / size).cast("int"))
    return F.flatten(F.transform(span("lon"), lambda x: F.transform(span("lat"), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def points_in_parcels(points: DataFrame, parcels: DataFrame, key: list[str], size: float = CELL) -> DataFrame:
    """For every point (lon, lat) the first parcel (least ordinal) that contains it, null if none does."""
    p = points.select(*key, "lon", "lat", F.floor(F.col("lon") / size).cast("int").alias("cx"), F.floor(F.col("lat") / size).cast("int").alias("cy"))
    q = parcels.select("parcel_id", "ordinal", geo.edges(geo.open_ring(F.col("ring"))).alias("g"), F.explode(_cells(F.col("ring"), size)).alias("c")).select("parcel_id", "ordinal", "g", "c.cx", "c.cy")
    met = p.join(q, ["cx", "cy"]).where(geo.inside(F.col("lon"), F.col("lat"), F.col("g")))
    first = met.groupBy(*key).agg(F.min_by("parcel_id", "ordinal").alias("parcel_id"))
    return points.select(*key).join(first, key, "left")


def _gridded(rows: DataFrame, carry: list[str], side: str, size: float) -> DataFrame:
    """A row per grid cell of each ring's box: (carry, ring, its box x0, x1, y0, y1, all with the side's name behind, cx, cy); rings without points give none."""
    box = [f"{c}_{side}" for c in ("x0", "x1", "y0", "y1")]
    rows = rows.select(*carry, F.col("ring").alias(f"ring_{side}"))
    kind = T.StructType([*rows.schema.fields, *[T.StructField(c, T.DoubleType()) for c in box], T.StructField("cx", T.LongType()), T.StructField("cy", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, boxes = meeting.boxes(b.column(f"ring_{side}"))
            i, cx, cy = meeting.gridded(boxes, size)
            # Cells of wide boxes in pieces, so that their rings aren't copied all at once.
            for at in range(0, len(i), 1 << 14):
                mine = i[at : at + (1 << 14)]
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row[mine])) for c in b.columns], *[pa.array(v) for v in boxes[mine].T.copy()], pa.array(cx[at : at + (1 << 14)]), pa.array(cy[at : at + (1 << 14)])], kind.names)

    return rows.mapInArrow(run, kind)


def touching(fields: DataFrame, parcels: DataFrame, key: list[str], size: float = CELL) -> DataFrame:
    """Pairs of fields and parcels that intersect: sides cross, or one holds a vertex of the other."""
    a, b = _gridded(fields, key, "a", size), _gridded(parcels, ["parcel_id"], "b", size)
    x, y = F.greatest("x0_a", "x0_b"), F.greatest("y0_a", "y0_b")
    meet = (x <= F.least("x1_a", "x1_b")) & (y <= F.least("y1_a", "y1_b")) & (F.floor(x / size) == F.col("cx")) & (F.floor(y / size) == F.col("cy"))
    pair = a.join(b, ["cx", "cy"]).where(meet).select(*key, "parcel_id", "ring_a", "ring_b")
    own = [*key, "parcel_id"]

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            with np.errstate(all="ignore"):
                good = pa.array(meeting.meets(p.column("ring_a"), p.column("ring_b")))
            yield pa.RecordBatch.from_arrays([p.column(c).filter(good) for c in own], own)

    # Two rows of one key, or of one parcel, may both meet.
    return pair.mapInArrow(tested, pair.select(*own).schema).distinct()
