"""Plane regions as trapezoids: differences and intersections of rings, their areas and connected parts, for whole tables of fields.

All rings of a field are cut by the heights of their vertices and of their crossings. Between two neighbouring heights sides neither begin, end nor cross, so
sorted by their middles they bound cells, and running counts of sides say which rings a cell lies in. Cells that are kept are trapezoids; two of
neighbouring slabs are connected if they share more than a point. Outlines are never rebuilt.

Keys are not null. A field's sides lie together, in its row or as one group, and are cut in numpy, a batch of fields at a time (`functions/trapezoids.py`). Coordinates are metres in
a local frame; slabs thinner than a nanometre are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom.functions import cutting, geo, trapezoids

# Executors get the numpy helpers with the job and need no installed package for them.
cloudpickle.register_pickle_by_value(cutting)
cloudpickle.register_pickle_by_value(trapezoids)

#: Metres: what is no height or no shared side.
THIN = trapezoids.THIN
_CELL = "slab int, cell int, y0 double, y1 double, l0 double, r0 double, l1 double, r1 double"


def ring_edges(rings: DataFrame, key: list[str], points: str, ring: Column) -> DataFrame:
    """A row (key, ring, x1, y1, x2, y2) per side of an open ring of (x, y)."""
    # An outer explode: for an inner one Spark infers a filter on the array and computes all that led to it again below.
    step = rings.select(*key, ring.alias("ring"), F.explode_outer(geo.edges(F.col(points))).alias("e")).where("e IS NOT NULL")
    return step.select(*key, "ring", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def worked(rows: DataFrame, key: list[str], out: str, make: Callable[[pa.RecordBatch], tuple[np.ndarray, list]]) -> DataFrame:
    """(key, out): what make gives for each batch of rows, the place in the batch of each result's row, and the results' columns."""
    kind = T.StructType([rows.schema[k] for k in key] + T.StructType.fromDDL(out).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in kind.fields[len(key) :]]
        for b in batches:
            with np.errstate(all="ignore"):
                at, columns = make(b)
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(at) for k in key], *[c if isinstance(c, pa.Array) else pa.array(c).cast(t) for c, t in zip(columns, kinds)]], kind.names)

    return rows.mapInArrow(run, kind)


def cells(edges: DataFrame, key: list[str], keep: str = "difference") -> DataFrame:
    """Trapezoids of ring 0 without the rings above it (``difference``) or within one of them (``intersection``), each ring by the even-odd rule.

    edges: (key, ring, x1, y1, x2, y2), any number of rings; returns (key, slab, cell, y0, y1, l0, r0, l1, r1): lefts and rights at the lower and the upper height.
    Cells are numbered from below and from the left.
    """
    corners = ("x1", "y1", "x2", "y2")
    rows = edges.groupBy(*key).agg(F.collect_list(F.struct("ring", *corners)).alias("sides"))

    def make(b: pa.RecordBatch) -> tuple[np.ndarray, list]:
        sides, begins = cutting.spread(b.column("sides"))
        ends = np.stack([cutting.number(sides.field(c)) for c in corners], 1)
        c = trapezoids.cells(ends, np.repeat(np.arange(b.num_rows), np.diff(begins)), sides.field("ring").to_numpy(zero_copy_only=False), keep)
        return c["field"], [c[f.split()[0]] for f in _CELL.split(", ")]

    return worked(rows, key, _CELL, make)


def field_cells(fields: DataFrame, key: list[str]) -> DataFrame:
    """The cells of each field's ring without its exclusions, with their part: cells() and parts() of field_edges(), made in the field's row."""

    def make(b: pa.RecordBatch) -> tuple[np.ndarray, list]:
        c = trapezoids.cells(*trapezoids.field_sides(b.column("ring"), b.column("exclusions")), "difference")
        return c["field"], [*[c[f.split()[0]] for f in _CELL.split(", ")], trapezoids.parts(c)]

    return worked(fields.select(*key, "ring", "exclusions"), key, _CELL + ", part int", make)


def cell_area() -> Column:
    return (F.col("y1") - F.col("y0")) * (F.col("r0") - F.col("l0") + F.col("r1") - F.col("l1")) / 2


def areas(trapezoids: DataFrame, key: list[str]) -> DataFrame:
    return trapezoids.groupBy(*key).agg(F.sum(cell_area()).alias("area_m2"))


def parts(trapezoids: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``part``: connected cells share a number, from 1 in the order of their first cells.

    A field's cells, a few rows that lie together, fold from below: a cell takes the least label that it touches in the slab below, and what it
    connects gets that label too.
    """
    columns = [c for c in trapezoids.columns if c not in key]
    rows = trapezoids.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("cell", *[c for c in columns if c != "cell"]))).alias("rows"))
    touches = lambda o, r: (o["slab"] == r["slab"] - 1) & (F.least(r["r0"], o["r1"]) - F.greatest(r["l0"], o["l1"]) > THIN)
    near = F.transform("rows", lambda r: F.struct(r["cell"].alias("cell"), F.transform(F.filter("rows", lambda o: touches(o, r)), lambda o: o["cell"]).alias("near")))
    lowest = lambda labels, r: F.array_min(F.concat(F.array(r["cell"]), F.transform(r["near"], lambda n: F.element_at(labels, n))))

    def joined(labels: Column, r: Column) -> Column:
        touched = lambda label: F.exists(r["near"], lambda n: F.element_at(labels, n) == label)
        return F.concat(F.transform(labels, lambda x: F.when(touched(x), lowest(labels, r)).otherwise(x)), F.array(lowest(labels, r)))

    # Each array is named twice below, so that it is computed once and not within the lambda that reads it.
    rows = rows.select(*key, "rows", near.alias("near"))
    labels = rows.select(*key, "rows", "near", F.aggregate("near", F.array().cast("array<int>"), joined).alias("labels")).select(*key, "rows", "labels", F.array_sort(F.array_distinct("labels")).alias("firsts"))
    out = labels.select(*key, "labels", "firsts", F.posexplode("rows").alias("at", "row"))
    return out.select(*key, *[F.col(f"row.{c}").alias(c) for c in columns], F.array_position("firsts", F.element_at("labels", F.col("at") + 1)).cast("int").alias("part"))


def field_edges(fields: DataFrame, key: list[str]) -> DataFrame:
    """Sides (key, ring, x1, y1, x2, y2) of each field's ring (0) and exclusions (from 1) in metres about the ring's mean. Exclusions that end within a millimetre of the perimeter reach it;
    rings of fewer than three points are left out."""

    def make(b: pa.RecordBatch) -> tuple[np.ndarray, list]:
        sides, field, ring = trapezoids.field_sides(b.column("ring"), b.column("exclusions"))
        return field, [ring, *sides.T.copy()]

    return worked(fields.select(*key, "ring", "exclusions"), key, "ring int, x1 double, y1 double, x2 double, y2 double", make)


def portions(fields: DataFrame, key: list[str]) -> DataFrame:
    """The usable portions of each field: connected parts of its ring without its exclusions, a row each.

    (key, portion, area_m2, anchor as lon/lat inside the portion, portions: how many the field has). Portions count from below and from the left; the anchor is
    the middle of the widest cell. A field without any usable part gives no row.
    """

    def make(b: pa.RecordBatch) -> tuple[np.ndarray, list]:
        c = trapezoids.cells(*trapezoids.field_sides(b.column("ring"), b.column("exclusions")), "difference")
        p = trapezoids.portions(c, trapezoids.parts(c))
        lon, lat = trapezoids.lonlat(p["x"], p["y"], b.column("ring"), p["field"])
        return p["field"], [p["part"], p["area"], pa.StructArray.from_arrays([pa.array(lon), pa.array(lat)], ["lon", "lat"]), p["portions"]]

    return worked(fields.select(*key, "ring", "exclusions"), key, "portion int, area_m2 double, anchor struct<lon:double,lat:double>, portions bigint", make)


def holding(points: DataFrame, trapezoids: DataFrame, key: list[str], value: str) -> DataFrame:
    """Points (key, x, y) with ``value`` of the trapezoid that holds them, null outside all; of two that share a side the lesser value counts."""
    t = trapezoids.select(*key, F.col(value).alias("t_value"), "y0", "y1", "l0", "r0", "l1", "r1")
    share = F.try_divide(F.col("y") - F.col("y0"), F.col("y1") - F.col("y0"))
    left, right = F.col("l0") + share * (F.col("l1") - F.col("l0")), F.col("r0") + share * (F.col("r1") - F.col("r0"))
    within = (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1")) & (F.col("x") >= left) & (F.col("x") <= right)
    return points.join(t, key, "left").withColumn("t_value", F.when(within, F.col("t_value"))).groupBy(*points.columns).agg(F.min("t_value").alias(value))
