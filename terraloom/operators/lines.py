"""Polylines against rings, for whole tables of fields: clipping, trimming, and which portion a vine row belongs to.

A polyline is a set of rows (key, line, seq, x, y) in metres, or a row with its points as an array; rings lie in their field's row as arrays. Lines meet their field's rings by an equi-join on
the key. Cutting and trimming work on batches of paths in numpy, and so does what asks which portion a line of a field belongs to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom.functions import cutting, geo, trapezoids
from terraloom.functions.cutting import JOINED, ON_SIDE
from terraloom.operators import slabs

# Executors get the numpy helpers with the job and need no installed package for them.
cloudpickle.register_pickle_by_value(cutting)
cloudpickle.register_pickle_by_value(trapezoids)


def segments(points: DataFrame, key: list[str]) -> DataFrame:
    """(key, line, seg, ax, ay, bx, by): consecutive points of each line."""
    w = Window.partitionBy(*key, "line").orderBy("seq")
    step = points.select(*key, "line", "seq", "x", "y", F.lag("x").over(w).alias("px"), F.lag("y").over(w).alias("py"), F.row_number().over(w).alias("n"))
    return step.where("n > 1").select(*key, "line", (F.col("n") - 1).alias("seg"), F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))


def _on(x: Column, y: Column, e: Column) -> Column:
    """Whether (x, y) lies on a side, up to ON_SIDE."""
    dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
    t = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide((x - e["a"]["x"]) * dx + (y - e["a"]["y"]) * dy, dx * dx + dy * dy))), F.lit(0.0))
    return F.hypot(x - e["a"]["x"] - t * dx, y - e["a"]["y"] - t * dy) <= ON_SIDE


def _crosses(x: Column, y: Column, e: Column) -> Column:
    a, b = e["a"], e["b"]
    return ((a["y"] > y) != (b["y"] > y)) & (x < F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"])


def paths(points: DataFrame, own: list[str], *columns: str) -> DataFrame:
    """A row per polyline: (own, path, an array of (x, y) in order, and the named columns of one of its points)."""
    found = points.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("path"), *[F.first(c).alias(c) for c in columns])
    return found.withColumn("path", F.transform("path", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))))


def clipped(met: DataFrame, carry: list[str], inside: bool = True) -> DataFrame:
    """The pieces of paths (carry, path, sides) within their rings (or outside): (carry, piece, path, length_m), a row each.

    A segment is cut wherever a side meets it, each part is judged by its middle, and parts that follow each other are one piece, in numpy, a batch of paths at a time.
    """
    kind = T.StructType([met.schema[c] for c in carry] + [T.StructField("piece", T.LongType()), met.schema["path"], T.StructField("length_m", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points, begins = cutting.spread(b.column("path"))
            sides = cutting.spread(b.column("sides"))
            sides = cutting.padded(cutting.corners(sides[0]), sides[1])
            seg, path = cutting.segments(cutting.number(points.field("x")), cutting.number(points.field("y")), begins)
            with np.errstate(all="ignore"):
                x, y, begins, owner, piece = cutting.pieces(seg, path, sides, lambda x, y, p: cutting.holds(x, y, sides[p]) == inside)
            mine = pa.array(owner)
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(mine) for c in carry], pa.array(piece, pa.int64()), cutting.listed(begins, x=x, y=y), pa.array(cutting.lengths(x, y, begins))], kind.names)

    return met.select(*carry, "path", "sides").mapInArrow(run, kind)


def clipped_in_fields(fields: DataFrame, carry: list[str]) -> DataFrame:
    """As clipped(), for fields with their own lines: (carry, ring, exclusions, paths, an array of arrays of (lon, lat)); line counts the paths from 0, and ``path`` is in metres about the ring's mean.

    Rings come as they are, since an expression that leads to their sides would repeat however they were made.
    """
    path = T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in "xy"]))
    kind = T.StructType([fields.schema[c] for c in carry] + [T.StructField("line", T.IntegerType()), T.StructField("piece", T.LongType()), T.StructField("path", path), T.StructField("length_m", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            with np.errstate(all="ignore"):
                ref, sides = cutting.framed(b.column("ring"), b.column("exclusions"))
                each, outer = cutting.spread(b.column("paths"))
                field = np.repeat(np.arange(b.num_rows), np.diff(outer))
                lon, lat, begins = cutting.rings(each)
                seg, path = cutting.segments(*cutting.metres(lon, lat, ref, np.repeat(field, np.diff(begins))), begins)
                x, y, begins, owner, piece = cutting.pieces(seg, path, sides[field], lambda x, y, p: cutting.holds(x, y, sides[field[p]]))
            mine, line = pa.array(field[owner]), owner - outer[field[owner]]
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(mine) for c in carry], pa.array(line, pa.int32()), pa.array(piece, pa.int64()), cutting.listed(begins, x=x, y=y), pa.array(cutting.lengths(x, y, begins))], kind.names)

    return fields.select(*carry, "ring", "exclusions", "paths").mapInArrow(run, kind)


def _points(found: DataFrame, own: list[str]) -> DataFrame:
    return found.select(*own, F.posexplode("path").alias("n", "q")).select(*own, (F.col("n") + 1).alias("seq"), "q.x", "q.y")


def clip(points: DataFrame, regions: DataFrame, key: list[str], sides: str = "sides", inside: bool = True) -> DataFrame:
    """The pieces of polylines within regions (or outside): (key, line, piece, seq, x, y), pieces and points numbered from 1 along each line.

    regions: (key, sides), the sides of all rings of a region as structs a, b of (x, y); what an odd number of rings holds is inside, and what lies on a side is inside too
    (also when the outside is asked for, so a line along a side is no part of it).
    """
    met = paths(points, [*key, "line"]).join(regions.select(*key, F.col(sides).alias("sides")), key)
    return _points(clipped(met, [*key, "line"], inside), [*key, "line", "piece"])


def holds(x: Column, y: Column, sides: Column) -> Column:
    """Whether a region holds (x, y): an odd number of its rings around it, or a side through it."""
    return F.exists(sides, lambda e: _on(x, y, e)) | (F.size(F.filter(sides, lambda e: _crosses(x, y, e))) % 2 == 1)


def lengths(points: DataFrame, key: list[str]) -> DataFrame:
    """(key, length_m) of polylines given by ordered points (key, seq, x, y)."""
    w = Window.partitionBy(*key).orderBy("seq")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return points.select(*key, step.alias("step")).groupBy(*key).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length_m"))


def trimmed(found: DataFrame, carry: list[str], amount: str = "amount_m") -> DataFrame:
    """Paths (carry, path, amount) without ``amount`` metres at both ends: (carry, path, length_m); what is no longer than twice that and 5 cm goes altogether."""
    kind = T.StructType([found.schema[c] for c in carry] + [found.schema["path"], T.StructField("length_m", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points, begins = cutting.spread(b.column("path"))
            x, y, begins, owner = cutting.trimmed(cutting.number(points.field("x")), cutting.number(points.field("y")), begins, cutting.number(b.column("cut")))
            mine = pa.array(owner)
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(mine) for c in carry], cutting.listed(begins, x=x, y=y), pa.array(cutting.lengths(x, y, begins))], kind.names)

    return found.select(*carry, "path", F.greatest(F.lit(0.0), F.coalesce(F.col(amount).cast("double"), F.lit(0.0))).alias("cut")).mapInArrow(run, kind)


def trim(points: DataFrame, key: list[str], amount: str = "amount_m") -> DataFrame:
    """Polylines without ``amount`` metres at both ends; (key, seq, x, y), points numbered from 1. What is no longer than twice that and 5 cm goes altogether."""
    return _points(trimmed(paths(points, key, amount), key, amount), key)


def _within(cell: str) -> tuple[Column, Column]:
    """Shares between which the segment (ax, ay)-(bx, by) lies in a trapezoid (y0, y1, l0, r0, l1, r1); a trapezoid is convex, so each of its four sides
    only cuts at one end."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    c = lambda n: F.col(f"{cell}.{n}")
    tall = c("y1") - c("y0")

    def slanted(low: str, high: str) -> tuple[Column, Column]:
        # x - left(y) at the segment's start and its change along it.
        slope = (c(high) - c(low)) / tall
        return F.col("ax") - c(low) - slope * (F.col("ay") - c("y0")), dx - slope * dy

    left, right = slanted("l0", "l1"), slanted("r0", "r1")
    walls = [(F.col("ay") - c("y0"), dy), (c("y1") - F.col("ay"), -dy), left, (-right[0], -right[1])]
    lo, hi = [F.lit(0.0)], [F.lit(1.0)]
    for start, change in walls:
        t = F.try_divide(-start, change)
        outside = (change == 0) & (start < 0)
        lo.append(F.when(outside, 2.0).when(change > 0, t).otherwise(0.0))
        hi.append(F.when(change < 0, t).otherwise(1.0))
    return F.greatest(*lo), F.least(*hi)


def _away(p: tuple, q: tuple, r: tuple) -> Column:
    """Metres between the point p and the segment q-r."""
    dx, dy = r[0] - q[0], r[1] - q[1]
    t = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide((p[0] - q[0]) * dx + (p[1] - q[1]) * dy, dx * dx + dy * dy))), F.lit(0.0))
    return F.hypot(p[0] - q[0] - t * dx, p[1] - q[1] - t * dy)


def _gap(cell: str) -> Column:
    """Metres between the segment and the nearest side of a trapezoid that it doesn't meet: the least over ends against sides."""
    c = lambda n: F.col(f"{cell}.{n}")
    corner = [(c("l0"), c("y0")), (c("r0"), c("y0")), (c("r1"), c("y1")), (c("l1"), c("y1"))]
    seg = ((F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by")))
    sides = list(zip(corner, corner[1:] + corner[:1]))
    return F.least(*[_away(p, q, r) for p in seg for q, r in sides], *[_away(p, *seg) for p in corner])


def owners(points: DataFrame, trapezoids: DataFrame, key: list[str]) -> DataFrame:
    """(key, line, part): the portion that each polyline belongs to.

    trapezoids: cells with their ``part``, as slabs.parts gives them. That portion owns a line that holds the greatest length of it (differences up to 0.1 micrometres don't
    count, the lesser part wins them); a line that lies in none belongs to the nearest. Fields without any portion give no row.
    """
    cell = F.struct("y0", "y1", "l0", "r0", "l1", "r1").alias("cell")
    met = segments(points, key).join(trapezoids.select(*key, "part", cell), key)
    lo, hi = _within("cell")
    size = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    held = met.select(*key, "line", "part", (F.greatest(F.lit(0.0), hi - lo) * size).alias("m"), _gap("cell").alias("gap"))
    held = held.groupBy(*key, "line", "part").agg(F.sum("m").alias("m"), F.min("gap").alias("gap"))
    best = held.groupBy(*key, "line").agg(F.max("m").alias("most"), F.min("gap").alias("nearest"))
    winner = F.when(F.col("most") > JOINED, F.col("m") >= F.col("most") - JOINED).otherwise(F.col("gap") <= F.col("nearest") + 1e-5)
    return held.join(best, [*key, "line"]).where(winner).groupBy(*key, "line").agg(F.min("part").alias("part"))


def owners_in_fields(fields: DataFrame, carry: list[str]) -> DataFrame:
    """As owners(), for fields with their own lines: (carry, ring, exclusions, paths, an array of arrays of (lon, lat)) give (carry, line, part); line counts the paths from 0. Cells are cut and lines
    measured in numpy, a batch of fields at a time."""

    def make(b: pa.RecordBatch) -> tuple[np.ndarray, list]:
        cells = trapezoids.cells(*trapezoids.field_sides(b.column("ring"), b.column("exclusions")), "difference")
        lon, lat, begins = cutting.opened(*cutting.rings(b.column("ring")))
        size, field = np.diff(begins), np.arange(b.num_rows)
        ref = tuple(np.bincount(np.repeat(field, size), v, b.num_rows) / np.maximum(size, 1) for v in (lon, lat))
        each, outer = cutting.spread(b.column("paths"))
        of = np.repeat(field, np.diff(outer))
        lon, lat, begins = cutting.rings(each)
        seg, path = cutting.segments(*cutting.metres(lon, lat, ref, np.repeat(of, np.diff(begins))), begins)
        line, part = trapezoids.owners(seg, path, of[path], cells, trapezoids.parts(cells), cutting.JOINED)
        return of[line], [line - outer[of[line]], part]

    return slabs.worked(fields.select(*carry, "ring", "exclusions", "paths"), carry, "line int, part int", make)


def region_sides(fields: DataFrame, key: list[str]) -> DataFrame:
    """(key, sides, ref): the sides of each field's ring and exclusions in metres about the ring's mean."""
    step = fields.select(*key, "ring", "exclusions", geo.mean_of(geo.open_ring(F.col("ring"))).alias("ref"))
    rings = F.concat(F.array("ring"), F.coalesce("exclusions", F.array()))
    metres = lambda r: geo.edges(F.transform(geo.open_ring(r), lambda p: geo.to_xy(p, F.col("ref"))))
    return step.select(*key, "ref", F.flatten(F.transform(rings, metres)).alias("sides"))
