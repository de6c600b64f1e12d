"""Elevation rasters as long tables of cells (model_id, i, j, z) on a square grid with y falling from row to row.

Neighbours come from one window along the rows and one down the columns, so a task holds a row or a column of a model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = 5.0


def cells(rows: DataFrame, heights: str = "heights") -> DataFrame:
    """Raster rows (model_id, j, array of heights) -> cells."""
    return rows.select("model_id", "j", F.posexplode(heights).alias("i", "z")).select("model_id", "i", "j", F.col("z").cast("double").alias("z"))


def explode_tiles(tiles: DataFrame) -> DataFrame:
    """(model_id, width, height, values_base64 of little-endian floats) -> cells; tiles of a wrong size, too small, too large or with values that are no heights give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m, w, h, raw in zip(*[b.column(c).to_pylist() for c in ("model_id", "width", "height", "raw")]):
                z = np.frombuffer(raw or b"", "<f4") if len(raw or b"") % 4 == 0 else np.zeros(0)
                if w < 2 or h < 2 or w * h > 262_144 or len(z) != w * h or not (np.isfinite(z) & (z >= -12_000) & (z <= 10_000)).all():
                    continue
                k = np.arange(w * h)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(w * h, m), pa.int64()), pa.array(k % w, pa.int32()), pa.array(k // w, pa.int32()), pa.array(z.astype(float))], names=["model_id", "i", "j", "z"])

    return tiles.select("model_id", "width", "height", F.unbase64("values_base64").alias("raw")).mapInArrow(run, "model_id long, i int, j int, z double")


def corners(cells_: DataFrame) -> DataFrame:
    """Each cell with its right, lower and diagonal neighbour; cells of the last row and column drop out.

    Two windows, so cells are shuffled twice and never joined with themselves.
    """
    along, down = Window.partitionBy("model_id", "j").orderBy("i"), Window.partitionBy("model_id", "i").orderBy("j")
    beside = cells_.withColumn("z10", F.when(F.lead("i").over(along) == F.col("i") + 1, F.lead("z").over(along)))
    next_row = F.lead("j").over(down) == F.col("j") + 1
    out = beside.select("model_id", "i", "j", F.col("z").alias("z00"), "z10", F.when(next_row, F.lead("z").over(down)).alias("z01"), F.when(next_row, F.lead("z10").over(down)).alias("z11"))
    return out.where("z10 IS NOT NULL AND z01 IS NOT NULL AND z11 IS NOT NULL")


def faces(cells_: DataFrame, step: float = STEP) -> DataFrame:
    """Two triangles per cell with their slope in percent and their middle height."""
    slope = lambda a, b: 100 * F.hypot(a / step, b / step)
    z = {k: F.col(k) for k in ("z00", "z10", "z01", "z11")}
    upper = F.struct(F.lit(0).alias("k"), slope(z["z10"] - z["z00"], z["z01"] - z["z00"]).alias("slope_percent"), ((z["z00"] + z["z10"] + z["z01"]) / 3).alias("mean_z"))
    lower = F.struct(F.lit(1).alias("k"), slope(z["z11"] - z["z01"], z["z11"] - z["z10"]).alias("slope_percent"), ((z["z11"] + z["z10"] + z["z01"]) / 3).alias("mean_z"))
    return corners(cells_).select("model_id", "i", "j", F.explode(F.array(upper, lower)).alias("f")).select("model_id", "i", "j", "f.*")


def summary(cells_: DataFrame, step: float = STEP) -> DataFrame:
    """Lowest, highest, range, cells and steepest face of every model."""
    heights = cells_.groupBy("model_id").agg(F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.count("*").alias("n_cells"))
    steep = faces(cells_, step).groupBy("model_id").agg(F.max("slope_percent").alias("max_slope_percent"))
    return heights.join(steep, "model_id", "left").withColumn("range_z", F.col("max_z") - F.col("min_z"))


def heights_at(points: DataFrame, cells_: DataFrame) -> DataFrame:
    """Height of points (model_id, u, v in grid units) by the triangle they lie in; null outside the grid."""
    size = cells_.groupBy("model_id").agg(F.max("i").alias("wi"), F.max("j").alias("hj"))
    eps = 2e-7
    at = points.join(size, "model_id", "left")
    within = F.col("u").between(-eps, F.col("wi") + eps) & F.col("v").between(-eps, F.col("hj") + eps)
    clamp = lambda x, top: F.least(F.greatest(F.col(x), F.lit(0.0)), F.col(top).cast("double"))
    at = at.withColumns({"cu": F.when(within, clamp("u", "wi")), "cv": F.when(within, clamp("v", "hj"))})
    at = at.withColumns({"i": F.least(F.floor("cu").cast("int"), F.col("wi") - 1), "j": F.least(F.floor("cv").cast("int"), F.col("hj") - 1)})
    # Only cells beside a point are paired with their neighbours.
    around = F.array(*[F.struct((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j")) for di in (0, 1) for dj in (0, 1)])
    asked = at.where(F.col("i").isNotNull()).select("model_id", F.explode(around).alias("c")).select("model_id", "c.i", "c.j").distinct()
    met = at.join(corners(cells_.join(asked, ["model_id", "i", "j"], "left_semi")), ["model_id", "i", "j"], "left")
    a, b = F.col("cu") - F.col("i"), F.col("cv") - F.col("j")
    z = F.when(a + b <= 1, F.col("z00") + a * (F.col("z10") - F.col("z00")) + b * (F.col("z01") - F.col("z00"))).otherwise(F.col("z11") + (1 - b) * (F.col("z10") - F.col("z11")) + (1 - a) * (F.col("z01") - F.col("z11")))
    return met.select(*points.columns, z.alias("z"))


def surface_area(cells_: DataFrame, step: float = STEP) -> DataFrame:
    """Area of each model's surface: half a cell per face, stretched by its slope."""
    return faces(cells_, step).groupBy("model_id").agg(F.sum(step * step / 2 * F.sqrt(1 + F.pow(F.col("slope_percent") / 100, 2))).alias("surface_m2"))


def encode_heights(cells_: DataFrame) -> DataFrame:
    """24-bit colours of heights: (z + 32768) * 256 in three bytes."""
    n = F.round((F.col("z") + 32768) * 256).cast("long")
    return cells_.select("model_id", "i", "j", F.shiftright(n, 16).bitwiseAND(255).alias("r"), F.shiftright(n, 8).bitwiseAND(255).alias("g"), n.bitwiseAND(255).alias("b"))


def draped_lengths(segments: DataFrame, cells_: DataFrame, key: list[str], step: float = STEP) -> DataFrame:
    """Length on the surface of each key's segments (model_id, u0, v0, u1, v1 in grid units), cut wherever they cross a grid line or a cell's diagonal;
    null where any end of a piece lies outside the grid."""
    rows = segments.select(*key, "model_id", "u0", "v0", "u1", "v1")

    def cuts(a: Column, b: Column) -> Column:
        lo, hi = F.floor(F.least(a, b)) + 1, F.ceil(F.greatest(a, b)) - 1
        return F.when((F.abs(b - a) >= 1e-12) & (hi >= lo), F.transform(F.sequence(lo, hi), lambda k: (k - a) / (b - a))).otherwise(F.array().cast("array<double>"))

    inner = F.filter(F.concat(cuts(F.col("u0"), F.col("u1")), cuts(F.col("v0"), F.col("v1")), cuts(F.col("u0") + F.col("v0"), F.col("u1") + F.col("v1"))), lambda t: (t > 1e-10) & (t < 1 - 1e-10))
    at = rows.withColumn("ts", F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), inner))).withColumn("seg", F.monotonically_increasing_id())
    points = at.select(*key, "model_id", "seg", "u0", "v0", "u1", "v1", F.explode("ts").alias("t"))
    points = points.select(*key, "model_id", "u0", "v0", "u1", "v1", "t", (F.col("u0") + F.col("t") * (F.col("u1") - F.col("u0"))).alias("u"), (F.col("v0") + F.col("t") * (F.col("v1") - F.col("v0"))).alias("v"))
    high = heights_at(points, cells_)
    w = Window.partitionBy(*key, "model_id", "u0", "v0", "u1", "v1").orderBy("t")
    flat = F.hypot((F.col("u") - F.lag("u").over(w)) * step, (F.col("v") - F.lag("v").over(w)) * step)
    pieces = high.select(*key, "t", "z", F.hypot(flat, F.col("z") - F.lag("z").over(w)).alias("d"))
    return pieces.groupBy(*key).agg(F.when(F.bool_and(F.col("z").isNotNull()), F.coalesce(F.sum("d"), F.lit(0.0))).alias("length_m"))


def draped_plants(rows: DataFrame, lengths: DataFrame, key: list[str], field: list[str]) -> DataFrame:
    """Plants and posts of each field from the surface lengths of its rows; null where a row's length is unknown."""
    met = rows.join(lengths, key)
    known = F.bool_and(F.col("length_m").isNotNull())
    plants = F.sum(F.floor(F.col("length_m") / F.col("plant_spacing_m")) + 1)
    between = F.sum(F.greatest(F.lit(0).cast("long"), F.ceil(F.col("length_m") / F.col("post_spacing_m")) - 1))
    return met.groupBy(*field).agg(F.count("*").alias("row_count"), F.when(known, F.sum("length_m")).alias("surface_row_m"), F.when(known, plants).alias("plants"), F.when(known, between + 2 * F.count("*")).alias("posts"))


#: The coordinate systems that models may have, and the largest raster.
SYSTEMS, LARGEST = ("EPSG:32632", "EPSG:32633", "EPSG:32634"), 262_144


def model_errors(models: DataFrame, key: str) -> DataFrame:
    """What is wrong first with a model's description (version, crs, origin_x, origin_y, step_x, step_y, source, resolution_m, complete); null: nothing."""
    finite = lambda c: F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
    grid = finite("origin_x") & finite("origin_y") & finite("step_x") & finite("step_y") & (F.col("step_x") > 0) & (F.col("step_y") == -F.col("step_x"))
    source = F.coalesce((F.trim("source") != "") & (F.col("resolution_m") == F.col("step_x")), F.lit(False))
    error = F.when(~F.coalesce(F.col("version") == 1, F.lit(False)), "version").when(~F.coalesce(F.col("crs").isin(*SYSTEMS), F.lit(False)), "crs").when(~grid, "grid").when(~source, "source").when(~F.coalesce("complete", F.lit(False)), "incomplete")
    return models.select(key, error.alias("error"))


def support_windows(boxes: DataFrame, key: list[str], anchor: tuple[float, float], resolution: float, margin: float = 40.0) -> DataFrame:
    """Raster window of each box (x0, y0, x1, y1 in metres) with a margin, snapped outwards to the source's lattice, and whether its size is allowed."""
    snap = lambda c, a, m, f: f((F.col(c) + m - a) / resolution) * resolution + a
    out = boxes.select(*key, snap("x0", anchor[0], -margin, F.floor).alias("west"), snap("y0", anchor[1], -margin, F.floor).alias("south"), snap("x1", anchor[0], margin, F.ceil).alias("east"), snap("y1", anchor[1], margin, F.ceil).alias("north"))
    size = {"width": F.round((F.col("east") - F.col("west")) / resolution).cast("long"), "height": F.round((F.col("north") - F.col("south")) / resolution).cast("long")}
    return out.withColumns(size).withColumn("allowed", (F.col("width") >= 2) & (F.col("height") >= 2) & (F.col("width") * F.col("height") <= LARGEST))


def blended(points: DataFrame, native: str, context: str, distance: str, collar: str) -> DataFrame:
    """Heights that go over smoothly from the context's at the model's edge to its own where ``distance`` reaches the collar's width; null without the context's height, and within the model without its own, as nothing can be blended there."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(distance) / F.col(collar)))
    weight = t * t * (3 - 2 * t)
    return points.withColumn("height", F.when(F.col(distance) <= 0, F.col(context)).otherwise(F.col(context) + (F.col(native) - F.col(context)) * weight))
