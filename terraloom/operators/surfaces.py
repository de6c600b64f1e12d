"""What lies on an elevation surface within fields: surface area, heights and slopes, and passages' ground within a field.

A field's ring is in grid units (u along a raster's row, v down its rows). Fields meet raster cells by the cells of their boxes, an equi-join; cells that no side touches are
whole or not there at all, and only those along the ring are cut, with the trapezoids of slabs.py.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions import cutting, geo, trapezoids
from terraloom.operators import planting, slabs
from terraloom.operators.terrain import STEP, corners


def _xy(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(p["u"].cast("double").alias("x"), p["v"].cast("double").alias("y")))


def _inside(x: Column, y: Column, sides: Column) -> Column:
    met = F.filter(sides, lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < F.try_divide((e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]), e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))
    return F.size(met) % 2 == 1


def _with_model(key: list[str]) -> list[str]:
    return key if "model_id" in key else [*key, "model_id"]


def _covered(fields: DataFrame, cells_: DataFrame, key: list[str]) -> DataFrame:
    """A row per field and cell that it reaches: (key, model_id, i, j, heights, sides, whole)."""
    key = _with_model(key)
    ring = fields.select(*key, _xy(F.col("ring")).alias("pts"))
    ring = ring.select(*key, "pts", F.flatten(F.array(geo.edges(F.when(F.element_at("pts", 1) == F.element_at("pts", -1), F.slice("pts", F.lit(1), F.size("pts") - 1)).otherwise(F.col("pts"))))).alias("sides")).where(F.size("sides") >= 3)
    low = lambda c: F.floor(F.array_min(F.transform("pts", lambda p: p[c]))).cast("int")
    high = lambda c: F.greatest(low(c), (F.ceil(F.array_max(F.transform("pts", lambda p: p[c]))) - 1).cast("int"))
    size = cells_.groupBy("model_id").agg(F.max("i").alias("wi"), F.max("j").alias("hj"))
    # Only cells that the raster has, so a wide ring explodes to no more than those.
    box = ring.join(size, "model_id").select(*key, "sides", F.greatest(low("x"), F.lit(0)).alias("i0"), F.least(high("x"), F.col("wi") - 1).alias("i1"), F.greatest(low("y"), F.lit(0)).alias("j0"), F.least(high("y"), F.col("hj") - 1).alias("j1"))
    at = box.where("i0 <= i1 AND j0 <= j1").select(*key, "sides", "j0", "j1", F.explode(F.sequence("i0", "i1")).alias("i"))
    at = at.select(*key, "sides", "i", F.explode(F.sequence("j0", "j1")).alias("j"))
    touches = F.exists("sides", lambda e: (F.least(e["a"]["x"], e["b"]["x"]) <= F.col("i") + 1) & (F.greatest(e["a"]["x"], e["b"]["x"]) >= F.col("i")) & (F.least(e["a"]["y"], e["b"]["y"]) <= F.col("j") + 1) & (F.greatest(e["a"]["y"], e["b"]["y"]) >= F.col("j")))
    at = at.withColumn("touched", touches).withColumn("whole", ~F.col("touched") & _inside(F.col("i") + 0.5, F.col("j") + 0.5, F.col("sides")))
    return at.where("touched OR whole").join(corners(cells_), ["model_id", "i", "j"])


def faces_within(fields: DataFrame, cells_: DataFrame, key: list[str], step: float = STEP) -> DataFrame:
    """The triangles that each field (key, model_id, ring of (u, v)) has a share of: (key, model_id, i, j, k, share_m2, slope_percent, low, high, whole).

    ``share_m2`` is the plane area of the triangle within the ring; ``low`` and ``high`` are the least and the greatest height of the triangle itself.
    """
    met = _covered(fields, cells_, key)
    slope = lambda a, b: 100 * F.hypot(a / step, b / step)
    z00, z10, z01, z11 = (F.col(c) for c in ("z00", "z10", "z01", "z11"))
    upper = F.struct(F.lit(0).alias("k"), slope(z10 - z00, z01 - z00).alias("slope_percent"), F.least(z00, z10, z01).alias("low"), F.greatest(z00, z10, z01).alias("high"))
    lower = F.struct(F.lit(1).alias("k"), slope(z11 - z01, z11 - z10).alias("slope_percent"), F.least(z11, z10, z01).alias("low"), F.greatest(z11, z10, z01).alias("high"))
    own = [*_with_model(key), "i", "j", "k"]
    face = met.select(*own[:-1], "sides", "whole", F.explode(F.array(upper, lower)).alias("__face")).select(*own[:-1], "sides", "whole", "__face.*")
    shared = ["slope_percent", "low", "high"]
    cut = face.where("NOT whole")
    x, y = F.col("i").cast("double"), F.col("j").cast("double")
    corner = lambda p, q: F.struct(p.alias("x"), q.alias("y"))
    triangle = F.when(F.col("k") == 0, F.array(corner(x, y), corner(x + 1, y), corner(x, y + 1))).otherwise(F.array(corner(x + 1, y + 1), corner(x, y + 1), corner(x + 1, y)))
    sides = slabs.ring_edges(cut.select(*own, triangle.alias("pts")), own, "pts", F.lit(0))
    ring = cut.select(*own, F.explode("sides").alias("e")).select(*own, F.lit(1).alias("ring"), F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))
    # Sides wholly above or below a triangle neither cross nor hold any of its heights.
    ring = ring.where((F.greatest("y1", "y2") >= F.col("j")) & (F.least("y1", "y2") <= F.col("j") + 1))
    part = slabs.areas(slabs.cells(sides.unionByName(ring), own, "intersection"), own).select(*own, (F.col("area_m2") * step * step).alias("share_m2"))
    part = cut.select(*own, *shared).join(part, own).where("share_m2 > 0").withColumn("whole", F.lit(False))
    full = face.where("whole").select(*own, *shared, F.lit(step * step / 2).alias("share_m2"), "whole")
    return full.unionByName(part).select(*own, "share_m2", *shared, "whole")


def surface_areas(fields: DataFrame, cells_: DataFrame, key: list[str], step: float = STEP) -> DataFrame:
    """(key, plane_m2, surface_m2): the field's area on the plane and on the surface; ``surface_m2`` is null where the raster doesn't cover the ring."""
    found = faces_within(fields, cells_, key, step).groupBy(*key).agg(F.sum("share_m2").alias("plane_m2"), F.sum(F.col("share_m2") * F.sqrt(1 + F.pow(F.col("slope_percent") / 100, 2))).alias("surface_m2"))
    size = cells_.groupBy("model_id").agg(F.max("i").alias("wi"), F.max("j").alias("hj"))
    rim = fields.join(size, "model_id", "left").select(*key, F.coalesce(F.forall("ring", lambda p: p["u"].between(0, F.col("wi")) & p["v"].between(0, F.col("hj"))), F.lit(False)).alias("covered"))
    return rim.join(found, key, "left").select(*key, "plane_m2", F.when(F.col("covered"), F.col("surface_m2")).alias("surface_m2"))


def relief(fields: DataFrame, cells_: DataFrame, key: list[str], step: float = STEP) -> DataFrame:
    """(key, min_z, max_z, range_z, max_slope_percent) over the triangles that have a share of the field; heights are of whole triangles."""
    found = faces_within(fields, cells_, key, step).groupBy(*key).agg(F.min("low").alias("min_z"), F.max("high").alias("max_z"), F.max("slope_percent").alias("max_slope_percent"))
    return found.select(*key, "min_z", "max_z", (F.col("max_z") - F.col("min_z")).alias("range_z"), "max_slope_percent")


def passage_parts(fields: DataFrame, passages: DataFrame, key: list[str], least_m2: float = 0.01) -> DataFrame:
    """The ground of passages (key, passage, a, b, width_m) within their fields: (key, passage, part, label, area_m2).

    A passage is a corridor of its width (1.5 m if none is given) around the line from a to b. Connected parts count from below; slivers of up to ``least_m2`` are left out. Parts of a passage
    that falls into several are labelled ``parte n``.
    """
    own = [*key, "passage"]
    return passage_ground(passages.select(*own, "a", "b", "width_m").join(fields.select(*key, "ring"), key), own, least_m2)


def passage_ground(rows: DataFrame, own: list[str], least_m2: float = 0.01) -> DataFrame:
    """passage_parts() of passages that have their field's ring in their row: (own, a, b, width_m, ring), own with ``passage``."""
    wide = planting.corridor(rows.withColumns({"width_m": F.coalesce("width_m", F.lit(1.5)), "field": F.col("ring")}), "a", "b", F.col("width_m"), [*own, "width_m", "field"])

    def make(b: pa.RecordBatch) -> tuple[np.ndarray, list]:
        plain = np.ones(b.num_rows)
        sides, field, ring = trapezoids.flat(*cutting.turned(b.column("field"), b.column("corridors"), plain, 0 * plain))
        c = trapezoids.cells(sides, field, ring, "intersection")
        p = trapezoids.portions(c, trapezoids.parts(c))
        field, area = (p[k][p["area"] > least_m2] for k in ("field", "area"))
        first = np.searchsorted(field, field)
        return field, [np.arange(len(field)) - first + 1, area, np.searchsorted(field, field, "right") - first]

    found = slabs.worked(wide.select(*own, "field", F.array("ring").alias("corridors")), own, "part int, area_m2 double, n int", make)
    return found.select(*own, "part", F.when(F.col("n") > 1, F.concat(F.lit("parte "), F.col("part").cast("string"))).alias("label"), "area_m2")
