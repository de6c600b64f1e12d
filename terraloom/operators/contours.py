"""Contour lines of elevation rasters: segments on the triangles at given levels, and chains of segments in order.

A node of a contour is a vertex of the grid that lies at the level or a point on a side of a triangle; both have a number that all triangles around
agree on, so segments meet by equality of numbers, never by comparing coordinates. Chains come from pointer doubling over directed segments: each
round every one learns where twice as many steps lead, so a chain of n segments takes log2(n) rounds of equi-joins and no task ever holds a chain.

Coordinates are in grid units (u along a row, v down the rows). A node has four numbers a cell: the vertex, the side to the right, the side down, the diagonal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terraloom.functions.stages import dropped, kept
from terraloom.operators.catalog import weighted_lower_median
from terraloom.operators.terrain import corners

GROUP = ["model_id", "level"]
#: More columns than a raster can have.
WIDE = 1 << 24


def _node(i: Column, j: Column, kind: int) -> Column:
    return ((j.cast("long") * WIDE + i) * 4 + kind).alias("n")


def _triangles() -> Column:
    """The two triangles of a cell: vertices, and sides (number, from, to) with from before to in a fixed direction."""
    i, j = F.col("i"), F.col("j")
    vertex = lambda di, dj, z: F.struct(_node(i + di, j + dj, 0), (i + di).cast("double").alias("u"), (j + dj).cast("double").alias("v"), (F.col(z) - F.col("level")).alias("h"))
    a, b, c, d = vertex(0, 0, "z00"), vertex(1, 0, "z10"), vertex(0, 1, "z01"), vertex(1, 1, "z11")
    side = lambda n, p, q: F.struct(n, p.alias("p"), q.alias("q"))
    slant = side(_node(i, j, 3), b, c)
    upper = F.struct(F.lit(0).alias("k"), F.array(a, b, c).alias("corners"), F.array(side(_node(i, j, 1), a, b), side(_node(i, j, 2), a, c), slant).alias("sides"))
    lower = F.struct(F.lit(1).alias("k"), F.array(d, b, c).alias("corners"), F.array(side(_node(i, j + 1, 1), c, d), side(_node(i + 1, j, 2), b, d), slant).alias("sides"))
    return F.array(upper, lower)


def _met(cells_: DataFrame, levels: DataFrame) -> DataFrame:
    """What each triangle has at each level that it reaches: (group, face, nodes, rest): nodes at the level, and the side on which its other vertices lie."""
    by_model = levels.groupBy("model_id").agg(F.array_sort(F.collect_set(F.col("level").cast("double"))).alias("levels"))
    reach = F.filter("levels", lambda x: (x >= F.least("z00", "z10", "z01", "z11")) & (x <= F.greatest("z00", "z10", "z01", "z11")))
    at = corners(cells_).join(by_model, "model_id").select("model_id", "i", "j", "z00", "z10", "z01", "z11", F.explode(reach).alias("level"))
    face = at.select(*GROUP, "i", "j", F.explode(_triangles()).alias("t")).select(*GROUP, "i", "j", "t.*")
    point = lambda n, u, v: F.struct(n.alias("n"), u.alias("u"), v.alias("v"))
    flat = F.transform(F.filter("corners", lambda c: c["h"] == 0), lambda c: point(c["n"], c["u"], c["v"]))
    share = lambda s: s["p"]["h"] / (s["p"]["h"] - s["q"]["h"])
    crossed = F.filter("sides", lambda s: s["p"]["h"] * s["q"]["h"] < 0)
    between = F.transform(crossed, lambda s: point(s["n"], s["p"]["u"] + share(s) * (s["q"]["u"] - s["p"]["u"]), s["p"]["v"] + share(s) * (s["q"]["v"] - s["p"]["v"])))
    rest = F.aggregate("corners", F.lit(0.0), lambda a, c: a + F.signum(c["h"]))
    return face.select(*GROUP, "i", "j", "k", flat.alias("flat"), between.alias("between"), rest.alias("rest"))


def segments(cells_: DataFrame, levels: DataFrame) -> DataFrame:
    """Contour segments (model_id, level, a, ua, va, b, ub, vb) of the levels (model_id, level), a < b; each once.

    A triangle with a level vertex on one side and the others on both sides of the level is cut from that vertex; a side that lies at the level is a segment unless both
    its triangles rise or both fall from it (a ridge or a valley floor); a level triangle has none of its own.
    """
    met = _met(cells_, levels)
    ends = F.array_sort(F.concat("flat", "between"))
    cut = met.where((F.size("flat") < 2) & (F.size("flat") + F.size("between") == 2)).select(*GROUP, ends.alias("e"))
    edge = met.where(F.size("flat") == 2).select(*GROUP, F.array_sort("flat").alias("e"), "rest")
    edge = edge.groupBy(*GROUP, "e").agg(F.count("*").alias("n"), F.min("rest").alias("low"), F.max("rest").alias("high")).where("n = 1 OR low <> high").select(*GROUP, "e")
    get = lambda k, c: F.element_at("e", k)[c]
    return cut.unionByName(edge).select(*GROUP, *[get(k, c).alias(f"{name}{x}") for k, x in ((1, "a"), (2, "b")) for c, name in (("n", ""), ("u", "u"), ("v", "v"))])


def diagnostics(cells_: DataFrame, levels: DataFrame) -> DataFrame:
    """What has no place in a chain: (model_id, level, reason, n): level triangles (plateau), level sides between two triangles on the same side (ridge-valley), and
    nodes where more than two segments meet (branch)."""
    met = _met(cells_, levels)
    plateau = met.where(F.size("flat") == 3).groupBy(*GROUP).agg(F.count("*").alias("n")).withColumn("reason", F.lit("plateau"))
    edge = met.where(F.size("flat") == 2).groupBy(*GROUP, F.array_sort("flat").alias("e")).agg(F.count("*").alias("m"), F.min("rest").alias("low"), F.max("rest").alias("high"))
    ridge = edge.where("m > 1 AND low = high").groupBy(*GROUP).agg(F.count("*").alias("n")).withColumn("reason", F.lit("ridge-valley"))
    branch = _degrees(segments(cells_, levels)).where("degree > 2").groupBy(*GROUP).agg(F.count("*").alias("n")).withColumn("reason", F.lit("branch"))
    return plateau.unionByName(ridge).unionByName(branch).select(*GROUP, "reason", "n")


def _degrees(found: DataFrame) -> DataFrame:
    return found.select(*GROUP, F.explode(F.array("a", "b")).alias("node")).groupBy(*GROUP, "node").agg(F.count("*").alias("degree"))


def chains(found: DataFrame) -> DataFrame:
    """Segments in the order of their lines: (model_id, level, chain, closed, at, u0, v0, u1, v1).

    A chain is walked from the end whose last segment has the lesser number; closed ones (``at`` null, as they have no end) are told apart by their least node. Lines that
    lead to a node where more than two segments meet are left out, as no order through it is given.
    """
    # Seven steps read the segments; written once, triangles are made and cut once.
    found = kept(found)
    degree = _degrees(found)
    ends = found.select(*GROUP, F.col("a").alias("p"), F.col("b").alias("q"), F.col("ua").alias("u0"), F.col("va").alias("v0"), F.col("ub").alias("u1"), F.col("vb").alias("v1"))
    both = ends.unionByName(ends.select(*GROUP, F.col("q").alias("p"), F.col("p").alias("q"), F.col("u1").alias("u0"), F.col("v1").alias("v0"), F.col("u0").alias("u1"), F.col("v0").alias("v1")))
    # The next of p -> q is q -> r with r other than p, if two segments meet in q.
    after = both.select(*GROUP, F.col("p").alias("q"), F.col("q").alias("r"))
    inner = degree.withColumnRenamed("node", "q")
    step = both.select(*GROUP, "p", "q").join(inner, [*GROUP, "q"])
    follow = step.where("degree = 2").join(after, [*GROUP, "q"]).where("p <> r").select(*GROUP, "p", "q", F.col("q").alias("np"), F.col("r").alias("nq"), F.lit(1).cast("long").alias("hops"), F.lit(False).alias("ended"), F.lit(False).alias("bad"), F.least("p", "q").alias("least"))
    stop = step.where("degree <> 2").select(*GROUP, "p", "q", F.col("p").alias("np"), F.col("q").alias("nq"), F.lit(0).cast("long").alias("hops"), F.lit(True).alias("ended"), (F.col("degree") > 2).alias("bad"), F.least("p", "q").alias("least"))
    now = kept(follow.unionByName(stop))
    # So many rounds as double a step to the longest possible chain; what has no end by then is closed.
    longest = found.groupBy(*GROUP).count().agg(F.max("count")).first()[0] or 1
    for _ in range(max(1, (int(longest) - 1).bit_length())):
        if now.where("NOT ended").isEmpty():
            break
        ahead = now.select(*GROUP, F.col("p").alias("np"), F.col("q").alias("nq"), F.col("np").alias("fp"), F.col("nq").alias("fq"), F.col("hops").alias("more"), F.col("ended").alias("done"), F.col("bad").alias("b"), F.col("least").alias("l"))
        moved = now.where("NOT ended").join(ahead, [*GROUP, "np", "nq"]).select(*GROUP, "p", "q", F.col("fp").alias("np"), F.col("fq").alias("nq"), (F.col("hops") + F.col("more")).alias("hops"), F.col("done").alias("ended"), F.col("b").alias("bad"), F.least("least", "l").alias("least"))
        new = kept(moved.unionByName(now.where("ended").select(*moved.columns)))
        dropped(now)
        now = new
    # The same segment the other way round ends at the chain's other end.
    other = now.select(*GROUP, F.col("q").alias("p"), F.col("p").alias("q"), F.col("np").alias("op"), F.col("nq").alias("oq"), F.col("bad").alias("other_bad"), F.col("hops").alias("before"))
    met = now.join(other, [*GROUP, "p", "q"]).where("NOT bad AND NOT other_bad")
    mine, theirs = F.struct(F.least("np", "nq"), "nq"), F.struct(F.least("op", "oq"), "oq")
    first = F.when(F.col("ended"), mine > theirs).otherwise(F.col("p") < F.col("q"))
    chain = F.when(F.col("ended"), F.least(F.col("nq"), F.col("oq"))).otherwise(F.col("least"))
    out = met.where(first).select(*GROUP, "p", "q", chain.alias("chain"), (~F.col("ended")).alias("closed"), F.when(F.col("ended"), F.col("before")).alias("at"))
    return out.join(both, [*GROUP, "p", "q"]).select(*GROUP, "chain", "closed", "at", "u0", "v0", "u1", "v1")


def _speed() -> Column:
    """Height gained per metre along the surface of a triangle."""
    q = F.pow(F.col("slope_percent") / 100, 2)
    return F.sqrt(q / (1 + q))


def speeds_at(faces: DataFrame, levels: DataFrame, key: list[str]) -> DataFrame:
    """(key, level, median): the weighted lower median of the speeds of the faces (key, i, j, k, share_m2, slope_percent, low, high) that reach a level (key, level) and are not flat."""
    met = faces.join(levels, key).where((F.col("low") <= F.col("level")) & (F.col("level") <= F.col("high")) & (F.col("slope_percent") > 0))
    met = met.select(*key, "level", _speed().alias("speed"), "share_m2", F.struct("j", "i", "k").alias("face"))
    return weighted_lower_median(met, [*key, "level"], "speed", "share_m2", "face")


def adaptive_levels(faces: DataFrame, key: list[str], spacing_m: float, phase: float = 0.5, refinements: int = 4) -> DataFrame:
    """Levels at which contours are about ``spacing_m`` apart on the surface: (key, n, level, reason).

    From the lowest height on, each step is spacing times the median speed of the faces at the middle of the step, which is refined so many times; the first step is shortened by ``phase``.
    Faces as in speeds_at(); they are those of one field's raster window, whose size is limited, and lie in one task per field, sorted by speed once. A field where the steps find no
    face to climb has one row with n null and the reason.
    """
    schema = StructType([faces.schema[k] for k in key]).add("n", "integer").add("level", "double").add("reason", "string")
    rows = faces.select(*key, "low", "high", _speed().alias("speed"), "share_m2", "j", "i", "k")

    def climb(name: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("speed", "j", "i", "k")])
        low, high, speed, weight = (table.column(c).to_numpy() for c in ("low", "high", "speed", "share_m2"))
        bottom, top, levels, reason = low.min(), high.max(), [], None

        def step(level: float) -> float:
            delta = 0.0
            for _ in range(refinements + 1):
                at = min(top, level + delta / 2)
                run = np.cumsum(np.where((low <= at) & (at <= high) & (speed > 0), weight, 0.0))
                delta = spacing_m * float(speed[np.argmax(run >= run[-1] / 2)]) if run[-1] > 0 else 0.0
                if not delta or level + delta == level:
                    raise ArithmeticError
            return delta

        try:
            level = bottom + phase * step(bottom)
            while level < top:
                levels.append(level)
                level += step(level)
        except ArithmeticError:
            levels, reason = [None], "no_progression"
        first = table.slice(0, 1).select(key)
        out = pa.concat_tables([first] * len(levels)) if levels else table.slice(0, 0).select(key)
        return out.append_column("n", pa.array([None] if reason else list(range(1, len(levels) + 1)), pa.int32())).append_column("level", pa.array(levels, pa.float64())).append_column("reason", pa.array([reason] * len(levels), pa.string()))

    return rows.groupBy(*key).applyInArrow(climb, schema)
