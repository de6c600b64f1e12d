"""Designs of usable portions: edits that make a portion's design its own, and how reports describe it.

A portion's row: mode (inherited or local), orientation_deg, curve_points (array of structs position, offset_m), equidistant, inherited (its field's design, any type), conflict, label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions.common import blank_to_null, finite

#: The guide, algorithm and mode of a design that follows the terrain.
TERRAIN_GUIDE, TERRAIN_ALGORITHM, TERRAIN_MODE = "native-contour-distance-family", "terrain-contour-family-1", "adapt"


def patched_portions(portions: DataFrame, patches: DataFrame, key: list[str]) -> DataFrame:
    """Portions after edits (key, label, orientation_deg, curve_points, equidistant; null: not edited), at most one for each.

    An edit of orientation, curve or spacing makes the portion local: it lets go of its field's design and of a conflict, and an inherited curve goes unless the edit brings one. A label alone changes
    nothing else. Portions without an edit stay as they are.
    """
    edits = patches.select(*key, *[F.col(c).alias(f"__{c}") for c in ("label", "orientation_deg", "curve_points", "equidistant")])
    met = portions.join(edits, key, "left")
    own = F.col("__orientation_deg").isNotNull() | F.col("__curve_points").isNotNull() | F.col("__equidistant").isNotNull()
    kept = F.when(F.col("mode") == "local", F.col("curve_points"))
    none = F.filter("curve_points", lambda p: F.lit(False))
    changed = {
        "label": F.coalesce("__label", "label"),
        "mode": F.when(own, "local").otherwise(F.col("mode")),
        "orientation_deg": F.when(own, finite(F.coalesce("__orientation_deg", "orientation_deg"))).otherwise(F.col("orientation_deg")),
        "curve_points": F.when(own, F.coalesce("__curve_points", kept, none)).otherwise(F.col("curve_points")),
        "equidistant": F.when(own, F.coalesce("__equidistant", "equidistant", F.lit(True))).otherwise(F.col("equidistant")),
        "inherited": F.when(~own, F.col("inherited")),
        "conflict": F.when(~own, F.col("conflict")),
    }
    return met.withColumns(changed).select(*portions.columns)


def portion_descriptors(portions: DataFrame, key: list[str], order: str) -> DataFrame:
    """What a report says of each portion: label (else its number), mode, orientation and whether its rows are curved (both null where they follow the terrain), equidistance, terrain_guide.

    The terrain counts where it was applied (applied) and the design names the terrain's guide, has a guide line (guide_points, two or more), or was adapted by the terrain's algorithm (algorithm,
    design_mode, axes: how many).
    """
    follows = (F.col("guide") == TERRAIN_GUIDE) | (F.col("guide_points") >= 2) | ((F.col("algorithm") == TERRAIN_ALGORITHM) & (F.col("design_mode") == TERRAIN_MODE) & (F.col("axes") > 0))
    rows = portions.withColumns({"terrain_guide": F.coalesce(F.col("applied") & F.coalesce(follows, F.lit(False)), F.lit(False)), "__n": F.row_number().over(Window.partitionBy(*key).orderBy(order))})
    plain = ~F.col("terrain_guide")
    return rows.select(
        *key, order, F.coalesce(blank_to_null(F.col("label")), F.concat(F.lit("Porzione "), F.col("__n").cast("string"))).alias("label"), "mode", F.when(plain, finite(F.col("orientation_deg"))).alias("orientation_deg"),
        F.when(plain, F.coalesce(F.exists("curve_points", lambda p: F.abs(p["offset_m"]) > 0), F.lit(False))).alias("curved"), F.coalesce("equidistant", F.lit(True)).alias("equidistant"), "terrain_guide",
    )
