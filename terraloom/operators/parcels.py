"""Parcels that a selection joins to one perimeter.

Parcels side by side share their common border in opposite directions, so it cancels; what is left is the outline. Borders are cut at the vertices of neighbours first, as
one parcel's side may meet two others. A selection's parcels, a few hundred sides at most, come to one row and are joined in numpy, a batch of selections at a time (`functions/outlines.py`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.functions import cutting, outlines
from terraloom.operators import slabs

# Executors get the numpy helpers with the job and need no installed package for them.
cloudpickle.register_pickle_by_value(cutting)
cloudpickle.register_pickle_by_value(outlines)


def union(parcels: DataFrame, key: list[str]) -> DataFrame:
    """One perimeter for each selection of parcels (key, ring, reference): (key, ring, area_m2, references, reason).

    ``ring`` is closed and counter-clockwise, vertices between collinear sides stay; it is null with a ``reason`` where parcels overlap (``overlap``), meet in no side
    or in a corner only (``apart``), enclose a hole (``hole``), or where no parcel has a ring of area (``invalid``).
    """
    listed = parcels.groupBy(*key).agg(F.array_sort(F.collect_set("reference")).alias("references"), F.collect_list("ring").alias("rings"))

    def make(b: pa.RecordBatch) -> tuple[np.ndarray, list]:
        return np.arange(b.num_rows), list(outlines.union(b.column("rings")))

    out = slabs.worked(listed, [*key, "references"], "ring array<struct<lon:double,lat:double>>, area_m2 double, reason string", make)
    return out.select(*key, "ring", "area_m2", "references", "reason")
