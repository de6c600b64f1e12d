"""Scan lines in numpy: brute force, rings without rows, and plans that make no row for what only is summed."""

import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from terraloom.functions import geo  # noqa: E402
from terraloom.operators import planting  # noqa: E402
from terraloom.sources.views import with_roads  # noqa: E402

KIND = "project_id long, client_field_id long, display_order int, row_spacing_m double, ring array<struct<lon:double,lat:double>>"


def metres(*points):
    return [(8 + x / (geo.RAD * geo.EARTH_M * 0.7071), 45 + y / (geo.RAD * geo.EARTH_M)) for x, y in points]


def test_orientations(spark):
    ell = metres((0, 0), (60, 0), (60, 10), (12, 10), (12, 30), (0, 30))
    rows = [(1, 1, 1, 2.0, metres((0, 0), (10, 0), (10, 60), (0, 60))), (1, 2, 1, 2.0, ell), (1, 3, 1, None, ell), (1, 4, 1, 0.0, ell), (1, 5, 1, 2.0, ell[:2]), (1, 6, 1, 2.0, None), (1, 7, 1, 500.0, ell)]
    out = planting.best_orientation(spark.createDataFrame(rows, KIND))
    assert {r.client_field_id: r.angle for r in out.collect()} == {1: 0, 2: 90}
    # Nothing is exploded: angles and lines are summed within a batch of fields.
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rings_of_views(spark):
    rows = [(1, True, True, 2, 0.5), (2, False, True, 1, 0.25), (3, False, False, 2, None)]
    f = spark.createDataFrame(rows, "id int, l_shape boolean, has_exclusion boolean, display_order int, skew double").selectExpr("*", "8.1D AS lon0", "44.2D AS lat0", "0.3D AS dlon", "0.7D AS dlat")
    out = with_roads(f)
    place = lambda *us: [(8.1 + u * 0.3, 44.2 + v * 0.7) for u, v in us]
    got = {r.id: ([tuple(p) for p in r.ring], [[tuple(p) for p in x] for x in r.exclusions]) for r in out.collect()}
    hole, road = place((0.2, 0.2), (0.4, 0.2), (0.4, 0.4), (0.2, 0.4), (0.2, 0.2)), place((-0.1, 0.45), (1.2, 0.45), (1.2, 0.55), (-0.1, 0.55), (-0.1, 0.45))
    assert got[1] == (place((0.0, 0.0), (1.0, 0.0), (1.0, 0.5), (0.5, 0.5), (0.5, 1.0), (0.0, 1.0), (0.0, 0.0)), [hole, road])
    assert got[2] == (place((0.0, 0.0), (1.0, 0.0), (1.25, 1.0), (0.25, 1.0), (0.0, 0.0)), [hole])
    assert [p[0] is None for p in got[3][0]] == [False, False, True, True, False] and got[3][1] == [road]
    # One lambda makes a ring's points, not an expression for each.
    assert plan(out.select("ring")).count("named_struct" if "named_struct(lon" in plan(out) else "struct(lon") == 1


def test_corridors_and_labels(spark):
    line = spark.createDataFrame([(1, (8.0, 45.0), (8.001, 45.0)), (2, (8.0, 45.0), (8.0, 45.0))], "id int, a struct<lon:double,lat:double>, b struct<lon:double,lat:double>")
    out = planting.corridor(line, "a", "b", 2.0, ["id"])
    ring = {r.id: r.ring for r in out.collect()}
    half = 1 / (geo.RAD * geo.EARTH_M)
    assert ring[2] is None and [(p.lon, p.lat) for p in ring[1]] == [pytest.approx(p, abs=1e-12) for p in [(8.0, 45 + half), (8.001, 45 + half), (8.001, 45 - half), (8.0, 45 - half), (8.0, 45 + half)]]
    assert plan(out).count("COS(") == 3
    # A U that holds neither its centroid nor its box's centre, and a line that holds nothing.
    u = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (7.0, 9.0), (7.0, 1.0), (1.0, 1.0), (1.0, 9.0), (0.0, 9.0)]
    f = spark.createDataFrame([(1, u), (2, [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]), (3, u[:2])], "id int, ring array<struct<lon:double,lat:double>>")
    assert {r.id: (r.lon, r.lat) for r in planting.label_points(f, ["id"]).collect()} == {1: (4.5, 0.5), 2: (0.0, 0.0), 3: (None, None)}
    assert {(r.sample, r.lon, r.lat) for r in planting.sample_points(f, ["id"]).collect() if r.id == 1} == set()


def test_vine_rows_are_cut_in_numpy(spark, capsys):
    """Rows of a square between overlapping, level and missing exclusions; no row is made for a scan line that isn't one of the rows."""
    m = 1 / (6371008.8 * math.pi / 180)
    box = lambda x0, y0, x1, y1: [(a * m, b * m) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    kind = "array<struct<lon:double,lat:double>>"
    plot = box(-5, -5, 5, 5)
    rows = [(1, plot, [box(-5.5, -1, 5.5, 1), box(-5.5, 0, 5.5, 2)], 2.5, None, 0.0), (2, plot + plot[:1], [], 2.5, 1.0, 0.0), (3, plot[:2], [], 2.5, None, 0.0), (4, plot, [box(-5.5, -6, 5.5, 6)], 2.5, None, 0.0), (5, None, [], 2.5, None, 0.0), (6, plot, [], None, None, 0.0)]
    fields = spark.createDataFrame(rows, f"k int, ring {kind}, exclusions array<{kind}>, row_spacing_m double, headland_width_m double, orientation_deg double")
    out = planting.generate_rows(fields, ["k"])
    got = {}
    for r in sorted(out.collect()):
        got.setdefault(r.k, {}).setdefault(r.line, []).append((r.part, round(r.x, 6), round(r.y_start, 6), round(r.y_end, 6)))
    assert set(got) == {1, 2} and sorted(got[1]) == sorted(got[2]) == [0, 1, 2, 3]
    assert got[1][0] == [(0, -3.75, -5.0, -1.0), (1, -3.75, 2.0, 5.0)] and got[2][3] == [(0, 3.75, -4.0, 4.0)]
    capsys.readouterr()
    out.explain()
    assert "sequence(" not in capsys.readouterr().out
