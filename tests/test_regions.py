"""Plane regions, lines, contours, surfaces and unions against hand-made cases and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.functions import trapezoids
from terraloom.operators import contours, designs, lines, parcels, planting, slabs, surfaces

M = 1 / (6371008.8 * math.pi / 180)
FIELD = "k int, ring array<struct<lon:double,lat:double>>, exclusions array<array<struct<lon:double,lat:double>>>"


def rect(x, y, w, h, unit=M):
    return [(float(a * unit), float(b * unit)) for a, b in [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]]


def shape(points):
    return [(float(a * M), float(b * M)) for a, b in [*points, points[0]]]


PLOT, ROAD = rect(0, 0, 40, 60), rect(-1, 29, 42, 2)
CASES = {
    "plain": (PLOT, [], [2400]),
    "road": (PLOT, [ROAD], [1160, 1160]),
    "overlapping holes": (PLOT, [rect(10, 10, 10, 10), rect(15, 10, 10, 10)], [2250]),
    "road that ends within": (PLOT, [rect(-1, 29, 20, 2)], [2362]),
    "crossing roads": (PLOT, [ROAD, rect(19, -1, 2, 62)], [551] * 4),
    "all excluded": (PLOT, [PLOT], []),
    "road within a millimetre of both sides": (PLOT, [rect(0.0001, 29, 39.9998, 2)], [1160, 1160]),
    "road with gaps of five centimetres": (PLOT, [rect(0.05, 29, 39.9, 2)], [2320.2]),
    "exclusion outside": (PLOT, [rect(50, 0, 5, 5)], [2400]),
    "L": (shape([(0, 0), (40, 0), (40, 20), (20, 20), (20, 60), (0, 60)]), [rect(-5, 19, 50, 2)], [760, 780]),
    "corner contact": (PLOT, [rect(0, 30, 20, 30), rect(20, 0, 20, 30)], [600, 600]),
    "clockwise": (PLOT[::-1], [ROAD[::-1]], [1160, 1160]),
    "no ring": (None, [ROAD], []),
}


@pytest.fixture(scope="module")
def portions(spark):
    df = spark.createDataFrame([(k, r, e) for k, (r, e, _) in enumerate(CASES.values())], FIELD)
    return slabs.portions(df, ["k"]).collect()


def inside(x, y, ring):
    pts = ring[:-1]
    return sum((b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a for (a, b), (c, d) in zip(pts, pts[1:] + pts[:1])) % 2 == 1


def test_portions_are_cut_in_the_row(spark):
    """A field's sides are never rows that joins and windows would have to bring together again."""
    df = spark.createDataFrame([(k, r, e) for k, (r, e, _) in enumerate(CASES.values())], FIELD)
    assert "Exchange" not in slabs.portions(df, ["k"])._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [1, 40])
def test_large_fields_are_cut_in_blocks(monkeypatch, block):
    """Fields whose sides are more than are worked on at once give the same cells and parts."""
    rng = np.random.default_rng(7)
    field, ring = np.repeat(np.arange(30), 12), np.tile(np.repeat([0, 1, 2], 4), 30)
    x, y = rng.uniform(0, 50, (2, 90, 4))
    sides = np.stack([x, y, np.roll(x, -1, 1), np.roll(y, -1, 1)], -1).reshape(-1, 4)
    for keep in ("difference", "intersection"):
        want = trapezoids.cells(sides, field, ring, keep)
        with monkeypatch.context() as m:
            m.setattr(trapezoids, "AT_ONCE", block)
            got = trapezoids.cells(sides, field, ring, keep)
        assert len(want["field"]) > 100 and all((got[c] == want[c]).all() for c in want)
        assert (trapezoids.parts(got) == trapezoids.parts(want)).all()


@pytest.mark.parametrize("name", CASES)
def test_portions(portions, name):
    ring, holes, want = CASES[name]
    got = sorted((r for r in portions if r.k == list(CASES).index(name)), key=lambda r: r.portion)
    assert [r.area_m2 for r in got] == pytest.approx(want, rel=1e-5, abs=0.02) and [r.portion for r in got] == list(range(1, len(want) + 1))
    assert {r.portions for r in got} <= {len(want)}
    for r in got:
        assert inside(r.anchor.lon, r.anchor.lat, ring) and not any(inside(r.anchor.lon, r.anchor.lat, h) for h in holes)


def test_random_regions_by_sampling_lines(spark):
    """Areas and the number of parts of star-shaped rings with random boxes cut out, against a fine grid of points."""
    rng, rows = random.Random(4), []
    for k in range(12):
        ring = shape([(50 + rng.uniform(15, 45) * math.cos(t * math.pi / 5), 50 + rng.uniform(15, 45) * math.sin(t * math.pi / 5)) for t in range(10)])
        rows.append((k, ring, [rect(rng.uniform(0, 80), rng.uniform(0, 80), rng.uniform(5, 40), rng.uniform(5, 40)) for _ in range(rng.randrange(4))]))
    got = {}
    for r in slabs.portions(spark.createDataFrame(rows, FIELD), ["k"]).collect():
        got.setdefault(r.k, []).append(r.area_m2)
    n = 400
    for k, ring, holes in rows:
        # Points along lines, offset so that none lies on a box's side.
        free = {(i, j) for i in range(n) for j in range(n) if inside((i + 0.513) * 100 / n * M, (j + 0.487) * 100 / n * M, ring) and not any(inside((i + 0.513) * 100 / n * M, (j + 0.487) * 100 / n * M, h) for h in holes)}
        assert sum(got.get(k, [])) == pytest.approx(len(free) * (100 / n) ** 2, rel=0.01, abs=2)


def test_quantities_of_overlapping_exclusions(spark):
    kind = FIELD + ", row_spacing_m double, plant_spacing_m double, post_spacing_m double, headland_width_m double, orientation_deg double"
    cases = [CASES[n] for n in ("plain", "overlapping holes", "road", "road that ends within", "all excluded", "exclusion outside")] + [(PLOT, [rect(5, 5, 4, 4)], [2384])]
    df = spark.createDataFrame([(k, r, e, 2.5, 1.0, 4.5, 0.0, 0.0) for k, (r, e, _) in enumerate(cases)], kind)
    got = {r.k: r for r in planting.quantities(df, ["k"]).collect()}
    for k, (_, _, want) in enumerate(cases):
        assert got[k].excluded_area_m2 == pytest.approx(2400 - sum(want), abs=0.05) and got[k].net_area_m2 == pytest.approx(sum(want), abs=0.05)


SIDES = "k int, sides array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"
POINTS = "k int, line int, seq int, x double, y double"


def sides(*rings):
    return [(r[i], r[(i + 1) % len(r)]) for r in rings for i in range(len(r))]


def test_quantities_are_worked_out_in_the_row(spark):
    """No row for a scan line, nothing dealt out, joined or grouped; overlapping exclusions and those across the perimeter beside plain ones, and spacings that give no rows."""
    rows = [(k, r, e, s, 0.7, 4.5, 0.0, 0.0) for k, (r, e, _) in enumerate(CASES.values()) for s in (2.0,)] + [(100, PLOT, [], s, p, 4.5, 0.0, 0.0) for s, p in ((None, 1.0),)] + [(101, PLOT, None, 0.0, 0.0, 0.0, None, 0.0)]
    df = spark.createDataFrame(rows, f"{FIELD}, row_spacing_m double, plant_spacing_m double, post_spacing_m double, headland_width_m double, orientation_deg double")
    found = planting.quantities(df, ["k"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Exchange", "Join", "Aggregate", "Generate", "FileScan"))
    got = {r.k: r for r in found.collect()}
    for k, (_, _, areas) in enumerate(CASES.values()):
        assert got[k].net_area_m2 == pytest.approx(sum(areas), abs=0.2 if sum(areas) else 1e-6)
    assert got[0].row_count == 20 and got[0].simulated_plants == 20 * 86
    assert [(got[k].row_count, got[k].theoretical_plants, got[k].total_posts, round(got[k].area_m2)) for k in (100, 101)] == [(0, 0, 0, 2400)] * 2


def test_clipped_lines(spark):
    outer, hole = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)]
    region = spark.createDataFrame([(1, sides(outer, hole))], SIDES)
    paths = {1: [(-5, 5), (15, 5)], 2: [(1, 1), (3, 3), (3, 9), (20, 9)], 3: [(-1, 0), (5, 0)], 4: [(-1, -3), (5, -3)], 5: [(2, 2), (2, 2), (2, 3)], 6: [(1, 1)], 7: [(4.5, 4.5), (5.5, 5.5)]}
    points = spark.createDataFrame([(1, n, i, float(x), float(y)) for n, p in paths.items() for i, (x, y) in enumerate(p)], POINTS)
    got = {}
    for r in sorted(lines.clip(points, region, ["k"]).collect()):
        got.setdefault((r.line, r.piece), []).append((r.x, r.y))
    assert got == {(1, 1): [(0, 5), (4, 5)], (1, 2): [(6, 5), (10, 5)], (2, 1): [(1, 1), (3, 3), (3, 9), (10, 9)], (3, 1): [(0, 0), (5, 0)], (5, 1): got[5, 1]}
    assert got[5, 1][0] == (2, 2) and got[5, 1][-1] == (2, 3)
    out = lines.clip(points, region, ["k"], inside=False)
    assert sum(r.length_m for r in lines.lengths(out, ["k", "line", "piece"]).where("line = 1").collect()) == pytest.approx(12)
    assert out.where("line = 7").count() == 2


def test_clip_keeps_what_sampling_finds(spark):
    rng = random.Random(9)
    rings, rows = [], []
    for k in range(8):
        ring = [(50 + rng.uniform(10, 45) * math.cos(t * math.pi / 6), 50 + rng.uniform(10, 45) * math.sin(t * math.pi / 6)) for t in range(12)]
        hole = [(45.0, 45.0), (55.0, 45.0), (55.0, 55.0), (45.0, 55.0)]
        rings.append((k, sides(ring, hole)))
        rows += [(k, n, i, rng.uniform(0, 100), rng.uniform(0, 100)) for n in range(3) for i in range(5)]
    got = {(r.k, r.line): r.length_m for r in lines.lengths(lines.clip(spark.createDataFrame(rows, POINTS), spark.createDataFrame(rings, SIDES), ["k"]), ["k", "line", "piece"]).groupBy("k", "line").agg(F.sum("length_m").alias("length_m")).collect()}
    for k, edges in rings:
        for n in range(3):
            path, want = [r[3:] for r in rows if r[:2] == (k, n)], 0.0
            for (ax, ay), (bx, by) in zip(path, path[1:]):
                size, steps = math.hypot(bx - ax, by - ay), 4000
                for i in range(steps):
                    x, y = ax + (i + 0.5) / steps * (bx - ax), ay + (i + 0.5) / steps * (by - ay)
                    want += size / steps * (sum((q[1] > y) != (p[1] > y) and x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0] for p, q in edges) % 2)
            assert got.get((k, n), 0.0) == pytest.approx(want, abs=0.3)


def test_trimmed_lines(spark):
    paths = {1: [(0, 0), (10, 0)], 2: [(0, 0), (3, 0), (3, 3), (9, 3)], 3: [(0, 0), (5.05, 0)], 4: [(0, 0), (5.06, 0)]}
    points = spark.createDataFrame([(1, n, i, float(x), float(y)) for n, p in paths.items() for i, (x, y) in enumerate(p)], POINTS)
    got = {}
    for r in sorted(lines.trim(points.withColumn("amount_m", F.lit(2.5)), ["k", "line"]).collect()):
        got.setdefault(r.line, []).append((round(r.x, 6), round(r.y, 6)))
    assert got == {1: [(2.5, 0), (7.5, 0)], 2: [(2.5, 0), (3, 0), (3, 3), (6.5, 3)], 4: [(2.5, 0), (2.56, 0)]}
    assert lines.trim(points.withColumn("amount_m", F.lit(None).cast("double")), ["k", "line"]).count() == points.count()


def test_owners_of_rows(spark):
    df = spark.createDataFrame([(1, PLOT, [ROAD])], FIELD)
    cells = slabs.parts(slabs.cells(slabs.field_edges(df, ["k"]), ["k"]), ["k"])
    # Metres about the middle (20, 30): below, above, more below than above, within the road nearer to the upper side, as long in both.
    paths = {1: [(0, -20), (0, -10)], 2: [(0, 10), (5, 20)], 3: [(0, -20), (0, 5)], 4: [(-5, 0.5), (5, 0.6)], 5: [(0, -10), (0, 10)]}
    points = spark.createDataFrame([(1, n, i, float(x), float(y)) for n, p in paths.items() for i, (x, y) in enumerate(p)], POINTS)
    assert {r.line: r.part for r in lines.owners(points, cells, ["k"]).collect()} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 1}


@pytest.mark.parametrize("block", [1, 1 << 18])
def test_owners_are_found_in_the_row(spark, monkeypatch, block):
    """A field's lines meet its cells in its row as they do by a join, in blocks of any size, and nothing is dealt out or written for it."""
    monkeypatch.setattr(trapezoids, "AT_ONCE", block)
    df = spark.createDataFrame([(k, r, e) for k, (r, e, _) in enumerate(CASES.values())], FIELD)
    ends = [((-5, 10), (50, 10)), ((5, 35), (5, 70)), ((20, 0), (20, 29.9)), ((60, 80), (70, 90)), ((3, 25), (8, 36)), ((7, 7), (7, 7))]
    paths = F.array(*[F.array(*[F.struct(F.lit(x * M).alias("lon"), F.lit(y * M).alias("lat")) for x, y in p]) for p in ends])
    found = lines.owners_in_fields(df.withColumn("paths", paths), ["k"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Exchange", "Join", "FileScan"))
    ref = lambda ring: tuple(np.mean(ring[:-1], axis=0))
    metres = lambda x, y, o: ((x - o[0] / M) * math.cos(math.radians(o[1])), y - o[1] / M)
    points = [(k, n, i, *map(float, metres(x, y, ref(r)))) for k, (r, _, _) in enumerate(CASES.values()) if r for n, p in enumerate(ends) for i, (x, y) in enumerate(p)]
    joined = lines.owners(spark.createDataFrame(points, POINTS), slabs.field_cells(df, ["k"]), ["k"])
    got = {(r.k, r.line): r.part for r in found.collect()}
    assert got == {(r.k, r.line): r.part for r in joined.collect()} and len(set(got.values())) > 2


N = 21


@pytest.fixture(scope="module")
def rasters(spark):
    z = {1: lambda i, j: math.hypot(i - 10, j - 10), 2: lambda i, j: float(i), 3: lambda i, j: float(abs(i - 10)), 4: lambda i, j: (i - 10) * (j - 10) / 10, 5: lambda i, j: float(max(0, i - 10))}
    return spark.createDataFrame([(m, i, j, f(i, j)) for m, f in z.items() for i in range(N) for j in range(N)], "model_id long, i int, j int, z double").cache()


def test_contours(spark, rasters):
    levels = spark.createDataFrame([(1, 5.0), (1, 0.3), (2, 7.5), (2, 8.0), (3, 0.0), (3, 2.5), (4, 0.0), (5, 0.0), (5, 4.0)], "model_id long, level double")
    found = contours.segments(rasters, levels).cache()
    chains = {}
    for r in contours.chains(found).collect():
        chains.setdefault((r.model_id, r.level, r.chain, r.closed), []).append(r)
    shapes = sorted((m, x, closed, len(rows)) for (m, x, _, closed), rows in chains.items())
    # At the saddle two level triangles meet in its middle, whose five corners branch. A ring around the cone's top, lines across the planes, a line on each side of the valley; its floor and the saddle's cross give none.
    assert [s[:3] for s in shapes] == [(1, 0.3, True), (1, 5.0, True), (2, 7.5, False), (2, 8.0, False), (3, 2.5, False), (3, 2.5, False), (5, 0.0, False), (5, 4.0, False)]
    assert dict(((m, x), n) for m, x, _, n in shapes)[2, 7.5] == 2 * (N - 1) and dict(((m, x), n) for m, x, _, n in shapes)[2, 8.0] == N - 1
    for (m, x, _, closed), rows in chains.items():
        degree = {}
        for r in rows:
            for p in ((r.u0, r.v0), (r.u1, r.v1)):
                degree[p] = degree.get(p, 0) + 1
        assert sorted(degree.values()) == ([2] * len(rows) if closed else [1, 1] + [2] * (len(rows) - 1))
        if not closed:
            rows.sort(key=lambda r: r.at)
            assert [r.at for r in rows] == list(range(len(rows))) and all((a.u1, a.v1) == (b.u0, b.v0) for a, b in zip(rows, rows[1:]))
        if m == 1:
            assert all(math.hypot(r.u0 - 10, r.v0 - 10) == pytest.approx(x, abs=0.3) for r in rows)
    told = {(r.model_id, r.level, r.reason): r.n for r in contours.diagnostics(rasters, levels).collect()}
    assert told == {(3, 0.0, "ridge-valley"): N - 1, (4, 0.0, "branch"): 5, (4, 0.0, "plateau"): 2, (5, 0.0, "plateau"): 2 * 10 * (N - 1)}


def test_long_chains_take_few_rounds(spark):
    """One line that winds through all columns: its order is found, whatever its length."""
    cells = spark.createDataFrame([(1, i, j, i + 0.4 * (1 if j % 2 else -1)) for i in range(40) for j in range(40)], "model_id long, i int, j int, z double")
    rows = contours.chains(contours.segments(cells, spark.createDataFrame([(1, 20.5)], "model_id long, level double"))).orderBy("at").collect()
    assert len({r.chain for r in rows}) == 1 and [r.at for r in rows] == list(range(len(rows))) and len(rows) > 70
    assert all((a.u1, a.v1) == (b.u0, b.v0) for a, b in zip(rows, rows[1:]))


def test_adaptive_levels(spark):
    """On a plane the steps are spacing times the sine of its slope; on a flat field there is none; where two slopes meet each has its own."""
    kind = "field int, low double, high double, slope_percent double, share_m2 double, j int, i int, k int"
    plane = [(1, float(i), i + 1.0, 75.0, 12.5, 0, i, 0) for i in range(10)]
    flat = [(2, 5.0, 5.0, 0.0, 12.5, 0, i, 0) for i in range(3)]
    bend = [(3, float(i), i + 1.0, 75.0 if i < 5 else 100 * math.tan(math.asin(0.2)), 12.5, 0, i, 0) for i in range(10)]
    got = {}
    for r in contours.adaptive_levels(spark.createDataFrame(plane + flat + bend, kind), ["field"], 2.0).collect():
        got.setdefault(r.field, []).append((r.n, r.level, r.reason))
    assert [x for _, x, _ in sorted(got[1])] == pytest.approx([0.6 + 1.2 * n for n in range(8)]) and got[2] == [(None, None, "no_progression")]
    steps = np.diff([x for _, x, _ in sorted(got[3])])
    assert steps[0] == pytest.approx(1.2) and steps[-1] == pytest.approx(0.4) and all(a >= b - 1e-9 for a, b in zip(steps, steps[1:]))
    faces = spark.createDataFrame([(1, 0.0, 2.0, s, w, 0, i, 0) for i, (s, w) in enumerate([(75.0, 1.0), (0.0, 50.0), (100 * math.tan(math.asin(0.2)), 2.0), (100 * math.tan(math.asin(0.9)), 3.0)])], kind)
    level = spark.createDataFrame([(1, 1.0), (1, 9.0)], "field int, level double")
    # Weights 2, 1, 3 of speeds 0.2, 0.6, 0.9: half of them is reached at 0.6.
    assert [(r.level, round(r.median, 9)) for r in contours.speeds_at(faces, level, ["field"]).collect()] == [(1.0, 0.6)]


def test_surfaces_within_fields(spark):
    a, b = 0.3, -0.2
    cells = spark.createDataFrame([(1, i, j, 100 + a * i * 5 + b * j * 5) for i in range(N) for j in range(N)], "model_id long, i int, j int, z double")
    shapes = {1: [(2.5, 2.5), (10.2, 3), (9, 12.7), (3, 9)], 2: [(1, 1), (15, 1), (15, 5), (4, 5), (4, 15), (1, 15)], 3: [(-1, 1), (5, 1), (5, 5), (-1, 5)], 4: [(3.1, 3.1), (3.4, 3.1), (3.4, 3.3)], 5: [(40, 40), (41, 40), (41, 41)]}
    fields = spark.createDataFrame([(k, 1, [(float(x), float(y)) for x, y in [*p, p[0]]]) for k, p in shapes.items()], "plot int, model_id long, ring array<struct<u:double,v:double>>")
    plane = lambda p: abs(sum(q[0] * r[1] - r[0] * q[1] for q, r in zip(p, p[1:] + p[:1]))) / 2 * 25
    got = {r.plot: r for r in surfaces.surface_areas(fields, cells, ["plot"]).collect()}
    for k in (1, 2, 4):
        assert got[k].plane_m2 == pytest.approx(plane(shapes[k])) and got[k].surface_m2 == pytest.approx(plane(shapes[k]) * math.sqrt(1 + a * a + b * b))
    assert got[3].surface_m2 is None and got[3].plane_m2 == pytest.approx(500) and got[5].plane_m2 is None
    low = {r.plot: r for r in surfaces.relief(fields, cells, ["plot"]).collect()}
    assert low[4].min_z == pytest.approx(100 + 1.5 * 3 - 1 * 4) and low[4].max_z == pytest.approx(100 + 1.5 * 4 - 1 * 3) and low[4].max_slope_percent == pytest.approx(100 * math.hypot(a, b))


def test_passages_in_their_field_s_row(spark):
    """Passages that have their field's ring beside them are cut there: no join, no shuffle."""
    rows = [(1, 1, (-5 * M, 20 * M), (45 * M, 20 * M), 2.0, PLOT), (2, 1, (5 * M, 5 * M), (5 * M, 5 * M), 2.0, PLOT), (3, 1, (-5 * M, 20 * M), (45 * M, 20 * M), None, None)]
    found = surfaces.passage_ground(spark.createDataFrame(rows, "k int, passage int, a struct<lon:double,lat:double>, b struct<lon:double,lat:double>, width_m double, ring array<struct<lon:double,lat:double>>"), ["k", "passage"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.k, r.part, r.label, round(r.area_m2, 2)) for r in found.collect()] == [(1, 1, None, 80.0)]


def test_passages_within_fields(spark):
    u = shape([(0, 0), (30, 0), (30, 30), (20, 30), (20, 10), (10, 10), (10, 30), (0, 30)])
    fields = spark.createDataFrame([(1, u, [])], FIELD)
    at = lambda x, y: (x * M, y * M)
    rows = [(1, 1, at(-5, 20), at(35, 20), 2.0), (1, 2, at(-5, 5), at(35, 5), None), (1, 3, at(-5, 50), at(35, 50), 2.0), (1, 4, at(5, 5), at(5, 5), 2.0), (1, 5, at(15, 9.999), at(15, 20), 1.0)]
    passages = spark.createDataFrame(rows, "k int, passage int, a struct<lon:double,lat:double>, b struct<lon:double,lat:double>, width_m double")
    got = [(r.passage, r.part, r.label, round(r.area_m2, 2)) for r in surfaces.passage_parts(fields, passages, ["k"]).orderBy("passage", "part").collect()]
    assert got == [(1, 1, "parte 1", 20.0), (1, 2, "parte 2", 20.0), (2, 1, None, 45.0)]


def square(x, y, w=1, h=1):
    return rect(x, y, w, h, 0.001)


UNIONS = {
    "three side by side, one along two": ([square(0, 0), square(1, 0), square(0, 1, 2, 1)], None, 4),
    "apart": ([square(0, 0), square(2, 0)], "apart", None),
    "corner only": ([square(0, 0), square(1, 1)], "apart", None),
    "hole": ([square(0, 0, 3, 1), square(0, 2, 3, 1), square(0, 1), square(2, 1)], "hole", None),
    "crossing": ([square(0, 0, 2, 2), square(1, 1, 2, 2)], "overlap", None),
    "one in the other": ([square(0, 0, 3, 3), square(1, 1)], "overlap", None),
    "opposite turns": ([square(0, 0)[::-1], square(1, 0)], None, 2),
    "twice": ([square(0, 0), square(0, 0)], "overlap", None),
    "no area": ([[(0, 0), (0.001, 0.001), (0, 0)]], "invalid", None),
    "one": ([square(5, 5)], None, 1),
}


def test_parcel_unions(spark):
    rows = [(n, [(8.0 + x, 44.0 + y) for x, y in r], f"r{i}") for n, (rings, _, _) in UNIONS.items() for i, r in enumerate(rings)]
    got = {r.sel: r for r in parcels.union(spark.createDataFrame(rows, "sel string, ring array<struct<lon:double,lat:double>>, reference string"), ["sel"]).collect()}
    one = math.radians(0.001) ** 2 * 6371008.8**2 * math.cos(math.radians(44))
    for name, (rings, reason, size) in UNIONS.items():
        r = got[name]
        assert r.reason == reason and r.references == [f"r{i}" for i in range(len(rings))]
        assert (r.area_m2 is None) if size is None else r.area_m2 == pytest.approx(size * one, rel=1e-3)
        if size:
            assert r.ring[0] == r.ring[-1] and len(set(map(tuple, r.ring))) == len(r.ring) - 1


@pytest.mark.parametrize("block", [1, 1 << 18])
def test_unions_are_made_in_the_selection_s_row(spark, monkeypatch, block):
    """One shuffle brings a selection together and its plan stays short, whatever the steps; blocks of any size give the same, and a selection without any ring is invalid."""
    from terraloom.functions import outlines

    monkeypatch.setattr(outlines, "AT_ONCE", block)
    rows = [(n, [(8.0 + x, 44.0 + y) for x, y in r], f"r{i}") for n, (rings, _, _) in UNIONS.items() for i, r in enumerate(rings)] + [("null", None, "r0")]
    found = parcels.union(spark.createDataFrame(rows, "sel string, ring array<struct<lon:double,lat:double>>, reference string"), ["sel"])
    plan = found._jdf.queryExecution().executedPlan()
    assert plan.toString().split("== Initial Plan ==")[0].count("Exchange") == 1 and len(found._jdf.queryExecution().optimizedPlan().toString()) < 2000
    assert {r.sel: r.reason for r in found.collect()} == {n: reason for n, (_, reason, _) in UNIONS.items()} | {"null": "invalid"}


def test_portion_designs(spark):
    """A label keeps the inherited design; a new direction clears the inherited curve, a curve of one's own stays; an invalid number is zero."""
    kind = "id int, label string, mode string, orientation_deg double, curve_points array<struct<position:double,offset_m:double>>, equidistant boolean, inherited string, conflict string"
    curve = [(0.5, 7.0)]
    portions = spark.createDataFrame([(n, "A", m, 10.0, curve, True, None if m == "local" else "base", "merged-layouts") for n, m in enumerate(["inherited", "inherited", "local", "inherited", "local"])], kind)
    edits = spark.createDataFrame([(0, "B", None, None, None), (1, None, 45.0, None, None), (2, None, float("nan"), None, False), (3, None, None, [(0.2, 1.0)], None)], "id int, label string, orientation_deg double, curve_points array<struct<position:double,offset_m:double>>, equidistant boolean")
    got = [tuple(r)[1:] for r in designs.patched_portions(portions, edits, ["id"]).orderBy("id").collect()]
    assert got == [
        ("B", "inherited", 10.0, curve, True, "base", "merged-layouts"), ("A", "local", 45.0, [], True, None, None), ("A", "local", 0.0, curve, False, None, None),
        ("A", "local", 10.0, [(0.2, 1.0)], True, None, None), ("A", "local", 10.0, curve, True, None, "merged-layouts"),
    ]


def test_unions_cut_each_ring_once(spark):
    """Each parcel's corners are rounded once for the sides and once for the selection's corners, however often later steps name them."""
    from terraloom.operators import parcels

    ring = "array<struct<lon:double,lat:double>>"
    one = spark.createDataFrame([(1, [(0.0, 0.0), (0.001, 0.0), (0.001, 0.001), (0.0, 0.0)], "A")], f"k int, ring {ring}, reference string")
    found = parcels.union(one, ["k"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("round(") <= 4
    assert found.first().reason is None and len(found.first().ring) == 4


def test_cells_join_without_a_union(spark):
    """Heights come from one join of sides; a union of dealt rows makes the next join fail where adaptive execution reads its inputs differently."""
    from terraloom.operators import slabs

    box = [(0, 0, 0, 4, 0), (0, 4, 0, 4, 2), (0, 4, 2, 0, 2), (0, 0, 2, 0, 0)]
    edges = spark.createDataFrame([(1, r, float(a), float(b), float(c), float(d)) for r, a, b, c, d in box], "k int, ring int, x1 double, y1 double, x2 double, y2 double")
    found = slabs.cells(edges, ["k"])
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.y0, r.y1, r.l0, r.r0) for r in found.collect()] == [(0.0, 2.0, 0.0, 4.0)]


def test_clipped_in_fields(spark):
    """Lines in their field's row give the pieces that lines and rings of two tables give; closed, open, empty and null rings, with and without exclusions."""
    at = lambda *p: [(8 + x / 1e4, 44 + y / 1e4) for x, y in p]
    ring, hole, line = at((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), at((1, 1), (2, 1), (2, 2), (1, 2)), at((-1, 1.5), (3, 1.5), (5, 3))
    kind = "array<struct<lon:double,lat:double>>"
    rows = [(1, ring, [hole], [line, at((0, 5), (4, 5))]), (2, ring[:4], [], [line]), (3, None, [hole], [line]), (4, [], [], [line]), (5, ring, None, []), (6, ring, [hole, ring], [line[:1], line])]
    fields = spark.createDataFrame(rows, f"k int, ring {kind}, exclusions array<{kind}>, paths array<{kind}>")
    got = {(r.k, r.line, r.piece): [(p.x, p.y) for p in r.path] for r in lines.clipped_in_fields(fields, ["k"]).collect()}
    sides = lines.region_sides(fields, ["k"])
    points = fields.join(sides, "k").select("k", "ref", F.posexplode("paths").alias("line", "path")).select("k", "line", "ref", F.posexplode("path").alias("seq", "p")).select("k", "line", "seq", lines.geo.to_xy(F.col("p"), F.col("ref")).alias("p")).select("k", "line", "seq", "p.x", "p.y")
    want = {}
    for r in sorted(lines.clip(points, sides, ["k"]).collect()):
        want.setdefault((r.k, r.line, r.piece), []).append((r.x, r.y))
    assert {k: len(p) for k, p in got.items()} == {k: len(p) for k, p in want.items()} and {k[0] for k in got} == {1, 2, 6}
    for k, path in want.items():
        assert np.allclose(got[k], path, atol=1e-9)
    assert [k for k in got if k[0] == 1] == [(1, 0, 1), (1, 0, 2)]


def test_chains_read_segments_from_files(spark):
    """Segments are written once; what they were made of is not planned for each step that reads them."""
    rows = [(1, 5.0, a, float(a), 0.0, a + 1, a + 1.0, 0.0) for a in range(1, 4)]
    found = contours.chains(spark.createDataFrame(rows, "model_id long, level double, a long, ua double, va double, b long, ub double, vb double"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan
    assert sorted((r.at, min(r.u0, r.u1)) for r in found.collect()) in ([(0, 1.0), (1, 2.0), (2, 3.0)], [(0, 3.0), (1, 2.0), (2, 1.0)])
