"""Hand-computed cases of the planning operators, and every query against its SQL on the smallest tables."""

import collections
import math
import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from terraloom.functions import geo  # noqa: E402
from terraloom.functions.common import ceil25, poisoned_sum  # noqa: E402
from terraloom.operators import archive, dashboard, folds, planting, terrain  # noqa: E402
from terraloom.plans import registry  # noqa: E402
from terraloom.sources.views import view, with_rings  # noqa: E402
from terraloom.streaming import logs  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()



def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    found = duck.sql(registry.ORACLES[name])
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).limit(5).count() == 5


RING = [(8.0, 44.0), (8.0 + 10 / (geo.RAD * geo.EARTH_M * math.cos(44 * geo.RAD)), 44.0), (8.0 + 10 / (geo.RAD * geo.EARTH_M * math.cos(44 * geo.RAD)), 44.0 + 10 / (geo.RAD * geo.EARTH_M)), (8.0, 44.0 + 10 / (geo.RAD * geo.EARTH_M)), (8.0, 44.0)]
FIELD = "project_id long, client_field_id long, display_order int, ring array<struct<lon:double,lat:double>>, exclusions array<array<struct<lon:double,lat:double>>>, row_spacing_m double, plant_spacing_m double, post_spacing_m double, headland_width_m double, orientation_deg double"


def field(spark, ring=RING, holes=(), headland=0.0, angle=0.0, spacing=2.5):
    return spark.createDataFrame([(1, 1, 1, ring, list(holes), spacing, 1.0, 4.5, headland, angle)], FIELD)


def test_square_field(spark):
    m = planting.polygon_metrics(field(spark)).first()
    assert m.vertex_count == 4 and m.area_m2 == pytest.approx(100, rel=1e-3) and m.perimeter_m == pytest.approx(40, rel=1e-3)
    rows = planting.generate_rows(field(spark)).collect()
    assert len(rows) == 4 and all(r.length_m == pytest.approx(10, rel=1e-3) for r in rows)
    assert sum(r.length_m for r in planting.generate_rows(field(spark, headland=3.0)).collect()) == pytest.approx(16, rel=1e-2)
    q = planting.quantities(field(spark)).first()
    assert q.simulated_plants == 4 * 11 or q.simulated_plants == 4 * 10
    assert q.commercial_plants_25 == 50 and q.head_posts == 8


def test_exclusion_cuts_rows(spark):
    (a, b), (c, d) = RING[0], RING[2]
    x, y = (a + (c - a) * 0.4, a + (c - a) * 0.6), (b + (d - b) * 0.4, b + (d - b) * 0.6)
    hole = [(x[0], y[0]), (x[1], y[0]), (x[1], y[1]), (x[0], y[1]), (x[0], y[0])]
    rows = planting.generate_rows(field(spark, holes=[hole], spacing=1.0)).collect()
    assert len(rows) == 12 and sum(r.length_m for r in rows) == pytest.approx(96, rel=1e-2)


def test_orientation_follows_the_long_side(spark):
    long = [(x if i in (0, 3, 4) else 8.0 + 4 * (x - 8.0), y) for i, (x, y) in enumerate(RING)]
    assert planting.best_orientation(field(spark, ring=long)).first().angle == 90


def test_bow_tie_is_invalid(spark):
    ring = [(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]
    assert not planting.valid_rings(field(spark, ring=ring)).first().valid
    assert planting.valid_rings(field(spark)).first().valid
    assert not planting.valid_rings(field(spark, ring=RING[:-1])).first().valid


def test_label_point_of_a_concave_field(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 0.2), (0.2, 0.2), (0.2, 4.0), (0.0, 4.0), (0.0, 0.0)]
    p = planting.label_points(field(spark, ring=ring)).first()
    assert (0 < p.lon < 4 and 0 < p.lat < 0.2) or (0 < p.lon < 0.2 and 0 < p.lat < 4)


def test_utm_control_points_and_round_trip(spark):
    df = spark.createDataFrame([(9.0, 45.0), (11.0, 44.5), (9.0, 0.0), (50.0, 45.0), (9.0, -1.0)], "lon double, lat double")
    got = df.select(geo.to_utm(F.col("lon"), F.col("lat")).alias("u")).collect()
    assert got[0].u.x == pytest.approx(500000, abs=1e-6) and got[0].u.y == pytest.approx(4982950.4002, abs=1e-3)
    assert got[2].u.y == pytest.approx(0, abs=1e-6) and got[3].u is None and got[4].u is None
    back = df.limit(2).select("lon", "lat", geo.to_utm(F.col("lon"), F.col("lat")).alias("u")).select("lon", "lat", geo.from_utm(F.col("u.x"), F.col("u.y")).alias("g")).collect()
    assert all(r.g.lon == pytest.approx(r.lon, abs=1e-11) and r.g.lat == pytest.approx(r.lat, abs=1e-11) for r in back)


@pytest.mark.parametrize("text, kind, lat", [("44.97, 7.96", "coordinate", 44.97), ("44° 30' 0\" N 8° 0' 0\" E", "coordinate", 44.5), ("8°0'0\"E, 44°30'0\"N", "coordinate", 44.5), ("91, 10", "invalid", None), ("44° 60' 0\" N 8° 0' 0\" E", "invalid", None), ("Via Roma 12", "address", None), ("", "address", None), (None, "address", None)])
def test_coordinate_text(spark, text, kind, lat):
    r = spark.createDataFrame([(text,)], "q string").select(geo.parse_coordinates(F.col("q")).alias("c")).first().c
    assert r.kind == kind and (r.lat is None if lat is None else r.lat == pytest.approx(lat))


def test_rounding_and_poisoned_sum(spark):
    df = spark.createDataFrame([(0.0, False), (-3.0, False), (25.0, False), (25.1, False), (float("nan"), False), (None, False)], "x double, bad boolean")
    assert [r.c for r in df.select(ceil25(F.col("x")).alias("c")).collect()] == [0, 0, 25, 50, 0, 0]
    s = spark.createDataFrame([(1, 5, False), (1, 6, True), (2, 7, False), (2, None, False)], "k int, v int, bad boolean").groupBy("k").agg(poisoned_sum(F.col("v"), F.col("bad")).alias("s"))
    assert {r.k: r.s for r in s.collect()} == {1: None, 2: 7}


def test_counter_floor(spark):
    acts = ["increment"] * 30 + ["decrement"] * 3 + ["set"] + ["decrement"] * 4 + ["increment"]
    rows = [(1, i, i, a, 2) for i, a in enumerate(acts)]
    got = folds.counters(spark.createDataFrame(rows, "count_id long, op_id long, ts long, action string, set_value long")).orderBy("op_id").collect()
    assert got[32].quantity == 27 and [r.quantity for r in got[33:]] == [2, 1, 0, 0, 0, 1]


def test_replaying_a_log_twice_changes_nothing(spark):
    rows = [(1, 9, 1, 1, 0), (2, 9, 2, 2, 1), (3, 9, 3, 3, 1), (4, 9, 4, 4, 2)]
    schema = "operation_id long, project_id long, ts long, seq long, expected_version long"
    once = folds.apply_operations(spark.createDataFrame(rows, schema))
    twice = folds.apply_operations(spark.createDataFrame(rows + [(a, b, c + 10, d + 10, e) for a, b, c, d, e in rows], schema))
    pick = lambda df: sorted((r.operation_id, r.status, r.server_version) for r in df.collect())
    assert pick(once) == pick(twice) == [(1, "applied", 1), (2, "applied", 2), (3, "conflict", 2), (4, "applied", 3)]


def test_plane_terrain(spark):
    cells = spark.createDataFrame([(1, i, j, 3.0 * i + 4.0 * j) for i in range(6) for j in range(5)], "model_id long, i int, j int, z double")
    assert terrain.summary(cells).first().max_slope_percent == pytest.approx(100.0)
    assert terrain.surface_area(cells).first().surface_m2 == pytest.approx(25 * 20 * math.sqrt(2))
    points = spark.createDataFrame([(1, 0, 1.5, 2.25), (1, 1, 5.0, 4.0), (1, 2, 5.1, 0.0)], "model_id long, point int, u double, v double")
    assert [r.z for r in terrain.heights_at(points, cells).orderBy("point").collect()] == [pytest.approx(13.5), pytest.approx(31.0), None]


def test_tiles(spark):
    import base64
    import struct

    good = base64.b64encode(struct.pack("<4f", 1, 2, 3, 4)).decode()
    rows = [(1, 2, 2, good), (2, 2, 3, good), (3, 2, 2, base64.b64encode(struct.pack("<4f", 1, 2, 3, float("nan"))).decode()), (4, 2, 2, None)]
    got = terrain.explode_tiles(spark.createDataFrame(rows, "model_id long, width int, height int, values_base64 string")).orderBy("j", "i").collect()
    assert [(r.model_id, r.i, r.j, r.z) for r in got] == [(1, 0, 0, 1.0), (1, 1, 0, 2.0), (1, 0, 1, 3.0), (1, 1, 1, 4.0)]


def test_national_reference(spark):
    refs = spark.createDataFrame([("a123b0045_0.77/b",), ("nonsense",), (None,)], "r string").select(archive.parse_reference(F.col("r")).alias("p")).collect()
    assert tuple(refs[0].p) == ("A123", "B", "45", None, None, "77/B") and refs[1].p is None and refs[2].p is None


def test_field_rows_join_without_cartesian(spark):
    from terraloom.plans.dashboard import _rows

    plan = _rows(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_keep_whole_words_and_tokens(spark):
    rows = spark.createDataFrame([("a", "campo 1 barbera"), ("b", "barbera campo"), ("c", "dolcetto")], "row_id string, search_text string")
    assert {r.row_id for r in dashboard.filter_rows(rows, query=" Campo  barbera ").collect()} == {"a", "b"}


def stream(spark, tmp_path, df, make):
    src, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    df.coalesce(1).write.parquet(src)
    made = make(spark.readStream.schema(df.schema).parquet(src))
    made.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def test_stream_counters_equal_batch(spark, tmp_path):
    rows = [(k, 10 * k + i, f"2024-01-0{1 + i}", a, 5) for k in (1, 2) for i, a in enumerate(["increment", "decrement", "decrement", "set", "decrement", "increment"])]
    df = spark.createDataFrame(rows, "count_id long, op_id long, ts string, action string, set_value long").withColumn("ts", F.to_timestamp("ts"))
    got = {(r.op_id, r.quantity) for r in stream(spark, tmp_path, df, logs.counters).collect()}
    assert got == {(r.op_id, r.quantity) for r in folds.counters(df).collect()}


def test_stream_operations_equal_batch(spark, tmp_path):
    rows = [(1, 9, "2024-01-01", 1, 0), (2, 9, "2024-01-02", 2, 1), (3, 9, "2024-01-03", 3, 1), (2, 9, "2024-01-02", 4, 1)]
    df = spark.createDataFrame(rows, "operation_id long, project_id long, ts string, seq long, expected_version long").withColumn("ts", F.to_timestamp("ts"))
    pick = lambda d: sorted((r.operation_id, r.status, r.server_version) for r in d.collect())
    assert pick(stream(spark, tmp_path, df, logs.operations)) == pick(folds.apply_operations(df))


def test_deliveries_lease_and_give_up(spark):
    from terraloom.operators import records

    log = [(1, 0, 1, "claim"), (1, 60, 2, "claim"), (1, 130, 3, "claim"), (1, 140, 4, "failed"), (1, 150, 5, "claim"), (1, 160, 6, "provider_accepted"), (1, 999, 7, "claim"), (2, 0, 1, "claim"), (2, 24 * 3600, 2, "claim"), (2, 24 * 3600 + 1, 3, "failed")]
    got = records.deliveries(spark.createDataFrame(log, "submission_id long, at_s long, seq long, action string")).orderBy("submission_id", "seq").collect()
    assert [(r.state, r.send) for r in got] == [("sending", True), ("sending", False), ("sending", True), ("failed", False), ("sending", True), ("provider_accepted", False), ("provider_accepted", False), ("sending", True), ("uncertain", False), ("uncertain", False)]


def test_parcels_by_crossing_and_by_holding(spark):
    from terraloom.operators import spatial

    square = lambda x, y, n: [(x, y), (x + n, y), (x + n, y + n), (x, y + n), (x, y)]
    fields = spark.createDataFrame([(1, square(0.0, 0.0, 0.01)), (2, square(0.1, 0.1, 0.001))], "id long, ring array<struct<lon:double,lat:double>>")
    parcels = spark.createDataFrame([(10, 1, square(0.005, 0.005, 0.01)), (11, 2, square(0.002, 0.002, 0.001)), (12, 3, square(0.09, 0.09, 0.03)), (13, 4, square(0.5, 0.5, 0.01))], "parcel_id long, ordinal long, ring array<struct<lon:double,lat:double>>")
    assert {tuple(r) for r in spatial.touching(fields, parcels, ["id"]).collect()} == {(1, 10), (1, 11), (2, 12)}
    points = spark.createDataFrame([(1, 0.0025, 0.0025), (2, 0.006, 0.006), (3, 0.3, 0.3)], "id long, lon double, lat double")
    assert {(r.id, r.parcel_id) for r in spatial.points_in_parcels(points, parcels, ["id"]).collect()} == {(1, 11), (2, 10), (3, None)}


def test_geojson_rejects_and_labels(spark):
    from terraloom.sources import ingest

    ring = "[[0,0],[1,0],[1,1],[0,0]]"
    rows = [
        (1, f'{{"type":"Polygon","coordinates":[{ring}]}}'),
        (2, f'{{"type":"Feature","properties":{{"name":" Vigna "}},"geometry":{{"type":"MultiPolygon","coordinates":[[{ring}],[{ring}]]}}}}'),
        (3, '{"type":"Polygon","coordinates":[[[0,0],[1,1],[1,0],[0,1],[0,0]]]}'),
        (4, f'{{"type":"Polygon","coordinates":[{ring},{ring}]}}'),
        (5, '{"type":"Point","coordinates":[0,0]}'),
        (6, "not json"),
        (7, None),
    ]
    good, bad = ingest.geojson_fields(spark.createDataFrame(rows, "id long, body string"), "id", "body")
    assert {(r.id, r.part_index, r.label) for r in good.collect()} == {(1, 0, "Campo storico 1"), (2, 0, "Vigna · 1"), (2, 1, "Vigna · 2")}
    assert sorted(r.id for r in bad.collect()) == [3, 4, 5, 6, 7]


def test_quantities_hold_the_whole_record(spark):
    some = F.col("project_id") % 50 == 1
    given = {tuple(r[k] for k in planting.KEY): r for r in view(spark, DATA, "project_fields").where(some).collect()}
    lengths = collections.defaultdict(list)
    for r in planting.generate_rows(with_rings(view(spark, DATA, "project_fields").where(some))).collect():
        lengths[tuple(r[k] for k in planting.KEY)].append(r.length_m)
    got = registry.QUERIES["g11_quantities"](spark, DATA).where(some).collect()
    assert len(got) == len(given) > 0
    for r in got:
        f = given[tuple(r[k] for k in planting.KEY)]
        rows = lengths[tuple(r[k] for k in planting.KEY)]
        plants = sum(math.floor(x / f.plant_spacing_m) + 1 for x in rows) if f.plant_spacing_m > 0 else 0
        posts = sum(max(0, math.ceil(x / f.post_spacing_m) - 1) for x in rows)
        assert (r.row_count, r.simulated_plants, r.intermediate_posts, r.total_posts) == (len(rows), plants, posts, posts + r.head_posts)
        assert r.commercial_plants_25 == math.ceil((plants or r.theoretical_plants) / 25) * 25
        assert r.perimeter_m > 0 and r.headland_area_m2 >= 0


def test_rules_by_hand(spark):
    """Values worked out from the rules, not from the operators."""
    rows = [(1, 2.5, 1.0, 6.0, True), (2, 2.5, 1.0, None, True), (3, 0.0, 1.0, 0.0, True), (4, None, 1.0, 3.0, False), (5, 2.0, 0.9, None, False)]
    df = spark.createDataFrame(rows, "id int, row_spacing_m double, plant_spacing_m double, headland_width_m double, mechanised boolean")
    assert sorted((r.id, r.advice) for r in archive.advice(df, ["id"]).collect()) == [
        (1, "mechanization_verify_machine"), (2, "mechanization_headland_missing"), (3, "mechanization_headland_missing"), (3, "spacing_incomplete"), (4, "spacing_incomplete")
    ]
    widths = spark.createDataFrame([(None, True), (None, False), (-1.0, True), (-1.0, False), (4.0, True), (4.0, False), (8.0, True)], "w double, m boolean")
    assert [r.h for r in widths.select(archive.headland(F.col("w"), F.col("m")).alias("h")).collect()] == [6.0, None, 6.0, None, 6.0, 4.0, 8.0]
    from terraloom.operators import records

    steps = spark.createDataFrame([(2.0, 0.0, 0.0), (2.0, 0.5, 0.0), (2.0, 0.0, 0.75), (2.0, 0.5, 0.75)], "g double, a double, b double")
    assert [r.s for r in steps.select(records.horizontal_step(F.col("g"), F.col("a"), F.col("b")).alias("s")).collect()] == pytest.approx([2.0, 2.0, 1.6, 2 * math.sqrt(1.25 / 1.8125)])


def test_a_dead_alias_hides_the_code_behind_it(spark):
    projects = spark.createDataFrame([(1, "VO-0000001", "saved", None), (2, "VO-0000002", "saved", "2024"), (3, "VO-0000003", "draft", None), (4, "VO-0000004", "client", None)], "project_id long, public_code string, status string, deleted_at string")
    aliases = spark.createDataFrame([("VO-0000001", 2), ("VO-9000000", 4)], "code string, project_id long")
    asked = spark.createDataFrame([("VO-0000001",), ("VO-9000000",), ("VO-0000003",), (" vo-0000004 ",), ("VO-4",), (None,)], "code string")
    assert {r.code: r.project_id for r in archive.resolve_codes(asked, aliases, projects).collect()} == {"VO-0000001": None, "VO-9000000": 4, "VO-0000003": None, " vo-0000004 ": 4, "VO-4": None, None: None}


def test_entries_without_keys_are_not_repeats(spark):
    sent = spark.createDataFrame([(1, 1, None, 1, 5), (1, 1, 7, 1, 5)], "submission_id long, list_id long, client_field_id long, entry_no int, quantity long")
    live = spark.createDataFrame([(1, 7, 1, 5)], "list_id long, client_field_id long, entry_no int, quantity long")
    assert archive.check_snapshots(spark.createDataFrame([(1,)], "submission_id long"), sent, live).first().verdict == "gone"


def test_repeated_operations_get_their_first_answer(spark):
    rows = [(1, 9, 1, 1, 0), (2, 9, 2, 2, 1), (1, 9, 3, 3, 2), (3, 9, 4, 4, 1)]
    got = folds.answers(spark.createDataFrame(rows, "operation_id long, project_id long, ts long, seq long, expected_version long")).orderBy("seq").collect()
    assert [(r.operation_id, r.status, r.server_version, r.repeated) for r in got] == [(1, "applied", 1, False), (2, "applied", 2, False), (1, "applied", 1, True), (3, "conflict", 2, False)]


def test_soil_and_gml_answers(spark):
    from terraloom.sources import ingest

    soil = [(1, "Cod_UCS_50: B12\r\nPendenza: 3\nSostanza organica = 1,2\nScheletro: 'assente'\npH: 15\nlimo: 33,5 %"), (2, "ServiceException: x"), (3, "altro: 1"), (4, None), (5, ""), (6, "texture: a:b\ntexture: n/a\nsand: 1e1")]
    got = {r.id: r for r in ingest.soil_profiles(spark.createDataFrame(soil, "id long, body string"), "id", "body").collect()}
    assert set(got) == {1, 6}
    assert (got[1].soil_unit, got[1].code, got[1].organic_matter, got[1].skeleton, got[1].ph, got[1].silt, got[1].description) == ("B12", "B12", "1,2", "assente", None, 33.5, "B12")
    assert (got[6].texture, got[6].sand, got[6].description) == ("a:b", None, "a:b")
    member = "<wfs:member><cp:CadastralParcel gml:id='{0}'><cp:nationalCadastralReference>A&amp;B</cp:nationalCadastralReference><gml:posList srsDimension='2'> {1} </gml:posList></cp:CadastralParcel></wfs:member>"
    body = '<wfs:FeatureCollection numberReturned="4">' + member.format("a", "44 8 44 9 45 9 44 8") + member.format("b", "44 8 44 9 45 9") + member.format("c", "144 8 44 9 45 9") + "</wfs:FeatureCollection>"
    out = ingest.gml_parcels(spark.createDataFrame([(1, body), (2, None), (3, "<x/>")], "id long, body string"), "id", "body").orderBy("ordinal").collect()
    assert [(r.gml_id, r.reference, r.complete, len(r.ring)) for r in out] == [("a", "A&B", False, 4), ("b", "A&B", False, 4)]
    assert tuple(out[0].ring[1]) == (9.0, 44.0)


@pytest.mark.parametrize("text, kind", [("lat: 4", "invalid"), ("12 Via Roma", "address"), ("44,5", "coordinate"), ("44;5", "invalid"), ("45 30 N", "invalid"), ("44.1, x", "address"), ("-44.5 , +8.", "coordinate"), ("N 44° Roma", "invalid"), ("44, NaN", "invalid"), ("44° 30' 0\" N 45° 0' 0\" N", "invalid"), ("90° 0' 0\" S; 180° 0' 0\" W", "coordinate"), ("90° 0' 1\" S 8° 0' 0\" W", "invalid"), ("Latina 5", "address")])
def test_coordinate_kinds(spark, text, kind):
    assert spark.createDataFrame([(text,)], "q string").select(geo.parse_coordinates(F.col("q")).alias("c")).first().c.kind == kind


def test_fields_on_parcels_by_brute_force(spark):
    """Skewed and L-shaped rings against every parcel, edge by edge."""
    from terraloom.operators import spatial
    from terraloom.plans import records as plans

    def inside(x, y, ring):
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:])) % 2 == 1

    def turn(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    def meets(f, p):
        crossed = any(turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0 for a, b in zip(f, f[1:]) for c, d in zip(p, p[1:]))
        return crossed or any(inside(*v, f) for v in p) or any(inside(*v, p) for v in f)

    fields = with_rings(view(spark, DATA, "project_fields").where("project_id % 40 = 3"))
    rings = {(r.project_id, r.client_field_id): [tuple(p) for p in r.ring] for r in fields.collect()}
    parcels = plans.parcels(spark, DATA)
    squares = {r.parcel_id: [tuple(p) for p in r.ring] for r in parcels.collect()}
    near = lambda f, p: abs(f[0][0] - p[0][0]) < 0.02 and abs(f[0][1] - p[0][1]) < 0.02
    want = {(*k, pid) for k, f in rings.items() for pid, p in squares.items() if near(f, p) and meets(f, p)}
    assert want and {tuple(r) for r in spatial.touching(fields, parcels, plans.KEY).collect()} == want


def test_curve_controls_by_brute_force(spark):
    from terraloom.operators import catalog

    rng = __import__("random").Random(2)
    rows = [(k, i, rng.choice([None, float("nan"), *[rng.random() * 1.2 - 0.1 for _ in range(8)], 0.5, 0.5004]), rng.uniform(-150, 150)) for k in range(20) for i in range(rng.randint(1, 40))]
    got = {r.field: [(p.position, p.id, p.offset_m) for p in r.controls] for r in catalog.curve_controls(spark.createDataFrame(rows, "field long, i long, position double, offset_m double"), "field", "i").collect()}
    for k in {r[0] for r in rows}:
        points = sorted((min(max(p, 0.01), 0.99), i, min(max(o, -100.0), 100.0)) for f, i, p, o in rows if f == k and p is not None and not math.isnan(p))
        kept = []
        for p in points:
            near = next((n for n, q in enumerate(kept) if abs(q[0] - p[0]) < 0.001), None)
            kept = kept + [p] if near is None else [*kept[:near], p, *kept[near + 1 :]]
        assert got.get(k, []) == pytest.approx(kept[:24]) if not points else [tuple(map(float, p)) for p in got[k]] == [pytest.approx(p) for p in kept[:24]]


def test_count_operations_by_hand(spark):
    from terraloom.operators import versions

    lists = spark.createDataFrame([(1, 5, None), (2, 5, "gone"), (3, 5, None)], "list_id long, owner_user_id long, deleted_at string")
    conflict, missing, wrong = lambda n: ("VERSION_CONFLICT", n), ("NOT_FOUND_OR_FORBIDDEN", None), ("VALIDATION_ERROR", None)
    # op, count, list, owner, digest, expected, deletes, category, field -> outcome, revision
    cases = [
        ((1, 7, 1, 5, "a", 0, False, "plants", None), ("APPLIED", 1)),
        ((2, 7, 1, 5, "b", 0, False, "plants", None), conflict(1)),
        ((1, 7, 1, 5, "a", 0, False, "plants", None), ("APPLIED", 1)),
        ((1, 7, 1, 5, "z", 0, False, "plants", None), wrong),
        ((3, 7, 3, 5, "c", 1, False, "plants", None), wrong),
        ((4, 7, 1, 5, "d", 1, False, "posts", None), wrong),
        ((5, 7, 1, 5, "e", 1, True, "plants", None), ("APPLIED", 2)),
        ((6, 7, 1, 5, "f", 2, False, "plants", None), conflict(2)),
        ((7, 7, 1, 5, "g", 2, True, "plants", None), ("APPLIED", 3)),
        ((8, 8, 2, 5, "h", 0, False, "plants", None), missing),
        ((9, 8, 2, 5, "i", 0, True, "plants", None), ("APPLIED", 1)),
        ((10, 9, 1, 6, "j", 0, False, "plants", None), missing),
        ((11, 10, 1, 5, "k", 2, False, "plants", None), missing),
        ((12, 11, 1, 5, "l", 0, False, "plants", "f1"), ("APPLIED", 1)),
        ((13, 12, 1, 5, "m", 0, False, "plants", "f9"), ("FIELD_UNAVAILABLE", None)),
        ((14, 13, 1, 5, "n", 4, False, "plants", "f9"), ("APPLIED", 5)),
        ((15, 13, 1, 5, "o", 5, False, "plants", "f8"), ("FIELD_UNAVAILABLE", None)),
        # A failed operation is judged anew when it comes again.
        ((16, 14, 1, 5, "p", 1, False, "plants", None), missing),
        ((17, 14, 1, 5, "q", 0, False, "plants", None), ("APPLIED", 1)),
        ((16, 14, 1, 5, "p", 1, False, "plants", None), ("APPLIED", 2)),
    ]
    ops = spark.createDataFrame([(c[0], seq, *c[1:]) for seq, (c, _) in enumerate(cases)], "op_id long, seq long, count_id long, list_id long, owner long, digest string, expected long, deletes boolean, category string, field string")
    base = spark.createDataFrame([(13, 4, 1, "plants", "f9", False)], "count_id long, revision long, list_id long, category string, field string, deleted boolean")
    fields = spark.createDataFrame([(5, "f1")], "owner long, field string")
    got = [(r.outcome, r.revision) for r in versions.apply_counts(ops, lists, base, fields).orderBy("seq").collect()]
    assert got == [want for _, want in cases]


def test_field_edits_see_what_came_before(spark):
    from terraloom.operators import versions

    fields = spark.createDataFrame([(1, 10, "a", 5.0, 25), (1, 11, "b", 7.0, 50), (2, 20, "c", 1.0, 25)], "project_id long, client_field_id long, label string, area_m2 double, commercial_plants_25 long")
    projects = spark.createDataFrame([(1, 3, 1), (2, 0, 0)], "project_id long, version long, latest_revision_number long")
    cases = [
        ((1, 10, "rename", " x ", 3), ("applied", 4)), ((1, 10, "rename", "y", 3), ("conflict", 4)), ((1, 10, "rename", "z" * 81, 4), ("name_required", 4)), ((1, 10, "rename", " ", 4), ("name_required", 4)),
        ((1, 11, "delete", None, 4), ("applied", 5)), ((1, 11, "rename", "w", 5), ("field_not_found", 5)), ((2, 20, "delete", None, 0), ("applied", 1)), ((2, 20, "rename", "v", 1), ("not_found", None)), ((9, 1, "delete", None, 0), ("not_found", None)),
    ]
    edits = spark.createDataFrame([(c[0], n, *c[1:]) for n, (c, _) in enumerate(cases)], "project_id long, seq long, client_field_id long, action string, name string, expected_version long")
    got = versions.edit_results(edits, fields, projects).orderBy("seq").collect()
    assert [(r.outcome, r.server_version) for r in got] == [w for _, w in cases] and [r.new_revision for r in got if r.outcome == "applied"] == [2, 3, 1]
    left, after = versions.edit_fields(fields, edits, projects)
    assert [(r.client_field_id, r.label) for r in left.collect()] == [(10, "x")]
    assert sorted(tuple(r) for r in after.collect()) == [(1, 5, 3, 1, 5.0, 25, False), (2, 1, 1, 0, 0.0, 0, True)]


@pytest.mark.parametrize("order", [(1, 2), (2, 1)])
def test_field_moves_that_meet_in_a_project(spark, order):
    """Two moves into one project in either order, a clash of ids, an emptied project, a repeated and a refused operation."""
    from terraloom.operators import versions

    projects = spark.createDataFrame([(1, 5, None, 3, 1, ["a"]), (2, 5, None, 0, 0, ["a", "b"]), (3, 5, None, 7, 2, ["a", "c"]), (4, 6, None, 0, 0, ["z"]), (5, 5, "gone", 0, 0, ["y"])], "project_id long, owner_user_id long, deleted_at string, version long, latest_revision_number long, field_ids array<string>")
    first = {1: (11, 1, 3, "a", 5, False), 2: (12, 2, 3, "a", 5, False)}
    rows = [first[k] for k in order] + [(11, 1, 3, "a", 5, False), (13, 1, 4, "a", 5, True), (14, 1, 1, "a", 5, False), (15, 3, 5, "c", 5, False), (16, 3, 2, "c", 9, False), (17, 3, 2, "c", 9, True), (18, 3, 2, "c", 5, False), (19, 3, 2, " ", 5, False)]
    moves = spark.createDataFrame([(r[0], n, *r[1:]) for n, r in enumerate(rows)], "op_id long, seq long, source_id long, target_id long, field_id string, user_id long, admin boolean")
    results = versions.move_results(moves, projects)
    got = results.orderBy("seq").collect()
    assert [r.outcome for r in got] == ["field_moved"] * 3 + ["access_denied", "same_project", "access_denied", "access_denied", "field_moved", "field_not_found", "field_required"]
    again = got[order.index(1)]
    assert tuple(got[2])[1:] == tuple(again)[1:] and [r.new_field_id for r in got[:2]] == [f"moved-{first[k][0]}" for k in order]
    after, revisions = versions.moved_projects(results, projects)
    assert {r.project_id: (r.version, r.latest_revision_number, r.field_ids) for r in after.collect()} == {
        1: (4, 2, ["empty-11"]), 2: (2, 2, ["b", "c"]), 3: (10, 5, ["a", *[f"moved-{first[k][0]}" for k in order]]), 4: (0, 0, ["z"]), 5: (0, 0, ["y"])
    }
    assert revisions.count() == 6 and revisions.where("project_id = 3 AND direction = 'in'").count() == 2


def test_allocated_codes_fill_gaps(spark):
    from terraloom.operators import catalog

    used = spark.createDataFrame([("VO-0000000",), ("VO-0000002",), ("VO-0000005",), ("old",)], "code string")
    need = spark.createDataFrame([(i,) for i in range(6)], "id long")
    assert [r.code[-1] for r in catalog.allocated_codes(need, used, ["id"]).orderBy("id").collect()] == list("134678")
    assert catalog.allocated_codes(need, used.where("false"), ["id"]).orderBy("id").first().code == "VO-0000000"


def test_draped_length_on_a_plane(spark):
    """On a plane the surface length is the flat one times the slope's factor; lines that leave the grid have none."""
    cells = spark.createDataFrame([(1, i, j, 3.0 * i + 4.0 * j) for i in range(9) for j in range(7)], "model_id long, i int, j int, z double")
    lines = spark.createDataFrame([(1, 1, 0.3, 0.2, 7.7, 5.9), (2, 1, 1.0, 1.0, 4.0, 1.0), (3, 1, 1.0, 1.0, 9.5, 1.0), (4, 1, 2.5, 2.5, 2.5, 2.5)], "line long, model_id long, u0 double, v0 double, u1 double, v1 double")
    got = {r.line: r.length_m for r in terrain.draped_lengths(lines, cells, ["line"]).collect()}
    du, dv = 7.4, 5.7
    assert got[1] == pytest.approx(math.hypot(5 * du, 5 * dv, 3 * du + 4 * dv)) and got[2] == pytest.approx(math.hypot(15, 9)) and got[3] is None and got[4] == 0


def test_public_codes_keep_eight_digits(spark, tmp_path, monkeypatch):
    """What the query gives out as used codes are whole numbers."""
    from terraloom.plans import catalog

    spark.sql("SELECT id AS o_orderkey, 1L AS o_custkey, 'F' AS o_orderstatus, 1.0D AS o_totalprice, timestamp'2000-01-01' AS o_orderdate, '1' AS o_orderpriority FROM (VALUES (3L), (5000005L), (7L)) t(id)").write.parquet(f"{tmp_path}/orders.parquet")
    seen = []
    monkeypatch.setattr(catalog.c, "allocated_codes", lambda need, used, order: seen.append(sorted(r.code for r in used.collect())) or need.withColumn("code", need.project_id))
    catalog._codes(spark, str(tmp_path))
    assert seen == [["VO-0000014", "VO-10000010"]]


def test_retries_of_one_moment(spark):
    from terraloom.operators import archive

    ops = spark.createDataFrame([(1, 5, 10), (1, 4, 10), (1, 9, 3), (1, 6, 10), (2, 7, 1)], "operation_id long, seq long, ts long").repartition(1)
    assert {(r.operation_id, r.last_seq, r.attempts) for r in archive.retries(ops).collect()} == {(1, 4, 4), (2, 7, 1)}


def test_coordinate_texts_are_cut_once(spark):
    """The text's tokens are named many times but written once in the expression, so each row is cut once."""
    plan = spark.createDataFrame([("44, 8",)], "q string").select(geo.parse_coordinates(F.col("q")).alias("c"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert plan.first().c.lat == 44


def test_utm_functions_are_small(spark):
    """Both directions name their intermediate values once: the conformal latitude has one inverse hyperbolic tangent each way."""
    plan = spark.createDataFrame([(8.5, 44.5)], "lon double, lat double").select(geo.to_utm(F.col("lon"), F.col("lat")).alias("u")).select("u", geo.from_utm(F.col("u.x"), F.col("u.y")).alias("g"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().lower().count("atanh") == 2
    assert plan.first().g.lat == pytest.approx(44.5, abs=1e-9)


def test_addresses_are_cut_once(spark):
    from terraloom.operators import catalog as catalog_operators

    plan = spark.createDataFrame([("Via Po 1, 10100, Torino (TO), ITA",)], "q string").select(catalog_operators.address_parts(F.col("q")).alias("a"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert tuple(plan.first().a) == ("Via Po 1", "10100", "Torino", "TO")


def test_clean_rings_name_their_points_once(spark):
    """Each step of a cleaned ring is written once, so the work doesn't multiply from step to step."""
    ring = "array<struct<lon:double,lat:double>>"
    df = spark.createDataFrame([([(0.0, 0.0), (0.0, 0.0), (1.0, 0.0), (float("nan"), 1.0), (1.0, 1.0), (0.0, 0.0)],), (None,)], f"r {ring}")
    plan = df.select(geo.clean_ring(F.col("r")).alias("c"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("filter(") == 2
    assert [tuple(p) for p in plan.first().c] == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    assert plan.collect()[1].c is None and df.where("r IS NULL").select(geo.drop_vertex(F.col("r"), F.lit(1)).alias("c")).first().c is None


def test_exclusion_areas_name_their_points_once(spark):
    """Two sums for the mean and one for the area, whatever the number of mentions."""
    ring = "array<struct<lon:double,lat:double>>"
    plan = spark.createDataFrame([(RING,)], f"r {ring}").select(planting._ring_area(F.col("r")).alias("a"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 3
    assert plan.first().a == pytest.approx(100, abs=0.01)


def test_moves_are_folded_once(spark, capsys):
    """Both sides of a move come from one row, so the plan of what projects become holds one fold."""
    from terraloom.operators import versions

    projects = spark.createDataFrame([(1, 7, None, 0, 0, ["a", "b"]), (2, 7, None, 0, 0, ["c"])], "project_id int, owner_user_id int, deleted_at string, version int, latest_revision_number int, field_ids array<string>")
    moves = spark.createDataFrame([(1, 1, 1, 2, "a", 7, False)], "op_id int, seq int, source_id int, target_id int, field_id string, user_id int, admin boolean")
    after, revisions = versions.moved_projects(versions.move_results(moves, projects), projects)
    for df in (after, revisions):
        capsys.readouterr()
        df.explain()
        assert sum("MapInArrow" in line for line in capsys.readouterr().out.splitlines()) == 1
    assert {(r.project_id, r.direction, r.field_id, r.other_project_id) for r in revisions.collect()} == {(1, "out", "a", 2), (2, "in", "a", 1)}
    assert {r.project_id: (r.version, r.field_ids) for r in after.collect()} == {1: (1, ["b"]), 2: (1, ["c", "a"])}


def _crossing(a, b):
    """Brute force: sides of two closed rings cross, or one holds a vertex of the other."""
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    sides = lambda r: list(zip(r[:-1], r[1:]))
    held = lambda p, r: sum((s[1] > p[1]) != (e[1] > p[1]) and p[0] < (e[0] - s[0]) * (p[1] - s[1]) / (e[1] - s[1]) + s[0] for s, e in sides(r)) % 2 == 1
    cut = any(turn(*e, f[0]) * turn(*e, f[1]) < 0 and turn(*f, e[0]) * turn(*f, e[1]) < 0 for e in sides(a) for f in sides(b))
    return cut or any(held(p, b) for p in a) or any(held(p, a) for p in b)


def test_rings_that_touch(spark, monkeypatch):
    """Pairs over many cells, against brute force; a pair is tested once, in numpy, whatever the number of cells and sides at once."""
    import random

    from terraloom.functions import meeting
    from terraloom.operators import spatial

    rng = random.Random(3)
    ring = lambda n, w: (lambda x, y: (lambda p: [*p, p[0]])([(x + rng.uniform(0, w), y + rng.uniform(0, w)) for _ in range(n)]))(8 + rng.uniform(0, 0.03), 44 + rng.uniform(0, 0.03))
    a, b = [(k, ring(3 + k % 4, 0.009)) for k in range(40)] + [(40, None), (41, [])], [(k, ring(4, 0.006)) for k in range(40)]
    kind = "ring array<struct<lon:double,lat:double>>"
    pairs = spatial.touching(spark.createDataFrame(a, f"k int, {kind}"), spark.createDataFrame(b, f"parcel_id int, {kind}"), ["k"])
    assert "exists(" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    want = {(i, j) for i, p in a[:40] for j, q in b if _crossing(p, q)}
    assert len(want) > 50 and sorted((r.k, r.parcel_id) for r in pairs.collect()) == sorted(want)
    import pyarrow as pa

    column = lambda rings: pa.array([[{"lon": x, "lat": y} for x, y in r] for r in rings])
    monkeypatch.setattr(meeting, "AT_ONCE", 1)
    got = meeting.meets(column([p for _, p in a[:40] for _ in b]), column([q for _ in a[:40] for _, q in b]))
    assert {(i, j) for i, p in a[:40] for j, q in b if got[i * 40 + j]} == want


def test_values_of_arrow_columns():
    """What folds read is what to_pylist() gives, for slices, nulls, structs and arrays too."""
    import pyarrow as pa

    from terraloom.functions import rows

    pair = pa.struct([("ids", pa.list_(pa.string())), ("n", pa.int64()), ("gone", pa.bool_())])
    columns = [
        pa.array([1, None, 3, 4]), pa.array([1, 2, 3, 4], pa.int32()), pa.array([1.5, 2.5, None, 0.0]), pa.array(["a", None, "è", ""]), pa.array([True, None, False, True]), pa.array([None] * 4, pa.int64()),
        pa.array([["a", None], None, [], ["b"]]), pa.array([[[1], None], [], None, [[2, 3]]]), pa.array([{"ids": ["x", "y"], "n": 1, "gone": True}, None, {"ids": None, "n": None, "gone": False}, {"ids": [], "n": 4, "gone": None}], pair),
        pa.array([0, 1, None, 2], pa.timestamp("us", "UTC")),
    ]
    for c in columns:
        for part in (c, c.slice(1, 2), c.slice(3), c.slice(0, 0)):
            assert rows.values(part) == part.to_pylist()


def test_edits_are_folded_once(spark):
    """Totals and numbers of steps come from one fold of the edits; an edit that isn't applied raises nothing."""
    from terraloom.operators import versions

    fields = spark.createDataFrame([(1, 10, "a", 2.0, 25), (1, 11, "b", 3.0, 50), (2, 20, "c", 1.0, 25), (3, 30, "d", 4.0, 25)], "project_id int, client_field_id int, label string, area_m2 double, commercial_plants_25 int")
    projects = spark.createDataFrame([(1, 5, 2), (2, 0, 0), (3, 7, 1)], "project_id int, version int, latest_revision_number int")
    edits = spark.createDataFrame([(1, 1, 10, "rename", " x ", 5), (1, 2, 10, "rename", "y", 6), (1, 3, 11, "delete", None, 7), (1, 4, 11, "delete", None, 8), (2, 1, 20, "delete", None, 0), (3, 1, 30, "rename", "z", 6)], "project_id int, seq int, client_field_id int, action string, name string, expected_version int")
    left, state = versions.edit_fields(fields, edits, projects)
    assert sorted((r.client_field_id, r.label) for r in left.collect()) == [(10, "y"), (30, "d")]
    got = {r.project_id: tuple(r)[1:] for r in state.collect()}
    assert got == {1: (8, 5, 1, 2.0, 25, False), 2: (1, 1, 0, 0.0, 0, True), 3: (7, 1, 1, 4.0, 25, False)}
    assert state._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_snapshot_outlines_are_whole(spark):
    """Each outline is a closed polygon with all its corners, five points or an L's seven."""
    found = registry.QUERIES["s12_snapshot_fields"](spark, DATA).where("project_id < 50").collect()
    shapes = {(r.project_id, r.client_field_id): r.l_shape for r in view(spark, DATA, "project_fields").where("project_id < 50").withColumn("client_field_id", F.concat(F.lit("f"), F.col("client_field_id").cast("string"))).collect()}
    assert found
    for r in found:
        points = r.geometry.removeprefix("POLYGON((").removesuffix("))").split(", ")
        assert r.geometry == f"POLYGON(({', '.join(points)}))" and points[0] == points[-1] and len(points) == (7 if shapes[r.project_id, r.client_field_id] else 5)
