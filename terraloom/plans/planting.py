"""Queries of the planting geometry and the coordinate functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions import geo
from terraloom.functions.common import ceil25
from terraloom.operators import planting as p
from terraloom.sources.views import point, view, with_rings, with_views


def _fields(spark: SparkSession, sf: str) -> DataFrame:
    return with_rings(view(spark, sf, "project_fields"))


def _dealt(spark: SparkSession, sf: str, *carry: str) -> DataFrame:
    """Fields with what rings are made of dealt out first, as it comes from few files; what works in a field's row needs no other shuffle. The number is given, as adaptive execution would
    judge so few bytes by their size and merge them."""
    fields = view(spark, sf, "project_fields").select(*p.KEY, *carry, "lon0", "lat0", "dlon", "dlat", "skew", "l_shape", "has_exclusion")
    return with_rings(fields.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *p.KEY))


def _planted(spark: SparkSession, sf: str) -> DataFrame:
    return _dealt(spark, sf, "row_spacing_m", "plant_spacing_m", "post_spacing_m", "headland_width_m", "orientation_deg")


def _r(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _rows(s: SparkSession, sf: str) -> DataFrame:
    out = p.generate_rows(_fields(s, sf)).groupBy(*p.KEY).agg(F.count("*").alias("row_count"), F.round(F.sum("length_m"), 3).alias("linear_m"), F.round(F.max("length_m"), 3).alias("longest_m"))
    return out


def _utm(s: SparkSession, sf: str) -> DataFrame:
    f = view(s, sf, "project_fields").select(*p.KEY, "lon0", "lat0")
    f = f.withColumn("u", geo.to_utm(F.col("lon0"), F.col("lat0"), 32)).withColumn("g", geo.from_utm(F.col("u.x"), F.col("u.y"), 32))
    return f.select(*p.KEY, F.round("u.x", 3).alias("x"), F.round("u.y", 3).alias("y"), F.round("g.lon", 9).alias("lon"), F.round("g.lat", 9).alias("lat"))


def _mercator(s: SparkSession, sf: str) -> DataFrame:
    f = view(s, sf, "project_fields").withColumn("m", geo.mercator(F.col("lon0"), F.col("lat0"), 14)).withColumn("g", geo.from_mercator(F.col("m.x"), F.col("m.y"), 14))
    return f.select(*p.KEY, F.round("m.x", 4).alias("x"), F.round("m.y", 4).alias("y"), F.round("g.lat", 8).alias("lat"))


def _parsed(s: SparkSession, sf: str) -> DataFrame:
    f = view(s, sf, "project_fields")
    deg, sec = F.floor("lat0"), F.round((F.col("lat0") - F.floor("lat0")) * 3600, 3)
    q = F.when(F.col("display_order") % 3 == 0, F.concat(F.format_string("%.6f", "lat0"), F.lit(", "), F.format_string("%.6f", "lon0"))).when(
        F.col("display_order") % 3 == 1, F.format_string("%d° %d' %.3f\" N, 8° 30' 0\" E", deg.cast("int"), F.floor(sec / 60).cast("int"), sec - 60 * F.floor(sec / 60))
    ).otherwise(F.when(F.col("project_id") % 2 == 0, F.concat(F.lit("Via Roma "), F.col("display_order").cast("string"))).otherwise(F.lit("91, 200")))
    out = f.withColumn("c", geo.parse_coordinates(q))
    return out.select(*p.KEY, F.col("c.kind").alias("kind"), F.round("c.lat", 5).alias("lat"), F.round("c.lon", 5).alias("lon"))


def _corridors(s: SparkSession, sf: str) -> DataFrame:
    f = view(s, sf, "project_fields").select(*p.KEY, point(F.col("lon0"), F.col("lat0")).alias("a"), point(F.col("lon0") + F.col("dlon"), F.col("lat0") + F.col("dlat")).alias("b"))
    return _r(p.polygon_metrics(p.corridor(f, "a", "b", 1.5)).select(*p.KEY, "vertex_count", "area_m2"), 2, "area_m2")


def _curves(s: SparkSession, sf: str) -> DataFrame:
    f = _fields(s, sf).withColumns({"position": F.lit(0.1) + (F.col("display_order") * 0.1), "offset_m": F.col("row_spacing_m") * 3 - 5})
    return p.curve_points(f).select(*p.KEY, F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), F.round("position", 6).alias("position"), F.round("offset_m", 5).alias("offset_m"))


def _themes(s: SparkSession, sf: str) -> DataFrame:
    """Soil values that only some samples have."""
    k = F.col("client_field_id")
    pts = p.sample_points(_fields(s, sf)).select(*p.KEY, "sample")
    named = lambda t, good: F.when(good, F.concat(F.lit(t), F.col("sample").cast("string")))
    return p.soil_themes(pts.withColumns({"texture": named("t", F.col("sample") > 1), "limestone": named("l", k % 3 == 0), "drainage": named("d", (F.col("sample") + k) % 4 == 1), "reaction": named("r", k % 5 == 9)}), p.KEY)


QUERIES = {
    "g18_curve_points": _curves,
    "j21_soil_themes": _themes,
    "g1_polygon_metrics": lambda s, sf: _r(p.polygon_metrics(_fields(s, sf)), 2, "area_m2", "perimeter_m"),
    "g2_sides": lambda s, sf: _r(p.sides(_fields(s, sf)), 4, "length_m", "mid_lon", "mid_lat"),
    "g4_label_points": lambda s, sf: _r(p.label_points(_fields(s, sf)), 6, "lon", "lat"),
    "g5_corridors": _corridors,
    "g6_ring_validity": lambda s, sf: p.valid_rings(_fields(s, sf)).groupBy("valid").agg(F.count("*").alias("n")),
    "g7_generate_rows": _rows,
    "g11_quantities": lambda s, sf: _r(p.quantities(_planted(s, sf)), 2, "area_m2", "perimeter_m", "net_area_m2", "headland_area_m2", "excluded_area_m2", "row_linear_m"),
    # Plants and posts change with the last bit where a length is a whole number of spacings, so SQL is compared on the rest of the record.
    "g11_field_areas": lambda s, sf: _r(_r(p.quantities(_planted(s, sf)), 2, "area_m2", "perimeter_m", "row_linear_m"), 3, "net_area_m2", "headland_area_m2").select(*p.KEY, "area_m2", "perimeter_m", "net_area_m2", "headland_area_m2", "row_count", "row_linear_m", "head_posts"),
    "g13_best_orientation": lambda s, sf: p.best_orientation(_dealt(s, sf, "row_spacing_m")),
    "g16_sample_points": lambda s, sf: _r(p.sample_points(_fields(s, sf)), 7, "lon", "lat"),
    "f1_commercial_rounding": lambda s, sf: s.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ceil25(F.col("l_extendedprice") - 500).alias("rounded")),
    "f3_f4_utm": _utm,
    "f5_web_mercator": _mercator,
    "f6_parse_coordinates": _parsed,
    "f14_calculator": lambda s, sf: view(s, sf, "project_fields").select(*p.KEY, ceil25(F.ceil(F.col("area_m2") / (F.col("row_spacing_m") * F.col("plant_spacing_m")))).alias("plants"), F.round(F.col("simulated_plants") * F.col("row_spacing_m") * F.col("plant_spacing_m"), 4).alias("area_m2")),
}

_K = "project_id, client_field_id, display_order"
# Vertices of the fields' rings by the same rule as with_rings(), one row each, and their local metres.
_RING = """
v AS (
  SELECT f.*, i, CASE WHEN l_shape THEN [0, 1, 1, 0.5, 0.5, 0][i] ELSE [0, 1, 1 + skew, skew][i] END AS u, CASE WHEN l_shape THEN [0, 0, 0.5, 0.5, 1, 1][i] ELSE [0, 0, 1, 1][i] END AS w
  FROM project_fields f, unnest(range(1, 7)) t(i) WHERE l_shape OR i <= 4
), g AS (
  SELECT *, lon0 + u * dlon AS lon, lat0 + w * dlat AS lat FROM v
), c AS (
  SELECT *, avg(lon) OVER k AS rlon, avg(lat) OVER k AS rlat FROM g WINDOW k AS (PARTITION BY project_id, client_field_id, display_order)
), xy AS (
  SELECT *, radians(lon - rlon) * 6371008.8 * cos(radians(rlat)) AS x, radians(lat - rlat) * 6371008.8 AS y FROM c
), e AS (
  SELECT *, coalesce(lead(x) OVER k, first_value(x) OVER k) AS x2, coalesce(lead(y) OVER k, first_value(y) OVER k) AS y2, coalesce(lead(lon) OVER k, first_value(lon) OVER k) AS lon2, coalesce(lead(lat) OVER k, first_value(lat) OVER k) AS lat2
  FROM xy WINDOW k AS (PARTITION BY project_id, client_field_id, display_order ORDER BY i)
)"""
_TURNED = """
h AS (
  SELECT f.*, i, lon0 + [0.2, 0.4, 0.4, 0.2][i] * dlon AS lon, lat0 + [0.2, 0.2, 0.4, 0.4][i] * dlat AS lat FROM project_fields f, unnest(range(1, 5)) t(i) WHERE has_exclusion
), r AS (SELECT DISTINCT project_id, client_field_id, display_order, rlon, rlat FROM c),
hx AS (
  SELECT h.*, radians(h.lon - rlon) * 6371008.8 * cos(radians(rlat)) AS x, radians(h.lat - rlat) * 6371008.8 AS y FROM h JOIN r USING (project_id, client_field_id, display_order)
), tv AS (
  SELECT 0 AS hole, project_id, client_field_id, display_order, i, row_spacing_m, headland_width_m, radians(-orientation_deg) AS t, x, y FROM xy
  UNION ALL SELECT 1, project_id, client_field_id, display_order, i, row_spacing_m, headland_width_m, radians(-orientation_deg), x, y FROM hx
), tr AS (SELECT *, x * cos(t) - y * sin(t) AS rx, x * sin(t) + y * cos(t) AS ry FROM tv),
te AS (
  SELECT *, coalesce(lead(rx) OVER k, first_value(rx) OVER k) AS rx2, coalesce(lead(ry) OVER k, first_value(ry) OVER k) AS ry2 FROM tr WINDOW k AS (PARTITION BY hole, project_id, client_field_id, display_order ORDER BY i)
), b AS (
  SELECT project_id, client_field_id, display_order, min(rx) AS lo, max(rx) AS hi, any_value(row_spacing_m) AS sp, greatest(0, coalesce(any_value(headland_width_m), 0)) AS head FROM tr WHERE hole = 0 GROUP BY ALL
), ln AS (
  SELECT *, lo + sp / 2 + n * sp AS lx FROM b, unnest(range(0, 400)) q(n) WHERE lo + sp / 2 + n * sp < hi - 1e-7
), cr AS (
  SELECT hole, project_id, client_field_id, display_order, n, head, ry + (lx - rx) / (rx2 - rx) * (ry2 - ry) AS cy FROM ln JOIN te USING (project_id, client_field_id, display_order)
  WHERE rx <> rx2 AND lx >= least(rx, rx2) AND lx < greatest(rx, rx2)
), iv AS (
  SELECT hole, project_id, client_field_id, display_order, n, head, cy AS s, lead(cy) OVER k AS t, row_number() OVER k AS m FROM cr WINDOW k AS (PARTITION BY hole, project_id, client_field_id, display_order, n ORDER BY cy)
), o AS (SELECT * EXCLUDE (s, t), s + head AS s, t - head AS t FROM iv WHERE hole = 0 AND m % 2 = 1 AND t IS NOT NULL AND t - s - 2 * head > 0.05),
cut AS (SELECT project_id, client_field_id, display_order, n, s AS cs, t AS ct FROM iv WHERE hole = 1 AND m % 2 = 1 AND t IS NOT NULL),
pieces AS (
  SELECT o.project_id, o.client_field_id, o.display_order, CASE WHEN cs IS NULL OR ct <= s OR cs >= t THEN t - s WHEN cs > s THEN least(cs, t) - s END AS len FROM o LEFT JOIN cut USING (project_id, client_field_id, display_order, n)
  UNION ALL SELECT o.project_id, o.client_field_id, o.display_order, t - greatest(ct, s) FROM o JOIN cut USING (project_id, client_field_id, display_order, n) WHERE NOT (ct <= s OR cs >= t) AND ct < t
), sums AS (SELECT project_id, client_field_id, display_order, count(*) AS row_count, sum(len) AS linear, max(len) AS longest FROM pieces WHERE len > 0.05 GROUP BY ALL)"""

_SQL = {
    "g1_polygon_metrics": f"WITH {_RING} SELECT {_K}, CAST(count(*) AS INTEGER) AS vertex_count, round(abs(sum(x * y2 - x2 * y)) / 2, 2) AS area_m2, round(sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)), 2) AS perimeter_m FROM e GROUP BY ALL",
    "g2_sides": f"WITH {_RING} SELECT {_K}, CAST(i - 1 AS INTEGER) AS side, round(sqrt((x2 - x) ** 2 + (y2 - y) ** 2), 4) AS length_m, round((lon + lon2) / 2, 4) AS mid_lon, round((lat + lat2) / 2, 4) AS mid_lat FROM e",
    "g4_label_points": f"""WITH {_RING}, m AS (SELECT {_K}, any_value(rlon) AS rlon, any_value(rlat) AS rlat, sum((x + x2) * (x * y2 - x2 * y)) / (3 * sum(x * y2 - x2 * y)) AS cx, sum((y + y2) * (x * y2 - x2 * y)) / (3 * sum(x * y2 - x2 * y)) AS cy FROM e GROUP BY ALL)
      SELECT {_K}, round(rlon + degrees(cx / 6371008.8 / cos(radians(rlat))), 6) AS lon, round(rlat + degrees(cy / 6371008.8), 6) AS lat FROM m""",
    "f3_f4_utm": f"""WITH t AS (SELECT *, radians(lon0 - 9) AS lam, tan(radians(lat0)) AS tau FROM project_fields), s AS (SELECT *, sinh({geo._E!r} * atanh({geo._E!r} * tau / sqrt(1 + tau * tau))) AS sg FROM t), c AS (SELECT *, tau * sqrt(1 + sg * sg) - sg * sqrt(1 + tau * tau) AS tc FROM s),
      k AS (SELECT *, atan2(tc, cos(lam)) AS xi, asinh(sin(lam) / sqrt(tc * tc + cos(lam) ** 2)) AS eta FROM c)
      SELECT {_K}, round(500000 + {0.9996 * geo._RADIUS!r} * (eta + {" + ".join(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(geo._ALPHA, 1))}), 3) AS x,
        round({0.9996 * geo._RADIUS!r} * (xi + {" + ".join(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(geo._ALPHA, 1))}), 3) AS y, round(lon0, 9) AS lon, round(lat0, 9) AS lat FROM k""",
    "g11_field_areas": f"""WITH {_RING}, {_TURNED}, o0 AS (SELECT * FROM iv WHERE hole = 0 AND m % 2 = 1 AND t IS NOT NULL AND t - s > 0.05),
      p0 AS (SELECT o0.project_id, o0.client_field_id, o0.display_order, CASE WHEN cs IS NULL OR ct <= s OR cs >= t THEN t - s WHEN cs > s THEN least(cs, t) - s END AS len FROM o0 LEFT JOIN cut USING (project_id, client_field_id, display_order, n)
        UNION ALL SELECT o0.project_id, o0.client_field_id, o0.display_order, t - greatest(ct, s) FROM o0 JOIN cut USING (project_id, client_field_id, display_order, n) WHERE NOT (ct <= s OR cs >= t) AND ct < t),
      raw AS (SELECT {_K}, sum(len) AS raw FROM p0 WHERE len > 0.05 GROUP BY ALL),
      pl AS (SELECT {_K}, count(*) AS row_count, sum(len) AS linear, sum(floor(len / plant_spacing_m) + 1) AS plants, sum(greatest(0, ceil(len / post_spacing_m) - 1)) AS posts FROM pieces JOIN project_fields USING ({_K}) WHERE len > 0.05 GROUP BY ALL),
      ar AS (SELECT {_K}, abs(sum(x * y2 - x2 * y)) / 2 AS area, sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)) AS perimeter FROM e GROUP BY ALL),
      u AS (SELECT f.*, area, perimeter, coalesce(pl.row_count, 0) AS rc, coalesce(linear, 0) AS linear, coalesce(raw, 0) AS raw, coalesce(plants, 0) AS plants, coalesce(posts, 0) AS posts,
          greatest(0, area - CASE WHEN has_exclusion THEN radians(0.2 * dlon) * cos(radians(lat0 + 0.3 * dlat)) * radians(0.2 * dlat) * 6371008.8 ** 2 ELSE 0 END) AS usable
        FROM project_fields f JOIN ar USING ({_K}) LEFT JOIN pl USING ({_K}) LEFT JOIN raw USING ({_K})),
      n AS (SELECT *, least(usable, greatest(0, raw - linear) * row_spacing_m) AS headland FROM u), q AS (SELECT *, greatest(0, usable - headland) AS net FROM n), z AS (SELECT *, ceil(net / (row_spacing_m * plant_spacing_m)) AS theory FROM q)
      SELECT {_K}, round(area, 2) AS area_m2, round(perimeter, 2) AS perimeter_m, round(net, 3) AS net_area_m2, round(headland, 3) AS headland_area_m2, rc AS row_count, round(linear, 2) AS row_linear_m, rc * 2 AS head_posts FROM z""",
    "g5_corridors": f"SELECT {_K}, 4 AS vertex_count, round(1.5 * sqrt((radians(dlon) * 6371008.8 * cos(radians(lat0 + dlat / 2))) ** 2 + (radians(dlat) * 6371008.8) ** 2), 2) AS area_m2 FROM project_fields",
    "g6_ring_validity": "SELECT true AS valid, count(*) AS n FROM project_fields",
    "g7_generate_rows": f"WITH {_RING}, {_TURNED} SELECT {_K}, row_count, round(linear, 3) AS linear_m, round(longest, 3) AS longest_m FROM sums",
    "g16_sample_points": f"""WITH {_RING}, bx AS (SELECT {_K}, min(lon) AS a, max(lon) AS b, min(lat) AS c, max(lat) AS d FROM g GROUP BY ALL),
      s AS (SELECT *, a + (b - a) * [0.5, 0.25, 0.5, 0.75, 0.25, 0.75, 0.25, 0.5, 0.75][k + 1] AS px, c + (d - c) * [0.5, 0.25, 0.25, 0.25, 0.5, 0.5, 0.75, 0.75, 0.75][k + 1] AS py FROM bx, unnest(range(0, 9)) t(k))
      SELECT {', '.join('s.' + x for x in _K.split(', '))}, CAST(k AS INTEGER) AS sample, round(px, 7) AS lon, round(py, 7) AS lat FROM s JOIN e USING ({_K})
      WHERE (e.lat > py) <> (e.lat2 > py) AND px < (e.lon - e.lon2) * (py - e.lat2) / (e.lat - e.lat2) + e.lon2 GROUP BY ALL HAVING count(*) % 2 = 1""",
    "g18_curve_points": f"""WITH {_RING}, {_TURNED}, fr AS (SELECT {_K}, any_value(t) AS t, (min(rx) + max(rx)) / 2 AS mid, min(ry) AS low, max(ry) - min(ry) AS span FROM tr WHERE hole = 0 GROUP BY ALL),
      q AS (SELECT f.*, fr.t, rlon, rlat, mid + row_spacing_m * 3 - 5 AS lx, low + (0.1e0 + display_order * 0.1e0) * span AS ly FROM project_fields f JOIN fr USING ({_K}) JOIN r USING ({_K}))
      SELECT {_K}, round(rlon + degrees((lx * cos(t) + ly * sin(t)) / 6371008.8 / cos(radians(rlat))), 7) AS lon, round(rlat + degrees((-lx * sin(t) + ly * cos(t)) / 6371008.8), 7) AS lat, round(0.1e0 + display_order * 0.1e0, 6) AS position, round(row_spacing_m * 3 - 5, 5) AS offset_m FROM q""",
    "j21_soil_themes": f"""WITH {_RING}, bx AS (SELECT {_K}, min(lon) AS a, max(lon) AS b, min(lat) AS c, max(lat) AS d FROM g GROUP BY ALL),
      s AS (SELECT *, a + (b - a) * [0.5, 0.25, 0.5, 0.75, 0.25, 0.75, 0.25, 0.5, 0.75][k + 1] AS px, c + (d - c) * [0.5, 0.25, 0.25, 0.25, 0.5, 0.5, 0.75, 0.75, 0.75][k + 1] AS py FROM bx, unnest(range(0, 9)) t(k)),
      pts AS (SELECT {', '.join('s.' + x for x in _K.split(', '))}, CAST(k AS INTEGER) AS sample FROM s JOIN e USING ({_K})
      WHERE (e.lat > py) <> (e.lat2 > py) AND px < (e.lon - e.lon2) * (py - e.lat2) / (e.lat - e.lat2) + e.lon2 GROUP BY {', '.join('s.' + x for x in _K.split(', '))}, k, px, py HAVING count(*) % 2 = 1),
      o AS (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY sample) AS n FROM pts), val AS (SELECT *, CASE WHEN sample > 1 THEN 't' || sample END AS tx, CASE WHEN client_field_id % 3 = 0 THEN 'l' || sample END AS li, CASE WHEN (sample + client_field_id) % 4 = 1 THEN 'd' || sample END AS dr FROM o WHERE n <= 4)
      SELECT {_K}, arg_min(tx, n) FILTER (tx IS NOT NULL) AS texture, arg_min(li, n) FILTER (li IS NOT NULL) AS limestone, arg_min(dr, n) FILTER (dr IS NOT NULL) AS drainage, CAST(NULL AS VARCHAR) AS reaction, count(*) AS samples FROM val GROUP BY {_K} HAVING count(tx) + count(li) + count(dr) > 0""",
    "f1_commercial_rounding": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE WHEN l_extendedprice - 500 > 0 THEN ceil((l_extendedprice - 500) / 25) * 25 ELSE 0 END AS BIGINT) AS rounded FROM lineitem",
    "f5_web_mercator": f"SELECT {_K}, round((lon0 + 180) / 360 * 4194304, 4) AS x, round((1 - asinh(tan(radians(lat0))) / pi()) / 2 * 4194304, 4) AS y, round(lat0, 8) AS lat FROM project_fields",
    "f6_parse_coordinates": f"SELECT {_K}, CASE WHEN display_order % 3 < 2 THEN 'coordinate' WHEN project_id % 2 = 0 THEN 'address' ELSE 'invalid' END AS kind, CASE WHEN display_order % 3 < 2 THEN round(lat0, 5) END AS lat, CASE display_order % 3 WHEN 0 THEN round(lon0, 5) WHEN 1 THEN 8.5 END AS lon FROM project_fields",
    "f14_calculator": f"SELECT {_K}, CAST(ceil(ceil(area_m2 / (row_spacing_m * plant_spacing_m)) / 25) * 25 AS BIGINT) AS plants, round(simulated_plants * row_spacing_m * plant_spacing_m, 4) AS area_m2 FROM project_fields",
}
ORACLES = {k: with_views(v) for k, v in _SQL.items()}
