"""Queries of the archive, the operation logs and the terrain, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions.common import text
from terraloom.operators import archive as a
from terraloom.operators import folds, terrain
from terraloom.sources.views import view, with_views

KEY = ["project_id", "client_field_id"]
NOW = "2001-01-01"


def _now():
    return F.lit(NOW).cast("timestamp")


def _attempts(s: SparkSession, sf: str) -> DataFrame:
    return s.read.parquet(f"{sf}/events.parquet").select("user_id", "ts")


def _snapshots(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    subs, live = view(s, sf, "submissions"), view(s, sf, "counts_entries")
    sent = subs.select("submission_id", "list_id").join(live, "list_id")
    altered = (F.col("submission_id") % 12 == 1) & (F.col("entry_no") == 1)
    return subs, sent.withColumn("quantity", F.when(altered, F.col("quantity") + 1).otherwise(F.col("quantity"))).select("submission_id", "list_id", "client_field_id", "entry_no", "quantity")


def _codes(s: SparkSession, sf: str) -> DataFrame:
    """Some codes are aliases of other projects, live or not; some texts are no codes."""
    p = view(s, sf, "projects")
    aliases = p.where("project_id % 50 = 7").select(F.concat(F.lit("VO-9"), F.lpad(F.col("project_id").cast("string"), 6, "0")).alias("code"), "project_id")
    taken = p.where("project_id % 90 = 4 AND project_id > 0").select(F.col("public_code").alias("code"), (F.col("project_id") - 1).alias("project_id"))
    wrong = p.where("project_id % 40 = 1").select(F.concat(F.lit("vo "), "public_code").alias("code"))
    asked = aliases.select("code").unionByName(p.where("project_id % 9 = 4").select(F.col("public_code").alias("code"))).unionByName(wrong)
    return a.resolve_codes(asked, aliases.unionByName(taken), p)


def _changed(s: SparkSession, sf: str) -> DataFrame:
    k = F.col("project_id") + F.col("revision_number")
    more = {"outline": k % 5, "exclusions": F.when(k % 3 == 0, F.array(F.lit(1))), "surface": k % 7 > 2, "notes": F.when(k % 4 > 1, F.concat(F.lit("n"), (k % 4).cast("string")))}
    groups = {"identity": ["label"], "geometry": ["outline"], "exclusions": ["exclusions"], "layout": ["row_spacing_m"], "terrain": ["surface"], "material": ["rootstock"], "notes": ["notes"]}
    return a.revision_changes(view(s, sf, "revisions").withColumns(more), groups)


def _compared(s: SparkSession, sf: str) -> DataFrame:
    f = view(s, sf, "project_fields").select(*KEY, "row_spacing_m", "rootstock")
    other = f.where("client_field_id % 7 <> 3").withColumn("rootstock", F.when(F.col("client_field_id") % 5 == 0, "R9").otherwise(F.col("rootstock")))
    return a.compare_revisions(f.where("client_field_id % 11 <> 5"), other, KEY, ["row_spacing_m", "rootstock"]).groupBy("verdict").agg(F.count("*").alias("n"))


def _upserted(s: SparkSession, sf: str) -> DataFrame:
    f = view(s, sf, "project_fields").select(*KEY, "row_spacing_m", "label")
    snap = f.where("client_field_id % 3 <> 1").withColumn("label", F.when(F.col("client_field_id") % 2 == 0, F.lit(None)).otherwise(F.concat("label", F.lit("*"))))
    return a.upsert_fields(f.where("client_field_id % 4 <> 2"), snap, KEY, ["row_spacing_m", "label"])


def _references(s: SparkSession, sf: str) -> DataFrame:
    f = view(s, sf, "project_fields")
    tx, ty = F.floor(F.col("lon0") / 0.002).cast("long"), F.floor(F.col("lat0") / 0.002).cast("long")
    ref = F.concat(F.lit("a"), F.lpad((tx % 1000).cast("string"), 3, "0"), F.lit("_"), F.lpad((ty % 10000).cast("string"), 4, "0"), F.lit("00."), tx.cast("string"))
    return f.select(*KEY, a.parse_reference(ref).alias("r")).select(*KEY, "r.*")


def _deduped(s: SparkSession, sf: str) -> DataFrame:
    f = view(s, sf, "project_fields").select("project_id", "client_field_id", F.upper("grape_variety").alias("municipality"), F.lit(None).cast("string").alias("section"), F.lower("rootstock").alias("sheet"), F.lit("1 ").alias("parcel"))
    return a.unique_references(f, "project_id", "client_field_id").select("project_id", "client_field_id")


def _grants(s: SparkSession, sf: str) -> DataFrame:
    p = view(s, sf, "projects")
    grants = p.where("owner_kind = 'guest'").select(F.col("owner_user_id").alias("from_owner"), (F.col("owner_user_id") + 1).alias("to_owner")).distinct()
    return a.transfer(p.select("project_id", "owner_user_id"), grants)


def _cells(s: SparkSession, sf: str) -> DataFrame:
    heights = F.transform("embedding", lambda v, i: 200.0 + 10.0 * v.cast("double") + 0.5 * i)
    return terrain.cells(view(s, sf, "raster").select("model_id", "j", heights.alias("heights")))


def _sampled(s: SparkSession, sf: str) -> DataFrame:
    c = _cells(s, sf)
    points = view(s, sf, "raster").select("model_id", F.col("j").alias("point"), (F.col("j") * 0.61).alias("u"), (F.col("j") * 1.013 - 0.4).alias("v"))
    return terrain.heights_at(points, c).select("model_id", "point", F.round("z", 5).alias("z"))


def _draped(s: SparkSession, sf: str) -> DataFrame:
    """Lines across each model, one per raster row; the first ones leave it."""
    lines = view(s, sf, "raster").select("model_id", F.col("j").alias("line"), F.lit(0.25).alias("u0"), (F.col("j") * 0.9 - 0.5).alias("v0"), F.lit(40.75).alias("u1"), (F.col("j") * 0.8 + 3.0).alias("v1"))
    return terrain.draped_lengths(lines, _cells(s, sf), ["model_id", "line"])


def _draped_plants(s: SparkSession, sf: str) -> DataFrame:
    rows = view(s, sf, "raster").select("model_id", F.col("j").alias("line"), (F.col("j") % 10).alias("field"), F.lit(0.9).alias("plant_spacing_m"), F.lit(4.5).alias("post_spacing_m"))
    out = terrain.draped_plants(rows, _draped(s, sf), ["model_id", "line"], ["model_id", "field"])
    return _r(out, 4, "surface_row_m")


def _models(s: SparkSession, sf: str) -> DataFrame:
    k = F.col("project_id")
    m = view(s, sf, "projects").select("project_id", F.when(k % 11 == 0, 2).otherwise(1).alias("version"), F.when(k % 7 == 0, "EPSG:4326").otherwise(F.concat(F.lit("EPSG:3263"), (k % 3 + 2).cast("string"))).alias("crs"), F.lit(5e5).alias("origin_x"), F.when(k % 5 == 0, float("nan")).otherwise(5e6).alias("origin_y"), F.lit(5.0).alias("step_x"), F.when(k % 13 == 0, 5.0).otherwise(-5.0).alias("step_y"), F.when(k % 17 == 0, " ").otherwise("dtm").alias("source"), F.lit(5.0).alias("resolution_m"), (k % 4 != 0).alias("complete"))
    return terrain.model_errors(m, "project_id")


def _windows(s: SparkSession, sf: str) -> DataFrame:
    f = view(s, sf, "project_fields").select(*KEY, (F.col("lon0") * 1e5).alias("x0"), (F.col("lat0") * 1e5).alias("y0"), (F.col("lon0") * 1e5 + F.col("area_m2")).alias("x1"), (F.col("lat0") * 1e5 + 90.0).alias("y1"))
    return terrain.support_windows(f, KEY, (2.5, -1.25), 5.0)


def _blended(s: SparkSession, sf: str) -> DataFrame:
    f = view(s, sf, "project_fields").select(*KEY, F.when(F.col("display_order") != 5, F.col("area_m2") / 10).alias("native"), F.col("lat0").alias("context"), (F.col("simulated_plants") / 20.0 - 10).alias("distance"), F.lit(25.0).alias("collar"))
    return _r(terrain.blended(f, "native", "context", "distance", "collar").select(*KEY, "height"), 6, "height")


def _r(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


QUERIES = {
    "v1_apply_operations": lambda s, sf: folds.apply_operations(view(s, sf, "sync_ops")).select("operation_id", "project_id", "status", "server_version"),
    "v1_answers": lambda s, sf: folds.answers(view(s, sf, "sync_ops")).select("seq", "operation_id", "project_id", "status", "server_version", "repeated"),
    "w7_fixed_window_limit": lambda s, sf: folds.fixed_window(_attempts(s, sf), "user_id", "ts", 20 * 86_400, 5),
    "w8_sliding_window_limit": lambda s, sf: folds.sliding_window(_attempts(s, sf), "user_id", "ts", 20 * 86_400, 5),
    "st1_counters": lambda s, sf: folds.counters(view(s, sf, "count_commands")).select("count_id", "op_id", "quantity"),
    "st6_sessions": lambda s, sf: folds.sessions(_attempts(s, sf), "user_id", "30 minutes"),
    "st7_retries": lambda s, sf: a.retries(view(s, sf, "sync_ops")),
    "j11_production_lots": lambda s, sf: a.resolve_lots(view(s, sf, "project_fields"), view(s, sf, "production_lots"), KEY),
    "a6_counts_by_category": lambda s, sf: a.by_category(view(s, sf, "counts_entries"), "list_id"),
    "j3_owned_fields": lambda s, sf: a.owned_fields(view(s, sf, "project_fields"), view(s, sf, "projects"), 49).select(*KEY),
    "j5_public_codes": _codes,
    "j7_submitted_lists": lambda s, sf: a.lists_with_flag(view(s, sf, "counts_lists"), view(s, sf, "submissions")),
    "j16_snapshot_check": lambda s, sf: a.check_snapshots(*_snapshots(s, sf), view(s, sf, "counts_entries")),
    "v11_revision_changes": _changed,
    "j18_revision_compare": _compared,
    "v2_field_upsert": _upserted,
    "v4_restore": lambda s, sf: a.restore(view(s, sf, "projects"), _now(), 400),
    "v5_archive_idle": lambda s, sf: a.archive_idle(view(s, sf, "projects"), _now(), 90).where(F.col("deleted_at") == _now()).select("project_id", "owner_user_id"),
    "v10_ownership_transfer": _grants,
    "f7_national_reference": _references,
    "d1_unique_references": _deduped,
    "d2_archive_merge": lambda s, sf: a.merge_archives(view(s, sf, "projects").where("origin = 'imported'").select("project_id", "name"), view(s, sf, "projects").select("project_id", F.upper("name").alias("name")), "project_id"),
    "p14_headland": lambda s, sf: view(s, sf, "project_fields").select(*KEY, a.headland(F.col("headland_width_m") - F.when(F.col("project_id") % 5 == 1, 4).otherwise(0), F.col("l_shape")).alias("headland_m")),
    "p15_advice": lambda s, sf: a.advice(view(s, sf, "project_fields").withColumn("plant_spacing_m", F.when(F.col("project_id") % 10 != 3, F.col("plant_spacing_m"))), KEY, "l_shape"),
    "p16_orientation": lambda s, sf: view(s, sf, "project_fields").select(*KEY, a.orientation(F.regexp_replace((F.col("orientation_deg") * 1.37 - 20).cast("string"), r"\.", ",")).alias("orientation")),
    "p19_count_violations": lambda s, sf: a.count_violations(view(s, sf, "counts_entries").withColumn("quantity", F.col("quantity") - 5), ["list_id", "client_field_id"]),
    "p20_profile_errors": lambda s, sf: a.profile_errors(view(s, sf, "profiles")),
    "v17_quote_text": lambda s, sf: a.quote_lines(view(s, sf, "project_fields"), view(s, sf, "production_lots"), KEY),
    "a18_catalogue": lambda s, sf: view(s, sf, "production_lots").select("grape_variety", "clone_selection").distinct().orderBy(text(F.col("grape_variety"))),
    "r4_terrain_faces": lambda s, sf: _r(terrain.faces(_cells(s, sf)), 3, "slope_percent", "mean_z"),
    "a13_terrain_summary": lambda s, sf: _r(terrain.summary(_cells(s, sf)), 3, "min_z", "max_z", "range_z", "max_slope_percent"),
    "r3_heights_at_points": _sampled,
    "r6_surface_area": lambda s, sf: _r(terrain.surface_area(_cells(s, sf)), 2, "surface_m2"),
    "r1_model_errors": _models,
    "r2_support_windows": _windows,
    "r5_draped_lengths": lambda s, sf: _r(_draped(s, sf), 4, "length_m"),
    "r9_blended_heights": _blended,
    "r11_draped_plants": _draped_plants,
    "r10_height_colours": lambda s, sf: terrain.encode_heights(_cells(s, sf)),
}

_CELLS = "cells AS (SELECT model_id, CAST(n - 1 AS INTEGER) AS i, j, 200.0e0 + 10.0e0 * CAST(embedding[n] AS DOUBLE) + 0.5e0 * (n - 1) AS z FROM raster, unnest(range(1, len(embedding) + 1)) t(n))"
_FACES = f"""{_CELLS}, q AS (
  SELECT a.model_id, a.i, a.j, a.z AS z00, b.z AS z10, c.z AS z01, d.z AS z11 FROM cells a JOIN cells b ON b.model_id = a.model_id AND b.i = a.i + 1 AND b.j = a.j
  JOIN cells c ON c.model_id = a.model_id AND c.i = a.i AND c.j = a.j + 1 JOIN cells d ON d.model_id = a.model_id AND d.i = a.i + 1 AND d.j = a.j + 1
), fc AS (
  SELECT model_id, i, j, 0 AS k, 100 * sqrt(((z10 - z00) / 5) ** 2 + ((z01 - z00) / 5) ** 2) AS slope, (z00 + z10 + z01) / 3 AS mean FROM q
  UNION ALL SELECT model_id, i, j, 1, 100 * sqrt(((z11 - z01) / 5) ** 2 + ((z11 - z10) / 5) ** 2), (z11 + z10 + z01) / 3 FROM q
)"""
_DRAPED = """ln AS (SELECT model_id, j AS line, 0.25e0 AS u0, j * 0.9e0 - 0.5e0 AS v0, 40.75e0 AS u1, j * 0.8e0 + 3.0e0 AS v1 FROM raster), ks AS (SELECT unnest(range(-3, 200)) AS k),
      ts AS (SELECT DISTINCT * FROM (SELECT ln.*, 0.0e0 AS t FROM ln UNION ALL SELECT ln.*, 1.0e0 FROM ln
        UNION ALL SELECT ln.*, (k - u0) / (u1 - u0) FROM ln, ks WHERE k > least(u0, u1) AND k < greatest(u0, u1) UNION ALL SELECT ln.*, (k - v0) / (v1 - v0) FROM ln, ks WHERE v1 <> v0 AND k > least(v0, v1) AND k < greatest(v0, v1)
        UNION ALL SELECT ln.*, (k - u0 - v0) / (u1 + v1 - u0 - v0) FROM ln, ks WHERE k > least(u0 + v0, u1 + v1) AND k < greatest(u0 + v0, u1 + v1)) x),
      pt AS (SELECT *, u0 + t * (u1 - u0) AS u, v0 + t * (v1 - v0) AS v FROM ts), sz AS (SELECT model_id, max(i) AS wi, max(j) AS hj FROM cells GROUP BY model_id),
      held AS (SELECT pt.*, u BETWEEN -2e-7 AND wi + 2e-7 AND v BETWEEN -2e-7 AND hj + 2e-7 AS good, CAST(least(floor(greatest(u, 0)), wi - 1) AS INTEGER) AS i, CAST(least(floor(greatest(v, 0)), hj - 1) AS INTEGER) AS j FROM pt JOIN sz USING (model_id)),
      hz AS (SELECT held.*, u - held.i AS a, v - held.j AS b, c0.z AS z00, c1.z AS z10, c2.z AS z01, c3.z AS z11 FROM held LEFT JOIN cells c0 ON good AND c0.model_id = held.model_id AND c0.i = held.i AND c0.j = held.j LEFT JOIN cells c1 ON good AND c1.model_id = held.model_id AND c1.i = held.i + 1 AND c1.j = held.j
        LEFT JOIN cells c2 ON good AND c2.model_id = held.model_id AND c2.i = held.i AND c2.j = held.j + 1 LEFT JOIN cells c3 ON good AND c3.model_id = held.model_id AND c3.i = held.i + 1 AND c3.j = held.j + 1),
      zz AS (SELECT *, CASE WHEN a + b <= 1 THEN z00 + a * (z10 - z00) + b * (z01 - z00) ELSE z11 + (1 - b) * (z10 - z11) + (1 - a) * (z01 - z11) END AS z FROM hz),
      dd AS (SELECT model_id, line, z, sqrt((5 * (u - lag(u) OVER w)) ** 2 + (5 * (v - lag(v) OVER w)) ** 2 + (z - lag(z) OVER w) ** 2) AS d FROM zz WINDOW w AS (PARTITION BY model_id, line ORDER BY t)),
      draped AS (SELECT model_id, line, CASE WHEN count(z) = count(*) THEN sum(d) END AS length_m FROM dd GROUP BY model_id, line)"""
_FOLD = "tries AS (SELECT user_id, epoch_us(ts) AS at_us, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events)"

_SQL = {
    "v1_apply_operations": """WITH RECURSIVE once AS (SELECT * FROM sync_ops QUALIFY row_number() OVER (PARTITION BY operation_id ORDER BY seq) = 1),
      o AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts, seq) AS n FROM once),
      f AS (SELECT operation_id, project_id, n, expected_version = 0 AS good, CASE WHEN expected_version = 0 THEN 1 ELSE 0 END AS v FROM o WHERE n = 1
        UNION ALL SELECT o.operation_id, o.project_id, o.n, o.expected_version = f.v, f.v + CASE WHEN o.expected_version = f.v THEN 1 ELSE 0 END FROM f JOIN o ON o.project_id = f.project_id AND o.n = f.n + 1)
      SELECT operation_id, project_id, CASE WHEN good THEN 'applied' ELSE 'conflict' END AS status, CAST(v AS BIGINT) AS server_version FROM f""",
    "v1_answers": """WITH RECURSIVE once AS (SELECT * FROM sync_ops QUALIFY row_number() OVER (PARTITION BY operation_id ORDER BY seq) = 1),
      o AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts, seq) AS n FROM once),
      f AS (SELECT operation_id, project_id, n, expected_version = 0 AS good, CASE WHEN expected_version = 0 THEN 1 ELSE 0 END AS v FROM o WHERE n = 1
        UNION ALL SELECT o.operation_id, o.project_id, o.n, o.expected_version = f.v, f.v + CASE WHEN o.expected_version = f.v THEN 1 ELSE 0 END FROM f JOIN o ON o.project_id = f.project_id AND o.n = f.n + 1)
      SELECT s.seq, s.operation_id, f.project_id, CASE WHEN good THEN 'applied' ELSE 'conflict' END AS status, CAST(v AS BIGINT) AS server_version, s.seq <> first.seq AS repeated
      FROM sync_ops s JOIN f ON f.operation_id = s.operation_id JOIN once first ON first.operation_id = s.operation_id""",
    "w7_fixed_window_limit": f"""WITH RECURSIVE {_FOLD}, f AS (SELECT user_id, at_us, n, at_us AS begun, 1 AS attempts FROM tries WHERE n = 1
        UNION ALL SELECT a.user_id, a.at_us, a.n, CASE WHEN f.begun < a.at_us - 1728000000000 THEN a.at_us ELSE f.begun END, CASE WHEN f.begun < a.at_us - 1728000000000 THEN 1 ELSE f.attempts + 1 END FROM f JOIN tries a ON a.user_id = f.user_id AND a.n = f.n + 1)
      SELECT user_id, at_us, attempts, attempts <= 5 AS allowed FROM f""",
    "w8_sliding_window_limit": f"""WITH RECURSIVE {_FOLD}, f AS (SELECT user_id, at_us, n, true AS allowed, [at_us] AS rec FROM tries WHERE n = 1
        UNION ALL SELECT a.user_id, a.at_us, a.n, len(list_filter(f.rec, lambda x: x >= a.at_us - 1728000000000)) < 5,
          CASE WHEN len(list_filter(f.rec, lambda x: x >= a.at_us - 1728000000000)) < 5 THEN list_append(list_filter(f.rec, lambda x: x >= a.at_us - 1728000000000), a.at_us) ELSE list_filter(f.rec, lambda x: x >= a.at_us - 1728000000000) END
        FROM f JOIN tries a ON a.user_id = f.user_id AND a.n = f.n + 1)
      SELECT user_id, at_us, allowed FROM f""",
    "st1_counters": """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY count_id ORDER BY ts, op_id) AS n FROM count_commands),
      f AS (SELECT count_id, op_id, n, CASE action WHEN 'set' THEN set_value WHEN 'increment' THEN 1 ELSE 0 END AS quantity FROM o WHERE n = 1
        UNION ALL SELECT o.count_id, o.op_id, o.n, CASE action WHEN 'set' THEN set_value WHEN 'increment' THEN f.quantity + 1 ELSE greatest(f.quantity - 1, 0) END FROM f JOIN o ON o.count_id = f.count_id AND o.n = f.n + 1)
      SELECT count_id, op_id, quantity FROM f""",
    "st6_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS started_at, max(ts) AS last_seen_at, count(*) AS n_events FROM s GROUP BY user_id, k""",
    "st7_retries": "SELECT operation_id, count(*) AS attempts, max(ts) AS last_attempt_at, arg_max(seq, ts) AS last_seq FROM sync_ops GROUP BY operation_id",
    "j11_production_lots": """WITH c AS (SELECT grape_variety, clone_selection, rootstock, list_distinct(list(lot)) AS lots FROM production_lots GROUP BY ALL)
      SELECT project_id, client_field_id, CASE WHEN len(lots) = 1 THEN 'unique' WHEN len(lots) > 1 THEN 'ambiguous' ELSE 'unknown' END AS status, CASE WHEN len(lots) = 1 THEN lots[1] END AS lot, CAST(coalesce(len(lots), 0) AS INTEGER) AS n_candidates
      FROM project_fields f LEFT JOIN c USING (grape_variety, clone_selection, rootstock)""",
    "a6_counts_by_category": """SELECT list_id, category, count(quantity) AS items, CAST(coalesce(sum(quantity), 0) AS VARCHAR) AS total
      FROM (SELECT DISTINCT list_id, unnest(['plants', 'posts', 'other']) AS category FROM counts_entries) k LEFT JOIN counts_entries e USING (list_id, category) GROUP BY ALL""",
    "j3_owned_fields": "SELECT f.project_id, f.client_field_id FROM project_fields f WHERE EXISTS (SELECT 1 FROM projects p WHERE p.project_id = f.project_id AND p.owner_user_id = 49 AND p.deleted_at IS NULL)",
    "j5_public_codes": """WITH al AS (SELECT concat('VO-9', lpad(CAST(project_id AS VARCHAR), 6, '0')) AS code, project_id FROM projects WHERE project_id % 50 = 7
        UNION ALL SELECT public_code, project_id - 1 FROM projects WHERE project_id % 90 = 4 AND project_id > 0),
      q AS (SELECT code FROM al WHERE code LIKE 'VO-9%' UNION ALL SELECT public_code FROM projects WHERE project_id % 9 = 4 UNION ALL SELECT 'vo ' || public_code FROM projects WHERE project_id % 40 = 1)
      SELECT q.code, o.project_id FROM q LEFT JOIN al ON al.code = q.code LEFT JOIN projects p ON p.public_code = q.code
      LEFT JOIN projects o ON o.project_id = CASE WHEN al.code IS NOT NULL THEN al.project_id ELSE p.project_id END AND o.deleted_at IS NULL AND o.status <> 'draft'""",
    "j7_submitted_lists": "SELECT list_id, status, list_id IN (SELECT list_id FROM submissions) AS submitted FROM counts_lists WHERE deleted_at IS NULL",
    "j16_snapshot_check": """WITH n AS (SELECT list_id, count(*) AS n, count(*) FILTER (entry_no = 1) AS first FROM counts_entries GROUP BY list_id)
      SELECT submission_id, CASE WHEN n IS NULL THEN 'empty' WHEN submission_id % 12 = 1 AND first > 0 THEN 'changed' ELSE 'accepted' END AS verdict, coalesce(n, 0) AS n_entries FROM submissions LEFT JOIN n USING (list_id)""",
    "v11_revision_changes": """WITH r AS (SELECT *, (project_id + revision_number) AS k FROM revisions)
      SELECT b.project_id, b.revision_number, list_filter([CASE WHEN a.label <> b.label THEN 'identity' END, CASE WHEN a.k % 5 <> b.k % 5 THEN 'geometry' END, CASE WHEN (a.k % 3 = 0) <> (b.k % 3 = 0) THEN 'exclusions' END,
        CASE WHEN a.row_spacing_m <> b.row_spacing_m THEN 'layout' END, CASE WHEN (a.k % 7 > 2) <> (b.k % 7 > 2) THEN 'terrain' END, CASE WHEN a.rootstock <> b.rootstock THEN 'material' END,
        CASE WHEN greatest(a.k % 4, 1) <> greatest(b.k % 4, 1) THEN 'notes' END], lambda x: x IS NOT NULL) AS changed
      FROM r a JOIN r b ON a.project_id = b.project_id AND b.revision_number = a.revision_number + 1""",
    "j18_revision_compare": """SELECT CASE WHEN client_field_id % 11 = 5 THEN 'added' WHEN client_field_id % 7 = 3 THEN 'removed' WHEN client_field_id % 5 = 0 THEN 'changed' ELSE 'same' END AS verdict, count(*) AS n
      FROM project_fields WHERE NOT (client_field_id % 11 = 5 AND client_field_id % 7 = 3) GROUP BY 1""",
    "v2_field_upsert": """SELECT project_id, client_field_id, row_spacing_m, CASE WHEN client_field_id % 3 <> 1 AND client_field_id % 2 <> 0 THEN label || '*' WHEN client_field_id % 4 <> 2 THEN label END AS label, client_field_id % 3 = 1 AS deleted, client_field_id % 4 = 2 AS inserted
      FROM project_fields WHERE NOT (client_field_id % 3 = 1 AND client_field_id % 4 = 2)""",
    "v4_restore": f"SELECT project_id, CASE WHEN deleted_at >= TIMESTAMP '{NOW}' - INTERVAL 400 DAY THEN 'restored' ELSE 'refused' END AS outcome, CASE WHEN deleted_at < TIMESTAMP '{NOW}' - INTERVAL 400 DAY THEN deleted_at END AS deleted_at FROM projects WHERE deleted_at IS NOT NULL",
    "v5_archive_idle": f"SELECT project_id, owner_user_id FROM projects WHERE (owner_kind = 'guest' AND status = 'draft' AND deleted_at IS NULL AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 90 DAY) OR deleted_at = TIMESTAMP '{NOW}'",
    "v10_ownership_transfer": "SELECT project_id, CASE WHEN owner_user_id IN (SELECT owner_user_id FROM projects WHERE owner_kind = 'guest') THEN owner_user_id + 1 ELSE owner_user_id END AS owner_user_id FROM projects",
    "f7_national_reference": """SELECT project_id, client_field_id, 'A' || lpad(CAST(CAST(floor(lon0 / 0.002) AS BIGINT) % 1000 AS VARCHAR), 3, '0') AS municipality_code, NULL AS section, CAST(CAST(floor(lat0 / 0.002) AS BIGINT) % 10000 AS VARCHAR) AS sheet,
      NULL AS attachment, NULL AS development, CAST(CAST(floor(lon0 / 0.002) AS BIGINT) AS VARCHAR) AS parcel FROM project_fields""",
    "d1_unique_references": "SELECT project_id, min(client_field_id) AS client_field_id FROM project_fields GROUP BY project_id, grape_variety, rootstock",
    "d2_archive_merge": "SELECT project_id, CASE WHEN origin = 'imported' THEN name ELSE upper(name) END AS name FROM projects",
    "p14_headland": "WITH w AS (SELECT *, headland_width_m - CASE WHEN project_id % 5 = 1 THEN 4 ELSE 0 END AS w FROM project_fields) SELECT project_id, client_field_id, CASE WHEN l_shape AND (w IS NULL OR w < 6) THEN 6 WHEN w >= 0 THEN w END AS headland_m FROM w",
    "p15_advice": """SELECT project_id, client_field_id, 'spacing_incomplete' AS advice FROM project_fields WHERE project_id % 10 = 3
      UNION ALL SELECT project_id, client_field_id, CASE WHEN headland_width_m > 0 THEN 'mechanization_verify_machine' ELSE 'mechanization_headland_missing' END FROM project_fields WHERE l_shape""",
    "p16_orientation": "SELECT project_id, client_field_id, round(least(greatest(orientation_deg * 1.37 - 20, 0), 179.9), 1) AS orientation FROM project_fields",
    "p19_count_violations": "SELECT list_id, client_field_id, 'quantity' AS violation FROM counts_entries WHERE quantity < 5",
    "p20_profile_errors": "SELECT user_id, list_filter([CASE WHEN email IS NULL THEN 'email' END, CASE WHEN company_name IS NULL THEN 'company_name' END, CASE WHEN count(*) OVER (PARTITION BY lower(display_name)) > 1 THEN 'display_name' END], lambda x: x IS NOT NULL) AS missing FROM profiles",
    "v17_quote_text": """WITH c AS (SELECT grape_variety, clone_selection, rootstock, CASE WHEN count(DISTINCT lot) = 1 THEN min(lot) END AS lot FROM production_lots GROUP BY ALL)
      SELECT project_id, string_agg(concat_ws(' ', label, CAST(CAST(ceil(simulated_plants / 25) * 25 AS BIGINT) AS VARCHAR), coalesce(lot, '-')), '; ' ORDER BY display_order, client_field_id) AS quote_text FROM project_fields LEFT JOIN c USING (grape_variety, clone_selection, rootstock) GROUP BY project_id""",
    "a18_catalogue": "SELECT DISTINCT grape_variety, clone_selection FROM production_lots",
    "r4_terrain_faces": f"WITH {_FACES} SELECT model_id, i, j, k, round(slope, 3) AS slope_percent, round(mean, 3) AS mean_z FROM fc",
    "a13_terrain_summary": f"WITH {_FACES} SELECT model_id, round(min(z), 3) AS min_z, round(max(z), 3) AS max_z, round(max(z) - min(z), 3) AS range_z, count(*) AS n_cells, (SELECT round(max(slope), 3) FROM fc WHERE fc.model_id = cells.model_id) AS max_slope_percent FROM cells GROUP BY model_id",
    "r6_surface_area": f"WITH {_FACES} SELECT model_id, round(sum(12.5 * sqrt(1 + (slope / 100) ** 2)), 2) AS surface_m2 FROM fc GROUP BY model_id",
    "r1_model_errors": """SELECT project_id, CASE WHEN project_id % 11 = 0 THEN 'version' WHEN project_id % 7 = 0 THEN 'crs' WHEN project_id % 5 = 0 OR project_id % 13 = 0 THEN 'grid' WHEN project_id % 17 = 0 THEN 'source' WHEN project_id % 4 = 0 THEN 'incomplete' END AS error FROM projects""",
    "r2_support_windows": """WITH w AS (SELECT project_id, client_field_id, floor((lon0 * 1e5 - 42.5e0) / 5) * 5 + 2.5e0 AS west, floor((lat0 * 1e5 - 38.75e0) / 5) * 5 - 1.25e0 AS south, ceil((lon0 * 1e5 + area_m2 + 37.5e0) / 5) * 5 + 2.5e0 AS east, ceil((lat0 * 1e5 + 131.25e0) / 5) * 5 - 1.25e0 AS north FROM project_fields),
      s AS (SELECT *, CAST(round((east - west) / 5) AS BIGINT) AS width, CAST(round((north - south) / 5) AS BIGINT) AS height FROM w) SELECT *, width >= 2 AND height >= 2 AND width * height <= 262144 AS allowed FROM s""",
    "r3_heights_at_points": f"""WITH {_CELLS}, p AS (SELECT model_id, j AS point, j * 0.61e0 AS u, j * 1.013e0 - 0.4e0 AS v FROM raster), m AS (SELECT model_id, max(i) AS wi, max(j) AS hj FROM cells GROUP BY model_id),
      q AS (SELECT p.*, CAST(least(floor(greatest(u, 0)), wi - 1) AS INTEGER) AS i, CAST(least(floor(greatest(v, 0)), hj - 1) AS INTEGER) AS j FROM p JOIN m USING (model_id) WHERE u BETWEEN -2e-7 AND wi + 2e-7 AND v BETWEEN -2e-7 AND hj + 2e-7),
      h AS (SELECT q.model_id, point, u - q.i AS a, v - q.j AS b, c0.z AS z00, c1.z AS z10, c2.z AS z01, c3.z AS z11 FROM q JOIN cells c0 ON c0.model_id = q.model_id AND c0.i = q.i AND c0.j = q.j JOIN cells c1 ON c1.model_id = q.model_id AND c1.i = q.i + 1 AND c1.j = q.j
        JOIN cells c2 ON c2.model_id = q.model_id AND c2.i = q.i AND c2.j = q.j + 1 JOIN cells c3 ON c3.model_id = q.model_id AND c3.i = q.i + 1 AND c3.j = q.j + 1)
      SELECT p.model_id, p.point, round(CASE WHEN a + b <= 1 THEN z00 + a * (z10 - z00) + b * (z01 - z00) ELSE z11 + (1 - b) * (z10 - z11) + (1 - a) * (z01 - z11) END, 5) AS z FROM p LEFT JOIN h ON h.model_id = p.model_id AND h.point = p.point""",
    "r5_draped_lengths": f"WITH {_CELLS}, {_DRAPED} SELECT model_id, line, round(length_m, 4) AS length_m FROM draped",
    "r9_blended_heights": """WITH f AS (SELECT *, least(1, greatest(0, (simulated_plants / 20 - 10) / 25)) AS t FROM project_fields) SELECT project_id, client_field_id, round(CASE WHEN t <= 0 THEN lat0 WHEN display_order <> 5 THEN lat0 + (area_m2 / 10 - lat0) * t * t * (3 - 2 * t) END, 6) AS height FROM f""",
    "r11_draped_plants": f"""WITH {_CELLS}, {_DRAPED} SELECT model_id, line % 10 AS field, count(*) AS row_count, CASE WHEN count(length_m) = count(*) THEN round(sum(length_m), 4) END AS surface_row_m, CASE WHEN count(length_m) = count(*) THEN CAST(sum(floor(length_m / 0.9e0) + 1) AS BIGINT) END AS plants,
      CASE WHEN count(length_m) = count(*) THEN CAST(sum(greatest(0, ceil(length_m / 4.5e0) - 1) + 2) AS BIGINT) END AS posts FROM draped GROUP BY model_id, line % 10""",
    "r10_height_colours": f"WITH {_CELLS}, n AS (SELECT *, CAST(round((z + 32768) * 256) AS BIGINT) AS n FROM cells) SELECT model_id, i, j, n // 65536 % 256 AS r, n // 256 % 256 AS g, n % 256 AS b FROM n",
}
ORACLES = {k: with_views(v) for k, v in _SQL.items()}
