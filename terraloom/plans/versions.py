"""Queries of the versioned maintenance jobs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloom.functions.stages import kept
from terraloom.operators import versions as v
from terraloom.plans.catalog import _nested
from terraloom.sources.views import view, with_rings, with_views

KEY = ["project_id", "client_field_id"]


def _events(s: SparkSession, sf: str) -> DataFrame:
    return s.read.parquet(f"{sf}/events.parquet")


def _created(s: SparkSession, sf: str) -> DataFrame:
    ops = view(s, sf, "sync_ops").select("project_id", "seq", (F.col("expected_version") + F.col("project_id") % 9 - 1).alias("expected_version"))
    return v.create_revisions(ops, view(s, sf, "projects").where("project_id % 5 <> 4").select("project_id", "version", "latest_revision_number"))


def _restored(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every second project goes back; a revision's snapshot lacks every third field and has a field of its own."""
    p, f = view(s, sf, "projects"), view(s, sf, "project_fields").select(*KEY, "display_order", "label", "area_m2", "commercial_plants_25")
    n = F.col("revision_number")
    r = view(s, sf, "revisions").select("project_id", "revision_number", F.when(n % 2 == 0, F.concat(F.lit("Nome "), n.cast("string"))).otherwise("").alias("name"), F.when(F.col("project_id") % 3 == 0, 2000 + n.cast("int")).alias("campaign_year"))
    item = lambda i, label, area, plants: F.struct(i.alias("client_field_id"), label.alias("label"), area.alias("area_m2"), plants.alias("commercial_plants_25"))
    kept_ = r.join(f, "project_id").where((F.col("display_order") + n) % 3 != 0).groupBy("project_id", "revision_number").agg(F.collect_list(item(F.col("client_field_id"), F.concat("label", F.lit(" r"), n.cast("string")), F.col("area_m2") / 2, F.col("commercial_plants_25"))).alias("items"))
    own = F.array(item(-n, F.lit("Campo"), F.lit(1.0), F.lit(25).cast("long")))
    r = r.join(kept_, ["project_id", "revision_number"], "left").select("project_id", "revision_number", "name", "campaign_year", F.coalesce(F.concat("items", own), own).alias("fields"))
    asked = p.where("project_id % 2 = 1").select("project_id", (F.col("project_id") % 3 + 1).alias("revision_number"))
    return v.restore_revisions(asked, p, r, f, F.lit("now"))


def _edited(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    # Fields are read three times; written once, they are joined once.
    p, f = view(s, sf, "projects"), kept(view(s, sf, "project_fields").select(*KEY, "display_order", "label", "area_m2", "commercial_plants_25"))
    k = F.col("client_field_id")
    # Edits in the order of their fields, every seventh project's with a version that is never there; each expects the version that the applied ones before it leave, some one less.
    w = Window.partitionBy("project_id").orderBy("display_order", "client_field_id")
    name = F.when(k % 7 == 0, " ").when(k % 7 == 1, F.repeat("label", 12)).otherwise(F.concat(F.lit(" "), "label", F.lit(" bis")))
    edits = f.where(k % 3 != 0).select(*KEY, "display_order", F.when(k % 3 == 1, "delete").otherwise("rename").alias("action"), name.alias("name"), F.row_number().over(w).alias("seq"))
    good = (F.col("action") == "delete") | ((k % 7 != 0) & (k % 7 != 1))
    edits = edits.withColumn("before", F.coalesce(F.sum(good.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).join(p.select("project_id", "version"), "project_id")
    edits = edits.withColumn("expected_version", F.col("version") + F.col("before") + (F.col("project_id") % 11 == 0).cast("int"))
    return v.edit_fields(f, edits.where(k % 5 != 0), p.select("project_id", "version", "latest_revision_number"))


def _moves(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of each owner's projects; four moves in a pair: first and second field over, the first again, and one back. Field ids are numbers in the project, so they clash."""
    f = view(s, sf, "project_fields").groupBy("project_id").agg(F.array_sort(F.collect_set("display_order")).alias("field_ids"))
    # Projects are read three times, as what moves are made of and as both sides; written once, their fields are gathered once.
    p = kept(view(s, sf, "projects").join(f, "project_id").select("project_id", "owner_user_id", "deleted_at", "version", "latest_revision_number", "field_ids"))
    w = Window.partitionBy("owner_user_id").orderBy("project_id")
    pair = p.withColumn("n", F.row_number().over(w)).withColumn("b", F.lead("project_id").over(w)).where("n % 2 = 1 AND b IS NOT NULL")
    k = F.col("project_id")
    move = lambda n, a, b, field: F.struct(F.lit(n).alias("n"), a.alias("source_id"), b.alias("target_id"), field.alias("field_id"))
    first, second = F.get("field_ids", F.lit(0)), F.coalesce(F.get("field_ids", F.lit(1)), F.lit(99))
    steps = F.array(move(0, k, F.col("b"), first), move(1, k, F.col("b"), second), move(2, k, F.col("b"), first), move(3, F.col("b"), k, first))
    moves = pair.select("owner_user_id", k.alias("a"), F.explode(steps).alias("m")).select((F.col("a") * 4 + F.col("m.n")).alias("op_id"), (F.col("a") * 4 + F.col("m.n")).alias("seq"), "m.source_id", "m.target_id", "m.field_id", F.when(F.col("a") % 13 == 0, -1).otherwise(F.col("owner_user_id")).alias("user_id"), (F.col("a") % 26 == 0).alias("admin"))
    return v.move_results(moves, p), p


def _moved(s: SparkSession, sf: str) -> DataFrame:
    out = _moves(s, sf)[0]
    return out.select("seq", "source_id", "target_id", "outcome", "new_field_id", "source_version", "target_version", "source_revision", "target_revision", F.array_join("source_fields", ",").alias("source_fields"), F.array_join("target_fields", ",").alias("target_fields"))


def _issued(s: SparkSession, sf: str) -> DataFrame:
    r = view(s, sf, "revisions").select("project_id", "revision_number", F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("field_ids"))
    k = F.col("project_id")
    ids = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 == 1, F.array(F.lit(" b "), F.lit("b"), F.lit(" "))).when(k % 5 == 2, F.array(F.lit("z"), F.lit("a"))).otherwise(F.array(F.lit("c"), F.lit("a")))
    owner = F.col("owner_user_id")
    asked = view(s, sf, "projects").select(k.alias("report_id"), "project_id", F.when(k % 11 == 0, owner + 1).otherwise(owner).alias("user_id"), (k % 22 == 0).alias("admin"), F.lit(2).cast("long").alias("revision_number"), ids.alias("ids"), (k % 7 != 0).alias("disclaimer"), F.when(k % 4 == 0, "x").otherwise(F.sha2("public_code", 256)).alias("token_hash"))
    return v.report_errors(asked, view(s, sf, "projects"), r)


def _counted(s: SparkSession, sf: str) -> DataFrame:
    e = _events(s, sf)
    i = F.col("event_id")
    ops = e.select(i.alias("op_id"), "user_id", (F.floor("value").cast("long") % 3).alias("expected"), (F.col("event_type") == "error").alias("deletes"), F.when(i % 17 == 0, "posts").otherwise("plants").alias("category"), F.explode(F.when(i % 13 == 5, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"))
    ops = ops.select("op_id", (F.col("op_id") * 2 + F.col("again")).alias("seq"), F.col("user_id").alias("count_id"), (F.col("user_id") % 40).alias("list_id"), (F.col("user_id") % 9).alias("owner"), F.when((F.col("op_id") % 26 == 5) & (F.col("again") == 1), "other").otherwise("same").alias("digest"), "expected", "deletes", "category", F.lit(None).cast("string").alias("field"))
    lists = _events(s, sf).select((F.col("user_id") % 40).alias("list_id"), (F.col("user_id") % 9).alias("owner_user_id")).distinct().withColumn("deleted_at", F.when(F.col("list_id") % 6 == 0, "gone"))
    return v.apply_counts(ops, lists)


def _accepted(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    subs = view(s, sf, "submissions")
    verdicts = subs.select("submission_id", F.when(F.col("submission_id") % 12 == 1, "changed").otherwise("accepted").alias("verdict"))
    sent = subs.select("submission_id", "list_id").join(view(s, sf, "counts_entries"), "list_id").select("submission_id", "client_field_id", "quantity")
    return v.accepted_submissions(verdicts, sent, subs.where("submission_id % 5 = 0").select("submission_id"))


def _merged(s: SparkSession, sf: str) -> DataFrame:
    f = view(s, sf, "project_fields").select(*KEY, "label", "rootstock")
    k = F.col("client_field_id")
    account = f.where(k % 3 != 0).withColumn("label", F.when(k % 5 < 2, F.upper("label")).otherwise(F.col("label"))).withColumn("sync_state", F.when(k % 2 == 0, "synced").otherwise("pending"))
    return v.merge_guest(f.where(k % 7 != 0), account, KEY, ["label", "rootstock"])


def _filled(s: SparkSession, sf: str) -> DataFrame:
    p = view(s, sf, "projects").select("project_id", "created_at", F.when(F.col("project_id") % 4 == 0, F.concat(F.lit("old-"), F.col("project_id").cast("string"))).when(F.col("project_id") % 4 != 1, F.col("public_code")).alias("public_code"))
    codes, aliases = v.backfilled_codes(p)
    return codes.join(aliases.withColumnRenamed("code", "alias"), "project_id", "left")


def _profiles(s: SparkSession, sf: str) -> DataFrame:
    e = _events(s, sf)
    asked = e.select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", " ").otherwise(F.concat(F.lit(" N"), F.col("event_id").cast("string"))).alias("display_name"), F.concat(F.lit("User."), (F.col("user_id") % 60).cast("string"), F.when(F.col("event_type") == "view", "!").otherwise("")).alias("username"), F.when(F.col("user_id") % 9 == 0, "admin").when(F.col("user_id") % 9 == 1, "anonymous").alias("role"))
    return v.upsert_profiles(asked, view(s, sf, "profiles").select("user_id", F.concat(F.lit("USER."), F.col("user_id").cast("string")).alias("username")).where("user_id % 10 = 3"))


def _claimed(s: SparkSession, sf: str) -> DataFrame:
    p = view(s, sf, "projects")
    guests = p.where("owner_kind = 'guest'").select(F.col("owner_user_id").alias("guest")).distinct()
    token = F.concat(F.lit("t"), F.col("guest").cast("string"))
    grants = guests.select(F.sha2(token, 256).alias("token_hash"), "guest", (F.col("guest") + 1).alias("used_by"))
    claims = guests.select(F.when(F.col("guest") % 3 == 0, "wrong").otherwise(token).alias("token"), (F.col("guest") + F.when(F.col("guest") % 5 == 0, 2).otherwise(1)).alias("user_id"))
    return v.claimed(p.select("project_id", "owner_user_id"), grants, claims)


def _chosen(s: SparkSession, sf: str) -> DataFrame:
    r = view(s, sf, "revisions").select("project_id", "revision_number", F.when(F.col("project_id") % 3 != 0, F.sequence(F.lit(1).cast("long"), F.col("revision_number").cast("long") + 1)).alias("field_ids"))
    return v.chosen_fields(view(s, sf, "projects"), r, view(s, sf, "project_fields"))


def _detail(s: SparkSession, sf: str) -> DataFrame:
    owners = view(s, sf, "projects").select("owner_user_id", "owner_kind").distinct()
    out = v.list_details(view(s, sf, "counts_lists"), view(s, sf, "counts_entries"), owners)
    return out.select("list_id", "owner_kind", F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["entry_no"].cast("string"), e["quantity"].cast("string"))), ",").alias("entries"))


def _delivered(s: SparkSession, sf: str) -> DataFrame:
    subs = view(s, sf, "submissions").select("submission_id", "list_id", "owner_user_id")
    deliveries = subs.select("submission_id", F.when(F.col("submission_id") % 4 == 1, "failed").otherwise("sending").alias("state"))
    return v.submission_list(subs, deliveries, view(s, sf, "projects").select("owner_user_id", "owner_kind").distinct(), "failed")


def _snapshots(s: SparkSession, sf: str) -> DataFrame:
    f = with_rings(view(s, sf, "project_fields"))
    xy = F.transform("ring", lambda p: F.array(F.round((p["lon"] - F.col("lon0")) / F.col("dlon"), 3), F.round((p["lat"] - F.col("lat0")) / F.col("dlat"), 3)))
    one = F.struct(F.concat(F.lit("f"), F.col("client_field_id").cast("string")).alias("id"), "label", xy.alias("geometry"), F.col("row_spacing_m").alias("rowSpacingM"), "rootstock", F.struct(F.col("area_m2").alias("areaM2")).alias("metrics"))
    body = f.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("display_order", "client_field_id", one.alias("f")))).alias("fs"))
    docs = body.select("project_id", F.to_json(F.struct(F.lit("Piano").alias("name"), F.transform("fs", lambda x: x["f"]).alias("fields"))).alias("body"))
    _, rows = v.snapshot_tables(docs, "project_id", "body")
    return rows.select("project_id", "client_field_id", "display_order", "geometry", "design", F.round("gross_area_m2", 2).alias("gross_area_m2"))


def _archives(s: SparkSession, sf: str) -> DataFrame:
    p, k = view(s, sf, "projects"), F.col("project_id")
    a = p.select(k.alias("key"), (k % 5).cast("int").alias("version"), F.when(k % 2 == 0, k.cast("string")).otherwise(" ").alias("id"), F.when(k % 3 != 0, F.col("created_at")).alias("saved_at"), F.when(k % 4 == 0, "1999").when(k % 4 == 1, "2020").otherwise("x").alias("campaign_year"), F.when(k % 5 == 2, F.array(k, k + 1)).alias("fields"), k.alias("single"))
    return v.migrated_archives(a, F.lit("2001-01-01").cast("timestamp"))


def _matched(s: SparkSession, sf: str) -> DataFrame:
    f = view(s, sf, "project_fields")
    o = f.select(F.col("project_id").alias("owner"), F.col("display_order").cast("long").alias("old"), (F.col("client_field_id") % 4).alias("new"), F.col("simulated_plants").cast("double").alias("area"))
    return v.portion_matches(o.groupBy("owner", "old", "new").agg(F.sum("area").alias("area")))


def _oriented(s: SparkSession, sf: str) -> DataFrame:
    f = view(s, sf, "project_fields").select(*KEY, "orientation_deg", (F.col("display_order") % 2 == 0).alias("orientation_locked"))
    return v.suggested_orientation(f, f.where("client_field_id % 3 <> 0").select(*KEY, F.lit(45).alias("angle")), KEY).select(*KEY, "orientation_deg")


def _placed(s: SparkSession, sf: str) -> DataFrame:
    return v.set_locations(*_nested(s, sf), view(s, sf, "projects")).select("project_id", "municipality", F.col("version").cast("long").alias("version"), F.col("latest_revision_number").cast("long").alias("latest_revision_number"))


QUERIES = {
    "v8_set_locations": _placed,
    "v3_create_revisions": _created,
    "v6_restore_revisions": lambda s, sf: _restored(s, sf)[0].select("project_id", "outcome", "version", "latest_revision_number", "name", "campaign_year", F.col("deleted_at").isNotNull().alias("deleted")),
    "v6_restored_fields": lambda s, sf: _restored(s, sf)[1].withColumn("area_m2", F.round("area_m2", 4)),
    "v6_new_revisions": lambda s, sf: _restored(s, sf)[2].withColumn("fields", F.size("fields")),
    "v7_field_moves": _moved,
    "v7_moved_projects": lambda s, sf: v.moved_projects(*_moves(s, sf))[0].withColumn("field_ids", F.array_join("field_ids", ",")),
    "v7_move_revisions": lambda s, sf: v.moved_projects(*_moves(s, sf))[1].withColumn("field_ids", F.array_join("field_ids", ",")),
    "v9_edited_fields": lambda s, sf: _edited(s, sf)[0].select(*KEY, "label"),
    "v9_edited_projects": lambda s, sf: _edited(s, sf)[1].withColumn("area_m2", F.round("area_m2", 2)),
    "v12_report_errors": _issued,
    "v14_apply_counts": _counted,
    "v15_frozen_entries": lambda s, sf: _accepted(s, sf)[0],
    "v15_new_deliveries": lambda s, sf: _accepted(s, sf)[1],
    "v16_guest_merge": _merged,
    "v19_backfilled_codes": _filled,
    "v20_profiles": _profiles,
    "v21_claims": _claimed,
    "j6_chosen_fields": _chosen,
    "j8_deliveries": _delivered,
    "j17_portion_matches": _matched,
    "j22_list_details": _detail,
    "s12_snapshot_fields": _snapshots,
    "s13_migrated_archives": _archives,
    "p25_suggested_orientation": _oriented,
}

# Edits as in _edited(); those of fields whose id five divides are not sent, so the ones after them expect a version that isn't there yet.
_GOOD = """e AS (SELECT f.*, p.version, p.latest_revision_number, row_number() OVER k AS seq, client_field_id % 3 = 1 AS del, client_field_id % 3 = 1 OR client_field_id % 7 > 1 AS ok, client_field_id % 5 <> 0 AS sent
    FROM project_fields f JOIN projects p USING (project_id) WHERE client_field_id % 3 <> 0 WINDOW k AS (PARTITION BY project_id ORDER BY display_order, client_field_id)),
  x AS (SELECT *, version + coalesce(sum(CAST(ok AS INTEGER)) OVER (PARTITION BY project_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN project_id % 11 = 0 THEN 1 ELSE 0 END AS expected FROM e),
  y AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY seq) AS n FROM x WHERE sent),
  r AS (SELECT project_id, n, client_field_id, del, label, expected = version AND ok AS applied, version + CASE WHEN expected = version AND ok THEN 1 ELSE 0 END AS now FROM y WHERE n = 1
    UNION ALL SELECT y.project_id, y.n, y.client_field_id, y.del, y.label, y.expected = r.now AND y.ok, r.now + CASE WHEN y.expected = r.now AND y.ok THEN 1 ELSE 0 END FROM r JOIN y ON y.project_id = r.project_id AND y.n = r.n + 1),
  edits AS (SELECT f.*, p.version, p.latest_revision_number, coalesce(r.applied AND r.del, false) AS gone, CASE WHEN r.applied AND NOT r.del THEN f.label || ' bis' END AS renamed, coalesce(r.applied, false) AS applied
    FROM project_fields f JOIN projects p USING (project_id) LEFT JOIN r USING (project_id, client_field_id))"""
# Moves as in _moves(), pair by pair: la and lb are the fields of both projects, va and vb their versions.
_MOVES = """pr AS (SELECT project_id, owner_user_id, deleted_at, version, latest_revision_number AS rev, list(DISTINCT CAST(display_order AS VARCHAR) ORDER BY CAST(display_order AS VARCHAR)) AS ids FROM projects JOIN project_fields USING (project_id) GROUP BY ALL),
  w AS (SELECT *, row_number() OVER o AS n, lead(project_id) OVER o AS b FROM pr WINDOW o AS (PARTITION BY owner_user_id ORDER BY project_id)),
  pa AS (SELECT w.project_id AS a, w.b, w.ids AS la, x.ids AS lb, w.version AS va, x.version AS vb, w.rev AS ra, x.rev AS rb, w.ids[1] AS f0, coalesce(w.ids[2], '99') AS f1,
    w.deleted_at IS NULL AND x.deleted_at IS NULL AND (w.project_id % 13 <> 0 OR w.project_id % 26 = 0) AS ok FROM w JOIN pr x ON x.project_id = w.b WHERE w.n % 2 = 1),
  st AS (SELECT *, -1 AS n, '' AS outcome, CAST(NULL AS VARCHAR) AS new FROM pa
    UNION ALL SELECT a, b, CASE WHEN x <> 'field_moved' THEN la WHEN n < 2 OR n = 2 THEN CASE WHEN len(s) = 0 THEN ['empty-' || op] ELSE s END ELSE list_append(la, nw) END,
      CASE WHEN x <> 'field_moved' THEN lb WHEN n < 3 THEN list_append(lb, nw) WHEN len(s) = 0 THEN ['empty-' || op] ELSE s END, va + CASE x WHEN 'field_moved' THEN 1 ELSE 0 END, vb + CASE x WHEN 'field_moved' THEN 1 ELSE 0 END,
      ra + CASE x WHEN 'field_moved' THEN 1 ELSE 0 END, rb + CASE x WHEN 'field_moved' THEN 1 ELSE 0 END, f0, f1, ok, n, x, CASE x WHEN 'field_moved' THEN nw END
    FROM (SELECT * REPLACE (n + 1 AS n), CASE WHEN NOT ok THEN 'access_denied' WHEN NOT list_contains(CASE WHEN n + 1 = 3 THEN lb ELSE la END, CASE WHEN n + 1 = 1 THEN f1 ELSE f0 END) THEN 'field_not_found' ELSE 'field_moved' END AS x, a * 4 + n + 1 AS op,
        list_filter(CASE WHEN n + 1 = 3 THEN lb ELSE la END, lambda y: y <> CASE WHEN n + 1 = 1 THEN f1 ELSE f0 END) AS s,
        CASE WHEN list_contains(CASE WHEN n + 1 = 3 THEN la ELSE lb END, CASE WHEN n + 1 = 1 THEN f1 ELSE f0 END) THEN 'moved-' || (a * 4 + n + 1) WHEN n + 1 = 1 THEN f1 ELSE f0 END AS nw FROM st WHERE n < 3)),
  mv AS (SELECT a * 4 + n AS seq, n, CASE n WHEN 3 THEN b ELSE a END AS source_id, CASE n WHEN 3 THEN a ELSE b END AS target_id, outcome, new, CASE n WHEN 1 THEN f1 ELSE f0 END AS field, CASE n WHEN 3 THEN vb ELSE va END AS sv, CASE n WHEN 3 THEN va ELSE vb END AS tv,
    CASE n WHEN 3 THEN rb ELSE ra END AS sr, CASE n WHEN 3 THEN ra ELSE rb END AS tr, array_to_string(CASE n WHEN 3 THEN lb ELSE la END, ',') AS sf, array_to_string(CASE n WHEN 3 THEN la ELSE lb END, ',') AS tf, outcome = 'field_moved' AS good FROM st WHERE n >= 0),
  rv AS (SELECT source_id AS project_id, sr AS revision_number, 'out' AS direction, field AS field_id, target_id AS other_project_id, sv AS version, sf AS field_ids FROM mv WHERE good UNION ALL SELECT target_id, tr, 'in', new, source_id, tv, tf FROM mv WHERE good)"""
_SQL = {
    "v7_field_moves": f"""WITH RECURSIVE {_MOVES} SELECT seq, source_id, target_id, outcome, new AS new_field_id, CASE WHEN good THEN sv END AS source_version, CASE WHEN good THEN tv END AS target_version, CASE WHEN good THEN sr END AS source_revision, CASE WHEN good THEN tr END AS target_revision,
      CASE WHEN good THEN sf END AS source_fields, CASE WHEN good THEN tf END AS target_fields FROM mv""",
    "v7_moved_projects": f"""WITH RECURSIVE {_MOVES}, l AS (SELECT project_id, arg_max(revision_number, version) AS r, arg_max(field_ids, version) AS f, max(version) AS v FROM rv GROUP BY project_id)
      SELECT project_id, coalesce(l.v, version) AS version, coalesce(l.r, rev) AS latest_revision_number, coalesce(l.f, array_to_string(ids, ',')) AS field_ids FROM pr LEFT JOIN l USING (project_id)""",
    "v7_move_revisions": f"WITH RECURSIVE {_MOVES} SELECT project_id, revision_number, direction, field_id, other_project_id, field_ids FROM rv",
    "v3_create_revisions": """WITH RECURSIVE o AS (SELECT s.project_id, s.seq, s.expected_version + s.project_id % 9 - 1 AS expected, p.version, p.latest_revision_number AS number, row_number() OVER (PARTITION BY s.project_id ORDER BY s.seq) AS n FROM sync_ops s LEFT JOIN projects p ON p.project_id = s.project_id AND p.project_id % 5 <> 4),
      f AS (SELECT project_id, seq, n, version, number, coalesce(expected = version, false) AS good, CASE WHEN expected = version THEN 1 ELSE 0 END AS done FROM o WHERE n = 1
        UNION ALL SELECT o.project_id, o.seq, o.n, o.version, o.number, coalesce(o.expected = o.version + f.done, false), f.done + CASE WHEN o.expected = o.version + f.done THEN 1 ELSE 0 END FROM f JOIN o ON o.project_id = f.project_id AND o.n = f.n + 1)
      SELECT project_id, seq, CASE WHEN version IS NULL THEN 'not_found' WHEN good THEN 'saved' ELSE 'conflict' END AS outcome, version + done AS server_version, CASE WHEN good THEN number + done END AS revision_number FROM f""",
    "v6_restore_revisions": """WITH a AS (SELECT p.*, r.revision_number AS n FROM projects p LEFT JOIN revisions r ON r.project_id = p.project_id AND r.revision_number = p.project_id % 3 + 1 WHERE p.project_id % 2 = 1)
      SELECT project_id, CASE WHEN n IS NULL THEN 'not_found' ELSE 'restored' END AS outcome, version + CASE WHEN n IS NULL THEN 0 ELSE 1 END AS version, latest_revision_number + CASE WHEN n IS NULL THEN 0 ELSE 1 END AS latest_revision_number,
        CASE WHEN n % 2 = 0 THEN 'Nome ' || n ELSE name END AS name, CAST(CASE WHEN n IS NOT NULL AND project_id % 3 = 0 THEN 2000 + n ELSE campaign_year END AS INTEGER) AS campaign_year, n IS NULL AND deleted_at IS NOT NULL AS deleted FROM a""",
    "v6_restored_fields": """WITH a AS (SELECT project_id, revision_number AS n FROM revisions WHERE project_id % 2 = 1 AND revision_number = project_id % 3 + 1)
      SELECT project_id, client_field_id, CASE WHEN (display_order + n) % 3 <> 0 THEN label || ' r' || n ELSE label END AS label, round(CASE WHEN (display_order + n) % 3 <> 0 THEN area_m2 / 2 ELSE area_m2 END, 4) AS area_m2, commercial_plants_25,
        CASE WHEN (display_order + n) % 3 = 0 THEN 'now' END AS deleted_at FROM a JOIN project_fields USING (project_id)
      UNION ALL SELECT project_id, -n, 'Campo', 1.0e0, 25, NULL FROM a""",
    "v6_new_revisions": """WITH a AS (SELECT project_id, revision_number AS n FROM revisions WHERE project_id % 2 = 1 AND revision_number = project_id % 3 + 1)
      SELECT project_id, any_value(latest_revision_number) + 1 AS revision_number, n AS restored_from, 'revision_restore' AS reason, CAST(count(*) FILTER ((display_order + n) % 3 <> 0) + 1 AS INTEGER) AS fields
      FROM a JOIN projects USING (project_id) LEFT JOIN project_fields USING (project_id) GROUP BY project_id, n""",
    "v9_edited_fields": f"WITH RECURSIVE {_GOOD} SELECT project_id, client_field_id, coalesce(renamed, label) AS label FROM edits WHERE NOT gone",
    "v9_edited_projects": f"""WITH RECURSIVE {_GOOD} SELECT project_id, any_value(version) + count(*) FILTER (applied) AS version, any_value(latest_revision_number) + count(*) FILTER (applied) AS latest_revision_number, count(*) FILTER (NOT gone) AS n_fields, round(coalesce(sum(area_m2) FILTER (NOT gone), 0), 2) AS area_m2,
      CAST(coalesce(sum(commercial_plants_25) FILTER (NOT gone), 0) AS BIGINT) AS plants, count(*) FILTER (NOT gone) = 0 AS deleted FROM edits GROUP BY project_id""",
    "v8_set_locations": """WITH f AS (SELECT project_id, count(*) AS n, bool_or(display_order % 3 = 1) AS hit, max(CASE WHEN display_order % 3 = 1 THEN 'M' || CAST(display_order AS VARCHAR) END) AS m FROM project_fields GROUP BY project_id)
      SELECT project_id, CASE WHEN n = 1 AND hit THEN m ELSE '?' END AS municipality, version + CASE WHEN hit THEN 1 ELSE 0 END AS version, latest_revision_number + CASE WHEN hit THEN 1 ELSE 0 END AS latest_revision_number FROM projects JOIN f USING (project_id)""",
    "v12_report_errors": """SELECT project_id AS report_id, [[], ['b'], ['a', 'z'], ['a', 'c'], ['a', 'c']][project_id % 5 + 1] AS sorted_ids,
      CASE WHEN project_id % 11 = 0 AND project_id % 22 <> 0 THEN 'access_denied' WHEN latest_revision_number < 2 THEN 'revision_not_found' WHEN project_id % 5 = 0 THEN 'fields_required'
      WHEN project_id % 5 = 2 THEN 'fields_not_in_revision' WHEN project_id % 7 = 0 THEN 'disclaimer_required' WHEN project_id % 4 = 0 THEN 'invalid_token_hash' END AS error FROM projects""",
    "v14_apply_counts": """WITH RECURSIVE ops AS (
        SELECT event_id AS op_id, event_id * 2 + again AS seq, user_id, CASE WHEN event_id % 26 = 5 AND again = 1 THEN 'other' ELSE 'same' END AS digest, CAST(floor(value) AS BIGINT) % 3 AS expected, event_type = 'error' AS deletes,
          CASE WHEN event_id % 17 = 0 THEN 'posts' ELSE 'plants' END AS cat, user_id % 40 % 6 = 0 AS shut FROM events, (VALUES (0), (1)) t(again) WHERE again = 0 OR event_id % 13 = 5),
      o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS n FROM ops),
      f AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS op_id, CAST(-1 AS BIGINT) AS seq, '' AS outcome, CAST(NULL AS BIGINT) AS revision, CAST(0 AS BIGINT) AS rev, false AS gone, '' AS cat FROM o WHERE n = 1
        UNION ALL SELECT user_id, n, op_id, seq, CASE WHEN x = 'REPEATED' THEN 'APPLIED' ELSE x END, CASE x WHEN 'REPEATED' THEN revision WHEN 'APPLIED' THEN rev + 1 WHEN 'VERSION_CONFLICT' THEN rev END,
            CASE x WHEN 'APPLIED' THEN rev + 1 ELSE rev END, CASE x WHEN 'APPLIED' THEN deletes ELSE gone END, CASE x WHEN 'APPLIED' THEN cat ELSE had END
          FROM (SELECT o.*, f.revision, f.rev, f.gone, f.cat AS had, CASE WHEN o.op_id = f.op_id AND digest <> 'same' THEN 'VALIDATION_ERROR' WHEN o.op_id = f.op_id AND f.outcome = 'APPLIED' THEN 'REPEATED' WHEN shut AND NOT deletes THEN 'NOT_FOUND_OR_FORBIDDEN'
            WHEN rev > 0 AND f.cat <> o.cat THEN 'VALIDATION_ERROR' WHEN rev > 0 AND (rev <> expected OR gone AND NOT deletes) THEN 'VERSION_CONFLICT' WHEN rev = 0 AND expected <> 0 THEN 'NOT_FOUND_OR_FORBIDDEN' ELSE 'APPLIED' END AS x
          FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1))
      SELECT seq, op_id, outcome, revision FROM f WHERE n > 0""",
    "v15_frozen_entries": "SELECT submission_id, client_field_id, quantity FROM submissions JOIN counts_entries USING (list_id) WHERE submission_id % 12 <> 1 AND submission_id % 5 <> 0",
    "v15_new_deliveries": "SELECT submission_id, 'pending' AS state, 0 AS attempts FROM submissions WHERE submission_id % 12 <> 1 AND submission_id % 5 <> 0",
    "v16_guest_merge": """SELECT project_id, client_field_id, CASE WHEN client_field_id % 7 = 0 THEN 'untouched' WHEN client_field_id % 3 = 0 THEN 'taken' WHEN client_field_id % 5 >= 2 THEN 'equal' WHEN client_field_id % 2 = 0 THEN 'conflict' ELSE 'proposal' END AS verdict
      FROM project_fields WHERE NOT (client_field_id % 7 = 0 AND client_field_id % 3 = 0)""",
    "v19_backfilled_codes": """WITH u AS (SELECT project_id AS v FROM projects WHERE project_id % 4 > 1), free AS (SELECT v, row_number() OVER (ORDER BY v) AS r FROM range(0, (SELECT 4 * count(*) + 10 FROM projects)) t(v) WHERE v NOT IN (SELECT v FROM u)),
      n AS (SELECT project_id, row_number() OVER (ORDER BY created_at, project_id) AS r FROM projects WHERE project_id % 4 < 2)
      SELECT project_id, 'VO-' || lpad(CAST(v AS VARCHAR), 7, '0') AS code, CASE WHEN project_id % 4 = 0 THEN 'old-' || CAST(project_id AS VARCHAR) END AS alias FROM n JOIN free USING (r) UNION ALL SELECT project_id, public_code, NULL FROM projects WHERE project_id % 4 > 1""",
    "v20_profiles": """WITH l AS (SELECT user_id, max(event_id) AS seq FROM events WHERE event_type NOT IN ('error', 'view') GROUP BY user_id), n AS (SELECT user_id, seq, 'user.' || CAST(user_id % 60 AS VARCHAR) AS username FROM l),
      taken AS (SELECT username, seq FROM n UNION ALL SELECT 'user.' || CAST(user_id AS VARCHAR), -1 FROM profiles WHERE user_id % 10 = 3 AND user_id NOT IN (SELECT user_id FROM l))
      SELECT user_id, 'N' || CAST(seq AS VARCHAR) AS display_name, username, CASE user_id % 9 WHEN 0 THEN 'admin' WHEN 1 THEN 'guest' ELSE 'user' END AS owner_kind, CASE WHEN EXISTS (SELECT 1 FROM taken t WHERE t.username = n.username AND t.seq < n.seq) THEN 'username_taken' END AS error FROM n""",
    "v21_claims": "SELECT project_id, CASE WHEN owner_user_id IN (SELECT owner_user_id FROM projects WHERE owner_kind = 'guest') AND owner_user_id % 3 <> 0 AND owner_user_id % 5 <> 0 THEN owner_user_id + 1 ELSE owner_user_id END AS owner_user_id FROM projects",
    "j6_chosen_fields": """WITH l AS (SELECT project_id, coalesce(list(client_field_id ORDER BY display_order, client_field_id), []) AS b FROM project_fields GROUP BY project_id)
      SELECT p.project_id, CASE WHEN latest_revision_number = 0 OR p.project_id % 3 = 0 OR len(coalesce(b, [])) > latest_revision_number + 1 THEN coalesce(b, []) ELSE range(1, latest_revision_number + 2) END AS field_ids FROM projects p LEFT JOIN l ON l.project_id = p.project_id""",
    "j8_deliveries": "SELECT s.owner_user_id, submission_id, list_id, 'failed' AS state, o.owner_kind FROM submissions s LEFT JOIN (SELECT DISTINCT owner_user_id, owner_kind FROM projects) o ON o.owner_user_id = s.owner_user_id WHERE submission_id % 4 = 1",
    "j17_portion_matches": """WITH RECURSIVE o AS (SELECT project_id AS owner, CAST(display_order AS BIGINT) AS old, client_field_id % 4 AS new, CAST(sum(simulated_plants) AS DOUBLE) AS area FROM project_fields GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY area DESC, old, new) AS n FROM o WHERE area > 0),
      f AS (SELECT owner, old, new, n, [old] AS olds, [new] AS news, true AS kept FROM r WHERE n = 1
        UNION ALL SELECT r.owner, r.old, r.new, r.n, CASE WHEN list_contains(olds, r.old) OR list_contains(news, r.new) THEN olds ELSE list_append(olds, r.old) END, CASE WHEN list_contains(olds, r.old) OR list_contains(news, r.new) THEN news ELSE list_append(news, r.new) END,
          NOT (list_contains(olds, r.old) OR list_contains(news, r.new)) FROM f JOIN r ON r.owner = f.owner AND r.n = f.n + 1)
      SELECT owner, old, new FROM f WHERE kept""",
    "j22_list_details": """WITH e AS (SELECT list_id, string_agg(CAST(entry_no AS VARCHAR) || ':' || CAST(quantity AS VARCHAR), ',' ORDER BY entry_no, client_field_id, quantity) AS entries FROM counts_entries GROUP BY list_id)
      SELECT l.list_id, owner_kind, coalesce(entries, '') AS entries FROM counts_lists l LEFT JOIN (SELECT DISTINCT owner_user_id, owner_kind FROM projects) o USING (owner_user_id) LEFT JOIN e ON e.list_id = l.list_id WHERE deleted_at IS NULL""",
    "s12_snapshot_fields": """SELECT project_id, 'f' || CAST(client_field_id AS VARCHAR) AS client_field_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY display_order, client_field_id) - 1 AS INTEGER) AS display_order, CASE WHEN l_shape THEN 'POLYGON((0.0 0.0, 1.0 0.0, 1.0 0.5, 0.5 0.5, 0.5 1.0, 0.0 1.0, 0.0 0.0))'
        ELSE concat('POLYGON((0.0 0.0, 1.0 0.0, ', CAST(round(1.0e0 + skew, 3) AS VARCHAR), ' 1.0, ', CAST(round(0.0e0 + skew, 3) AS VARCHAR), ' 1.0, 0.0 0.0))') END AS geometry,
      concat('{"label":"', label, '","rowSpacingM":', CAST(row_spacing_m AS VARCHAR), ',"rootstock":"', rootstock, '"}') AS design, round(area_m2, 2) AS gross_area_m2 FROM project_fields""",
    "s13_migrated_archives": """SELECT CASE WHEN project_id % 2 = 0 THEN CAST(project_id AS VARCHAR) ELSE 'project-' || CAST(project_id AS VARCHAR) END AS id, 3 AS version, CASE WHEN project_id % 4 = 1 THEN 2020 WHEN project_id % 3 <> 0 THEN campaign_year ELSE 2001 END AS campaign_year,
      CASE project_id % 5 WHEN 1 THEN [project_id] WHEN 2 THEN [project_id, project_id + 1] ELSE [] END AS fields FROM projects WHERE project_id % 5 BETWEEN 1 AND 3""",
    "p25_suggested_orientation": "SELECT project_id, client_field_id, CASE WHEN display_order % 2 <> 0 AND client_field_id % 3 <> 0 THEN 45.0e0 ELSE orientation_deg END AS orientation_deg FROM project_fields",
}
ORACLES = {k: with_views(x) for k, x in _SQL.items()}
