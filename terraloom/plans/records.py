"""Queries of record keeping and the spatial joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.operators import dashboard, records, spatial
from terraloom.plans.planting import _RING
from terraloom.sources.views import point, view, with_rings, with_views

KEY = ["project_id", "client_field_id"]
TILE = 0.002


def parcels(s: SparkSession, sf: str) -> DataFrame:
    """Square parcels under the fields' first corners, shifted so that no side of a field lies on one of theirs."""
    f = view(s, sf, "project_fields").select(F.floor(F.col("lon0") / TILE).cast("long").alias("tx"), F.floor(F.col("lat0") / TILE).cast("long").alias("ty")).distinct()
    at = lambda i, j: point((F.col("tx") + i) * TILE - 0.0005, (F.col("ty") + j) * TILE - 0.0003)
    return f.select((F.col("tx") * 100_000 + F.col("ty")).alias("parcel_id"), (F.col("tx") * 100_000 + F.col("ty")).alias("ordinal"), F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1), at(0, 0)).alias("ring"))


def _points(s: SparkSession, sf: str) -> DataFrame:
    return view(s, sf, "project_fields").select(*KEY, (F.col("lon0") + 0.0003).alias("lon"), (F.col("lat0") + 0.0007).alias("lat"))


def _touching(s: SparkSession, sf: str) -> DataFrame:
    """What rings are made of is dealt out first, as it comes from few files."""
    fields = view(s, sf, "project_fields").select(*KEY, "lon0", "lat0", "dlon", "dlat", "skew", "l_shape", "has_exclusion")
    return spatial.touching(with_rings(fields.repartition(int(s.conf.get("spark.sql.shuffle.partitions")), *KEY)), parcels(s, sf), KEY)


def _outbox(s: SparkSession, sf: str) -> DataFrame:
    ops = view(s, sf, "sync_ops")
    out = records.merge_outbox(ops.select("operation_id", "project_id", "seq", "expected_version"), ops.where("operation_id % 4 = 0").select("operation_id").distinct(), ops.where("project_id % 9 = 2").select("project_id").distinct())
    return out.select("operation_id", "project_id", "seq", "blocked")


def _requested(s: SparkSession, sf: str) -> DataFrame:
    f = view(s, sf, "project_fields").select(*KEY, "label", "rootstock")
    return f.select(*KEY, records.requested_ids(F.array(F.concat(F.lit(" "), "label"), F.lit("  "), "rootstock", "label")).alias("ids"))


def _revisions(s: SparkSession, sf: str) -> DataFrame:
    ops = view(s, sf, "sync_ops").select("project_id", "seq")
    return records.next_revisions(ops, view(s, sf, "projects").select("project_id", "latest_revision_number"))


def _shown(s: SparkSession, sf: str) -> DataFrame:
    nested = dashboard.fields_in_projects(view(s, sf, "projects"), view(s, sf, "project_fields"))
    return records.public_fields(nested, view(s, sf, "project_fields").where("display_order % 2 = 1"))


def _attempts(s: SparkSession, sf: str) -> DataFrame:
    e = s.read.parquet(f"{sf}/events.parquet")
    return records.quote_states(e.select(F.col("user_id").alias("project_id"), F.when(F.col("event_type") == "purchase", "sent").when(F.col("event_type") == "error", "failed").otherwise("pending").alias("outcome"), F.col("event_id").alias("attempt")))


def _deliveries(s: SparkSession, sf: str) -> DataFrame:
    e = s.read.parquet(f"{sf}/events.parquet")
    action = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "provider_accepted").otherwise("claim")
    return records.deliveries(e.select(F.col("user_id").alias("submission_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at_s"), F.col("event_id").alias("seq"), action.alias("action")))


def _redacted(s: SparkSession, sf: str) -> DataFrame:
    e = s.read.parquet(f"{sf}/events.parquet")
    consents = e.where("user_id % 2 = 0").select("user_id", F.lit("analytics").alias("consent")).distinct()
    return records.redacted_events(e, consents, private={"view": ("k",), "click": ("k", "lat")})


def _signatures(s: SparkSession, sf: str) -> DataFrame:
    """Every third stored signature is current; of the others one is of a moved ring and one is empty."""
    f = with_rings(view(s, sf, "project_fields")).select(*KEY, "display_order", "ring", records.signature(F.col("ring")).alias("signature"))
    stored = F.when(F.col("display_order") % 3 == 0, F.col("signature")).when(F.col("display_order") % 3 == 1, F.concat("signature", F.lit(";0.000000,0.000000"))).otherwise("")
    return f.withColumn("stored", stored).select(*KEY, "signature", records.current(F.col("stored"), F.col("ring")).alias("current"))


def _reports(s: SparkSession, sf: str) -> DataFrame:
    p = view(s, sf, "projects")
    reports = p.select(F.col("project_id").alias("report_id"), F.sha2("public_code", 256).alias("token_hash"), F.col("deleted_at").alias("revoked_at"))
    return records.tokens_to_reports(p.where("project_id % 3 = 1").select(F.col("public_code").alias("token")), reports)


QUERIES = {
    "a7_counts_per_field": lambda s, sf: records.counts_per_field(view(s, sf, "counts_entries"), ["list_id", "client_field_id"]),
    "a10_recompute_totals": lambda s, sf: records.recompute_totals(view(s, sf, "projects"), view(s, sf, "project_fields")).withColumn("gross_area_m2", F.round("gross_area_m2", 2)),
    "a11_revision_history": lambda s, sf: records.revision_history(view(s, sf, "revisions")),
    "d3_outbox_merge": _outbox,
    "d5_requested_ids": _requested,
    "j4_report_tokens": _reports,
    "j10_points_in_parcels": lambda s, sf: spatial.points_in_parcels(_points(s, sf), parcels(s, sf), KEY),
    "j9_fields_on_parcels": _touching,
    "p11_redacted_events": _redacted,
    "p12_public_fields": _shown,
    "st4_acknowledged": lambda s, sf: records.acknowledged(view(s, sf, "sync_ops")),
    "st5_deliveries": _deliveries,
    "v13_revoke": lambda s, sf: records.revoked(view(s, sf, "projects").select("project_id", F.col("deleted_at").alias("revoked_at")), F.lit("2001-01-01").cast("timestamp"), F.col("project_id") % 2 == 0),
    "v18_quote_states": _attempts,
    "w2_next_revisions": _revisions,
    "w6_smallest_unused": lambda s, sf: records.smallest_unused(view(s, sf, "project_fields"), "project_id", "display_order"),
    "f8_reference_text": lambda s, sf: view(s, sf, "project_fields").select(*KEY, records.reference_text(F.col("grape_variety"), F.lit(" "), F.col("rootstock"), F.col("label")).alias("reference")),
    "f9_signature": _signatures,
    "f13_ground_spacing": lambda s, sf: view(s, sf, "project_fields").select(*KEY, F.round(records.horizontal_step(F.col("row_spacing_m"), F.lit(0.1) * F.cos(F.radians("orientation_deg")), F.col("skew")), 6).alias("step_m")),
}

_SQL = {
    "a7_counts_per_field": "SELECT list_id, client_field_id, CAST(coalesce(sum(quantity) FILTER (category = 'plants'), 0) AS BIGINT) AS plants, CAST(coalesce(sum(quantity) FILTER (category = 'posts'), 0) AS BIGINT) AS posts, CAST(coalesce(sum(quantity) FILTER (category = 'other'), 0) AS BIGINT) AS other, max(updated_at) AS updated_at FROM counts_entries GROUP BY ALL",
    "a10_recompute_totals": "SELECT p.project_id, round(coalesce(sum(area_m2), 0), 2) AS gross_area_m2, CAST(coalesce(sum(commercial_plants_25), 0) AS BIGINT) AS commercial_plants_25 FROM projects p LEFT JOIN project_fields f ON f.project_id = p.project_id GROUP BY p.project_id",
    "a11_revision_history": "SELECT project_id, list(revision_number ORDER BY revision_number DESC) AS revision_numbers FROM revisions GROUP BY project_id",
    "d3_outbox_merge": "SELECT operation_id, project_id, seq, project_id % 9 = 2 AS blocked FROM sync_ops WHERE operation_id % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY operation_id ORDER BY seq DESC) = 1",
    "d5_requested_ids": "SELECT project_id, client_field_id, list_sort(list_distinct([label, rootstock])) AS ids FROM project_fields",
    "j4_report_tokens": "SELECT public_code AS token, project_id AS report_id FROM projects WHERE project_id % 3 = 1 AND deleted_at IS NULL",
    "j10_points_in_parcels": """WITH t AS (SELECT DISTINCT CAST(floor(lon0 / 0.002) AS BIGINT) AS tx, CAST(floor(lat0 / 0.002) AS BIGINT) AS ty FROM project_fields)
      SELECT project_id, client_field_id, CASE WHEN t.tx IS NOT NULL THEN t.tx * 100000 + t.ty END AS parcel_id FROM project_fields f LEFT JOIN t ON t.tx = CAST(floor((lon0 + 0.0003 + 0.0005) / 0.002) AS BIGINT) AND t.ty = CAST(floor((lat0 + 0.0007 + 0.0003) / 0.002) AS BIGINT)""",
    "p12_public_fields": "SELECT project_id, coalesce(list(client_field_id ORDER BY display_order, client_field_id) FILTER (display_order % 2 = 1), []) AS shown FROM project_fields SEMI JOIN projects USING (project_id) GROUP BY project_id HAVING count(*) FILTER (display_order % 2 = 1) > 0",
    "st4_acknowledged": "WITH l AS (SELECT *, last_value(seq) OVER (PARTITION BY project_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS by_seq FROM sync_ops) SELECT operation_id, seq, project_id, by_seq FROM l WHERE seq <> by_seq",
    "st5_deliveries": """WITH RECURSIVE o AS (SELECT user_id AS submission_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS at_s, event_id AS seq, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'provider_accepted' ELSE 'claim' END AS action FROM events),
      l AS (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY at_s, seq) AS n FROM o),
      f AS (SELECT submission_id, at_s, seq, action, n, CASE WHEN action = 'claim' THEN 'sending' ELSE 'pending' END AS state, action = 'claim' AS send, CASE WHEN action = 'claim' THEN 1 ELSE 0 END AS attempts, CASE WHEN action = 'claim' THEN at_s END AS began, CASE WHEN action = 'claim' THEN at_s + 120 END AS lease FROM l WHERE n = 1
        UNION ALL SELECT submission_id, at_s, seq, action, n, CASE WHEN old THEN 'uncertain' WHEN send THEN 'sending' WHEN action <> 'claim' AND was = 'sending' THEN action ELSE was END, send, tries + CASE WHEN send THEN 1 ELSE 0 END, CASE WHEN send THEN coalesce(first, at_s) ELSE first END,
          CASE WHEN old OR (action <> 'claim' AND was = 'sending') THEN NULL WHEN send THEN at_s + 120 ELSE held END
        FROM (SELECT *, able AND coalesce(first < at_s - 82800, false) AS old, able AND NOT coalesce(first < at_s - 82800, false) AS send FROM (
          SELECT l.*, f.state AS was, f.attempts AS tries, f.began AS first, f.lease AS held, l.action = 'claim' AND f.state <> 'provider_accepted' AND NOT coalesce(f.lease > l.at_s, false) AS able FROM f JOIN l ON l.submission_id = f.submission_id AND l.n = f.n + 1) x) y)
      SELECT submission_id, at_s, seq, action, state, send, attempts FROM f""",
    "v13_revoke": "SELECT project_id, CASE WHEN project_id % 2 = 0 THEN coalesce(deleted_at, TIMESTAMP '2001-01-01') ELSE deleted_at END AS revoked_at FROM projects",
    "v18_quote_states": "WITH a AS (SELECT user_id AS project_id, event_id, CASE event_type WHEN 'purchase' THEN 'sent' WHEN 'error' THEN 'failed' ELSE 'pending' END AS o FROM events) SELECT project_id, CASE WHEN bool_or(o = 'sent') THEN 'sent' ELSE arg_max(o, event_id) END AS state, count(*) AS attempts FROM a GROUP BY project_id",
    "w2_next_revisions": "SELECT s.project_id, s.seq, coalesce(p.latest_revision_number, 0) + row_number() OVER (PARTITION BY s.project_id ORDER BY s.seq) AS revision_number FROM sync_ops s LEFT JOIN projects p ON p.project_id = s.project_id",
    "w6_smallest_unused": "WITH n AS (SELECT project_id, unnest(range(1, 9)) AS k FROM (SELECT DISTINCT project_id FROM project_fields)) SELECT project_id, min(k) AS unused FROM n WHERE NOT EXISTS (SELECT 1 FROM project_fields f WHERE f.project_id = n.project_id AND f.display_order = n.k) GROUP BY project_id",
    "f8_reference_text": "SELECT project_id, client_field_id, concat(grape_variety, ' · Fg. ', rootstock, ' · Part. ', label) AS reference FROM project_fields",
    "f13_ground_spacing": "WITH a AS (SELECT *, 0.1 * cos(radians(orientation_deg)) AS along FROM project_fields) SELECT project_id, client_field_id, round(row_spacing_m * sqrt((1 + along ** 2) / (1 + along ** 2 + skew ** 2)), 6) AS step_m FROM a",
    "p11_redacted_events": """SELECT event_id, event_type, CASE WHEN event_type IN ('view', 'click') THEN '{}' ELSE replace(replace(props, ': ', ':"'), '}', '"}') END AS payload, CASE WHEN user_id % 2 = 0 THEN user_id END AS visitor FROM events""",
    "f9_signature": f"""WITH {_RING}, p AS (SELECT project_id, client_field_id, display_order, i, printf('%.6f,%.6f', lon, lat) AS t FROM g), s AS (SELECT project_id, client_field_id, display_order, string_agg(t, ';' ORDER BY i) || ';' || min_by(t, i) AS sig FROM p GROUP BY ALL)
      SELECT project_id, client_field_id, sig AS signature, display_order % 3 = 0 AS current FROM s""",
}
ORACLES = {k: with_views(v) for k, v in _SQL.items()}
