"""Queries of the dashboard and the relational operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.operators import dashboard as d
from terraloom.sources.views import view, with_views


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return d.field_rows(*[view(spark, sf, v) for v in ("projects", "project_fields", "profiles", "contacts")])


def _v(name: str):
    return lambda s, sf: view(s, sf, name)


def rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: projects with totals of their fields and their quotes."""
    out = d.project_rollup(view(spark, sf, "projects"), _rows(spark, sf), view(spark, sf, "quote_requests"))
    return out.withColumn("area_m2", F.round("area_m2", 2))


def _clients(spark: SparkSession, sf: str) -> DataFrame:
    return d.client_rollup(view(spark, sf, "projects"), _rows(spark, sf), view(spark, sf, "profiles"), view(spark, sf, "contacts"))


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 2) for c in cols})


QUERIES = {
    "p1_field_rows": lambda s, sf: _rounded(_rows(s, sf).drop("owner_user_id", "display_order"), "area_m2"),
    "p6_filter_rows": lambda s, sf: d.filter_rows(_rows(s, sf), query="campo 2 promo", environment="live", year_from=1996, min_plants=200).select("row_id", "client", "commercial_plants", "year"),
    "p7_filter_projects": lambda s, sf: d.filter_projects(view(s, sf, "projects"), _rows(s, sf), environment="live", grape_variety="econ", min_plants=500, created_from="1995-03-01", created_to="1997-02-10").select("project_id", "public_code", "status"),
    "p8_filter_chain": lambda s, sf: d.chain(view(s, sf, "projects"), _rows(s, sf), d.client_key(view(s, sf, "projects"), view(s, sf, "profiles"), view(s, sf, "contacts")), planting_status="planned", status="client"),
    "a1_project_rollup": rollup,
    "a2_client_rollup": lambda s, sf: _rounded(_clients(s, sf), "area_m2"),
    "a3_kpis": lambda s, sf: _rounded(d.kpis(_rows(s, sf), rollup(s, sf), _clients(s, sf)), "archive_area_m2"),
    "a4_summary": lambda s, sf: _rounded(d.summary(view(s, sf, "projects"), _rows(s, sf)), "total_area_m2"),
    "a9_report_summary": lambda s, sf: _rounded(d.report_summary(_rows(s, sf)), "area_m2"),
    "s1_recent_projects": lambda s, sf: d.recent(view(s, sf, "projects"), view(s, sf, "contacts")),
    "s2_owned_projects": lambda s, sf: d.owned(view(s, sf, "projects"), 49, "LIVE").select("project_id", "updated_at", "version"),
    "s4_profiles": lambda s, sf: view(s, sf, "profiles").select("user_id", "display_name").orderBy("display_name"),
    "p2_embedded_fields": lambda s, sf: d.exploded(d.fields_in_projects(view(s, sf, "projects"), view(s, sf, "project_fields"))),
    "w1_latest_revision": lambda s, sf: d.latest(view(s, sf, "revisions").select("project_id", "revision_number", "label", "rootstock"), "project_id", "revision_number"),
    "o2_keyset_page": lambda s, sf: d.page(view(s, sf, "counts_lists").select("list_id", "status"), "list_id", 40, 25),
    "o5_recent_lists": lambda s, sf: d.top_lists(view(s, sf, "counts_lists"), view(s, sf, "counts_entries")),
}

_ROWS = """
fr AS (
  SELECT concat(cast(p.project_id AS string), ':', cast(f.client_field_id AS string)) AS row_id, p.project_id, f.client_field_id AS field_id, f.display_order, p.owner_user_id,
    p.name AS project_name, p.public_code AS project_code, coalesce(c.company_name, c.first_name, 'Da definire') AS client,
    CASE WHEN p.owner_kind = 'guest' THEN concat('Guest', lpad(right(cast(p.owner_user_id AS string), 4), 4, '0')) ELSE coalesce(pr.display_name, 'Utente') END AS user_label,
    coalesce(c.municipality, '') AS municipality, f.planting_status, f.label, f.grape_variety, f.clone_selection, f.rootstock, f.terrain_invalid,
    CASE WHEN NOT f.terrain_invalid THEN f.area_m2 END AS area_m2, CASE WHEN NOT f.terrain_invalid THEN f.simulated_plants END AS calculated_plants,
    CASE WHEN NOT f.terrain_invalid THEN f.commercial_plants_25 END AS commercial_plants, p.environment, p.status, p.owner_kind, p.origin, p.campaign_year AS year
  FROM projects p JOIN project_fields f ON p.project_id = f.project_id LEFT JOIN profiles pr ON pr.user_id = p.owner_user_id LEFT JOIN contacts c ON c.contact_id = p.owner_user_id
  WHERE p.deleted_at IS NULL
), rows_ AS (
  SELECT *, lower(concat_ws(' ', project_code, project_name, label, client, user_label, municipality, grape_variety, clone_selection, rootstock)) AS search_text FROM fr
)"""
_ROLL = """
t AS (
  SELECT project_id, count(*) AS n, CASE WHEN bool_or(terrain_invalid) THEN NULL ELSE sum(area_m2) END AS area, CASE WHEN bool_or(terrain_invalid) THEN NULL ELSE sum(commercial_plants) END AS plants
  FROM rows_ GROUP BY project_id
), roll AS (
  SELECT p.project_id, p.public_code AS code, p.name, p.status, p.environment, p.campaign_year AS year, coalesce(t.n, 0) AS field_count,
    round(CASE WHEN t.n IS NULL THEN 0 ELSE t.area END, 2) AS area_m2, CAST(CASE WHEN t.n IS NULL THEN 0 ELSE t.plants END AS BIGINT) AS commercial_plants,
    q.project_id IS NOT NULL AS quote_requested, coalesce(q.quote_number, '') AS quote_number
  FROM projects p LEFT JOIN t ON t.project_id = p.project_id LEFT JOIN (SELECT * FROM quote_requests WHERE delivery_status = 'sent') q ON q.project_id = p.project_id
  WHERE p.deleted_at IS NULL
)"""
_CLIENT = """
k AS (
  SELECT p.project_id, CASE WHEN pr.user_id IS NOT NULL THEN concat('owner:', cast(p.owner_user_id AS string)) WHEN c.email IS NOT NULL THEN concat('email:', lower(c.email)) ELSE concat('contact:', cast(p.owner_user_id AS string)) END AS client_key
  FROM projects p LEFT JOIN profiles pr ON pr.user_id = p.owner_user_id LEFT JOIN contacts c ON c.contact_id = p.owner_user_id WHERE p.deleted_at IS NULL
), cl AS (
  SELECT client_key, count(DISTINCT k.project_id) AS project_count, count(r.row_id) AS field_count,
    round(CASE WHEN bool_or(r.terrain_invalid) THEN NULL ELSE coalesce(sum(r.area_m2), 0) END, 2) AS area_m2,
    CAST(CASE WHEN bool_or(r.terrain_invalid) THEN NULL ELSE coalesce(sum(r.commercial_plants), 0) END AS BIGINT) AS commercial_plants,
    CAST(CASE WHEN bool_or(r.terrain_invalid AND r.planting_status = 'planned') THEN NULL ELSE coalesce(sum(CASE WHEN r.planting_status = 'planned' THEN r.commercial_plants END), 0) END AS BIGINT) AS plants_to_plant
  FROM k LEFT JOIN rows_ r ON r.project_id = k.project_id GROUP BY client_key
)"""

_SQL = {
    "p1_field_rows": f"WITH {_ROWS} SELECT * EXCLUDE (owner_user_id, display_order, area_m2), round(area_m2, 2) AS area_m2 FROM rows_",
    "p6_filter_rows": f"WITH {_ROWS} SELECT row_id, client, commercial_plants, year FROM rows_ WHERE (contains(search_text, 'campo 2 promo') OR (contains(search_text, 'campo') AND contains(search_text, '2') AND contains(search_text, 'promo'))) AND environment = 'LIVE' AND year >= 1996 AND coalesce(commercial_plants, 0) >= 200",
    "p7_filter_projects": f"WITH {_ROWS} SELECT project_id, public_code, status FROM projects p WHERE deleted_at IS NULL AND environment = 'LIVE' AND created_at >= TIMESTAMP '1995-03-01' AND created_at < TIMESTAMP '1997-02-11' AND EXISTS (SELECT 1 FROM rows_ r WHERE r.project_id = p.project_id AND contains(lower(r.grape_variety), 'econ')) AND (SELECT coalesce(sum(commercial_plants), 0) FROM rows_ r WHERE r.project_id = p.project_id) >= 500",
    "p8_filter_chain": f"WITH {_ROWS}, {_CLIENT} SELECT client_key, count(*) AS projects FROM k WHERE project_id IN (SELECT project_id FROM rows_ WHERE planting_status = 'planned' AND status = 'client') GROUP BY client_key",
    "a1_project_rollup": f"WITH {_ROWS}, {_ROLL} SELECT * FROM roll",
    "a2_client_rollup": f"WITH {_ROWS}, {_CLIENT} SELECT * FROM cl",
    "a3_kpis": f"""WITH {_ROWS}, {_ROLL}, {_CLIENT} SELECT (SELECT count(*) FROM rows_) AS total_fields,
      (SELECT CAST(CASE WHEN bool_or(terrain_invalid) THEN NULL ELSE sum(commercial_plants) END AS BIGINT) FROM rows_ WHERE planting_status = 'planned') AS plants_to_plant,
      (SELECT round(CASE WHEN bool_or(terrain_invalid) THEN NULL ELSE sum(area_m2) END, 2) FROM rows_) AS archive_area_m2,
      (SELECT count(*) FROM roll) AS total_projects, (SELECT count(*) FROM roll WHERE quote_requested) AS quote_requests, (SELECT count(*) FROM cl) AS total_clients""",
    "a4_summary": f"""WITH {_ROWS} SELECT count(*) AS total_projects, count(*) FILTER (status = 'quote_requested') AS quote_requests, count(*) FILTER (status = 'client') AS clients,
      count(*) FILTER (owner_kind = 'guest') AS guest_projects, count(*) FILTER (owner_kind = 'user') AS registered_projects, count(*) FILTER (origin = 'imported') AS imported_projects,
      (SELECT CAST(sum(commercial_plants) AS BIGINT) FROM rows_) AS total_plants, (SELECT round(sum(area_m2), 2) FROM rows_) AS total_area_m2 FROM projects""",
    "a9_report_summary": f"""WITH {_ROWS}, o AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY display_order, field_id, grape_variety) AS n FROM rows_),
      v AS (SELECT project_id, list(grape_variety ORDER BY m) AS varieties FROM (SELECT project_id, grape_variety, min(n) AS m FROM o GROUP BY ALL) GROUP BY project_id),
      r AS (SELECT project_id, list(rootstock ORDER BY m) AS rootstocks FROM (SELECT project_id, rootstock, min(n) AS m FROM o GROUP BY ALL) GROUP BY project_id),
      s AS (SELECT project_id, round(CASE WHEN bool_or(terrain_invalid) THEN NULL ELSE sum(area_m2) END, 2) AS area_m2, CAST(CASE WHEN bool_or(terrain_invalid) THEN NULL ELSE sum(calculated_plants) END AS BIGINT) AS calculated_plants FROM o GROUP BY project_id)
      SELECT project_id, area_m2, calculated_plants, varieties, rootstocks FROM s JOIN v USING (project_id) JOIN r USING (project_id)""",
    "s1_recent_projects": "SELECT project_id, public_code, p.created_at, company_name, email FROM (SELECT * FROM projects WHERE deleted_at IS NULL ORDER BY created_at DESC, project_id LIMIT 500) p LEFT JOIN contacts ON contact_id = owner_user_id",
    "s2_owned_projects": "SELECT project_id, updated_at, version FROM projects WHERE owner_user_id = 49 AND environment = 'LIVE' AND deleted_at IS NULL",
    "s4_profiles": "SELECT user_id, display_name FROM profiles",
    "p2_embedded_fields": """WITH f AS (SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY display_order, client_field_id) - 1 AS INTEGER) AS index, client_field_id, label FROM project_fields)
      SELECT f.* FROM f SEMI JOIN projects USING (project_id) UNION ALL SELECT project_id, 0, 0, 'Campo' FROM projects WHERE project_id % 2 = 0 AND project_id NOT IN (SELECT project_id FROM project_fields)""",
    "w1_latest_revision": "SELECT project_id, revision_number, label, rootstock FROM revisions r WHERE revision_number = (SELECT max(revision_number) FROM revisions q WHERE q.project_id = r.project_id)",
    "o2_keyset_page": "SELECT list_id, status, (SELECT count(*) FROM counts_lists WHERE list_id > 40) > 25 AS has_more FROM counts_lists WHERE list_id > 40 ORDER BY list_id LIMIT 25",
    "o5_recent_lists": """WITH l AS (SELECT list_id, owner_user_id, CAST(row_number() OVER (PARTITION BY owner_user_id ORDER BY updated_at DESC, list_id) AS INTEGER) AS list_rank FROM counts_lists WHERE deleted_at IS NULL),
      e AS (SELECT list_id, client_field_id, entry_no, quantity, CAST(row_number() OVER (PARTITION BY list_id ORDER BY updated_at DESC, entry_no, client_field_id) AS INTEGER) AS entry_rank FROM counts_entries)
      SELECT l.*, e.* EXCLUDE (list_id) FROM l JOIN e USING (list_id) WHERE list_rank <= 5 AND entry_rank <= 5""",
}
ORACLES = {k: with_views(v) for k, v in _SQL.items()}
