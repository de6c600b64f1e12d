"""The planning tables as views over the test tables, in SQL that Spark and other engines read alike.

The operators take any DataFrames; these views only give their queries inputs that grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: In order: later views read earlier ones.
VIEWS: dict[str, str] = {
    "projects": """
SELECT o_orderkey AS project_id, o_custkey AS owner_user_id,
  concat('VO-', lpad(cast(o_orderkey AS string), 7, '0')) AS public_code, concat('Piano ', cast(o_orderkey AS string)) AS name,
  CASE WHEN o_orderkey % 10 = 0 THEN 'TEST' ELSE 'LIVE' END AS environment,
  CASE o_orderkey % 6 WHEN 0 THEN 'draft' WHEN 1 THEN 'saved' WHEN 2 THEN 'pdf_downloaded' WHEN 3 THEN 'quote_requested' WHEN 4 THEN 'contacted' ELSE 'client' END AS status,
  CASE WHEN o_custkey % 97 = 0 THEN 'admin' WHEN o_custkey % 7 = 0 THEN 'guest' ELSE 'user' END AS owner_kind,
  CASE WHEN o_orderkey % 5 = 0 THEN 'imported' ELSE 'direct' END AS origin,
  cast(year(o_orderdate) AS int) AS campaign_year, o_orderdate AS created_at,
  cast(cast(o_orderdate AS date) + cast(o_orderkey % 120 AS int) AS timestamp) AS updated_at,
  CASE WHEN o_orderkey % 17 = 0 THEN cast(cast(o_orderdate AS date) + 40 AS timestamp) END AS deleted_at,
  o_orderkey % 9 AS version, o_orderkey % 4 AS latest_revision_number
FROM orders""",
    "project_fields": """
SELECT l_orderkey AS project_id, (l_suppkey * 1000000000 + l_partkey * 10 + l_linenumber) * 100 + cast(l_quantity AS bigint) AS client_field_id, l_linenumber AS display_order,
  concat('Campo ', cast(l_linenumber AS string)) AS label,
  8.0e0 + (l_orderkey % 500) * 0.004e0 AS lon0, 44.5e0 + (l_partkey % 300) * 0.003e0 AS lat0,
  (20.0e0 + 2.0e0 * l_quantity) / 79000.0e0 AS dlon, (20.0e0 + 10.0e0 * l_linenumber) / 111000.0e0 AS dlat, l_discount AS skew,
  l_partkey % 3 = 0 AS l_shape, l_suppkey % 4 = 0 AS has_exclusion,
  2.0e0 + (l_partkey % 5) * 0.25e0 AS row_spacing_m, 0.8e0 + (l_suppkey % 5) * 0.1e0 AS plant_spacing_m,
  cast((l_orderkey * 7) % 180 AS double) AS orientation_deg,
  CASE l_linenumber % 3 WHEN 0 THEN 6.0e0 WHEN 1 THEN NULL ELSE 3.0e0 END AS headland_width_m, 4.5e0 AS post_spacing_m,
  CASE WHEN l_linestatus = 'F' THEN 'planted' ELSE 'planned' END AS planting_status,
  l_orderkey % 211 = 0 AND l_linenumber = 1 AS terrain_invalid,
  cast(l_quantity * 20 AS int) AS simulated_plants, cast(ceil(l_quantity * 20 / 25) * 25 AS bigint) AS commercial_plants_25,
  (20.0e0 + 2.0e0 * l_quantity) * (20.0e0 + 10.0e0 * l_linenumber) AS area_m2,
  p_type AS grape_variety, p_brand AS clone_selection, concat('R', cast(p_size % 7 AS string)) AS rootstock
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "profiles": """
SELECT c_custkey AS user_id, c_name AS display_name,
  CASE WHEN c_custkey % 3 = 0 THEN concat(c_mktsegment, ' ', cast(c_custkey AS string)) END AS company_name,
  CASE WHEN c_custkey % 11 <> 0 THEN concat('C', cast(c_custkey AS string), '@Example.it') END AS email,
  n_name AS municipality, r_name AS region
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE c_custkey % 5 <> 0""",
    "contacts": """
SELECT c_custkey AS contact_id, c_name AS first_name,
  CASE WHEN c_custkey % 3 = 0 THEN concat(c_mktsegment, ' ', cast(c_custkey AS string)) END AS company_name,
  CASE WHEN c_custkey % 11 <> 0 THEN concat('C', cast(c_custkey AS string), '@Example.it') END AS email,
  n_name AS municipality, r_name AS region
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "quote_requests": """
SELECT o_orderkey AS project_id, CASE o_orderkey % 3 WHEN 0 THEN 'sent' WHEN 1 THEN 'pending' ELSE 'failed' END AS delivery_status,
  CASE WHEN o_orderkey % 16 <> 0 THEN concat('Q', cast(o_orderkey AS string)) END AS quote_number, o_orderdate AS created_at
FROM orders WHERE o_orderkey % 8 = 0""",
    "revisions": """
SELECT project_id, n AS revision_number, owner_user_id, cast(cast(created_at AS date) + cast(n AS int) AS timestamp) AS created_at,
  2.0e0 + ((project_id + n) % 4) * 0.25e0 AS row_spacing_m, concat('R', cast((project_id + n) % 3 AS string)) AS rootstock,
  concat('rev ', cast((project_id * n) % 5 AS string)) AS label
FROM projects JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3) AS k ON n <= latest_revision_number""",
    "sync_ops": """
SELECT event_id - CASE WHEN event_id % 13 = 0 AND event_id > 0 THEN 1 ELSE 0 END AS operation_id, user_id AS project_id, ts, event_id AS seq,
  cast(floor(value) AS bigint) % 4 AS expected_version
FROM events""",
    "count_commands": """
SELECT event_id AS op_id, user_id AS count_id, ts,
  CASE event_type WHEN 'signup' THEN 'set' WHEN 'error' THEN 'decrement' ELSE 'increment' END AS action, cast(floor(value) AS bigint) AS set_value
FROM events""",
    "counts_lists": """
SELECT o_orderkey AS list_id, o_custkey AS owner_user_id, CASE WHEN o_orderkey % 2 = 0 THEN 'open' ELSE 'closed' END AS status,
  o_orderdate AS updated_at, CASE WHEN o_orderkey % 19 = 0 THEN o_orderdate END AS deleted_at
FROM orders""",
    "counts_entries": """
SELECT l_orderkey AS list_id, (l_suppkey * 1000000000 + l_partkey * 10 + l_linenumber) * 100 + cast(l_quantity AS bigint) AS client_field_id, l_linenumber AS entry_no,
  CASE l_returnflag WHEN 'A' THEN 'plants' WHEN 'N' THEN 'posts' ELSE 'other' END AS category,
  cast(l_quantity AS bigint) AS quantity, l_suppkey % 2 = 0 AS verified, l_shipdate AS updated_at
FROM lineitem""",
    "submissions": """
SELECT o_orderkey AS submission_id, o_orderkey AS list_id, o_custkey AS owner_user_id, o_orderdate AS created_at FROM orders WHERE o_orderkey % 6 = 1""",
    "production_lots": """
SELECT p_type AS grape_variety, p_brand AS clone_selection, concat('R', cast(p_size % 7 AS string)) AS rootstock, concat('L', cast(p_partkey AS string)) AS lot FROM part""",
    "raster": """
SELECT cast(floor(vec_id / 100) AS bigint) AS model_id, cast(vec_id % 100 AS int) AS j, embedding FROM embeddings""",
}

#: The tables that the views read.
TABLES = ("orders", "lineitem", "part", "customer", "nation", "region", "events", "embeddings")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view; Catalyst prunes what its query doesn't use."""
    sql = VIEWS[name]
    words = set(sql.replace("(", " ").replace(")", " ").replace(",", " ").split())
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in words}
    used |= {v: view(spark, sf_dir, v) for v in VIEWS if v in words and v != name}
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} AS {t} ")
    return spark.sql(sql, **used)


def with_views(sql: str) -> str:
    """The same views as common table expressions before a query, as far as it needs them."""
    need: list[str] = []

    def add(text: str) -> None:
        for v, body in VIEWS.items():
            if v in text and v not in need:
                add(body)
                need.append(v)

    add(sql)
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in need)
    body = sql.strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))


def _placed(corners: Column) -> Column:
    """Points of corners (u, v) in shares of a field's box. The lambda is made once; spelled out for each corner, the points are a method too large for the JVM to compile."""
    return F.transform(corners, lambda c: point(F.col("lon0") + c["u"] * F.col("dlon"), F.col("lat0") + c["v"] * F.col("dlat")))


def _corners(*corners: tuple[Column | float, float]) -> Column:
    return F.array(*[F.struct((u if isinstance(u, Column) else F.lit(u)).alias("u"), F.lit(v).alias("v")) for u, v in corners])


def with_rings(fields: DataFrame) -> DataFrame:
    """project_fields with ``ring`` (closed, a skewed rectangle or an L) and ``exclusions`` (a rectangle, or none)."""
    skew = F.col("skew")
    quad = _corners((0.0, 0.0), (1.0, 0.0), (F.lit(1.0) + skew, 1.0), (skew, 1.0), (0.0, 0.0))
    ell = _corners((0.0, 0.0), (1.0, 0.0), (1.0, 0.5), (0.5, 0.5), (0.5, 1.0), (0.0, 1.0), (0.0, 0.0))
    hole = _placed(_corners((0.2, 0.2), (0.4, 0.2), (0.4, 0.4), (0.2, 0.4), (0.2, 0.2)))
    return fields.withColumns({"ring": _placed(F.when(F.col("l_shape"), ell).otherwise(quad)), "exclusions": F.when(F.col("has_exclusion"), F.array(hole)).otherwise(F.array().cast("array<array<struct<lon:double,lat:double>>>"))})


def with_roads(fields: DataFrame) -> DataFrame:
    """with_rings() with a road across every second field, from beyond one side to beyond the other."""
    a, b, c, d = -0.1, 1.2, 0.45, 0.55
    road = _placed(_corners((a, c), (b, c), (b, d), (a, d), (a, c)))
    return with_rings(fields).withColumn("exclusions", F.when(F.col("display_order") % 2 == 0, F.concat("exclusions", F.array(road))).otherwise(F.col("exclusions")))
