"""Queries of the checks, labels and look-ups, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions import geo
from terraloom.operators import catalog as c
from terraloom.operators import folds, planting, records
from terraloom.plans.planting import _RING
from terraloom.sources.views import view, with_rings, with_views

KEY = ["project_id", "client_field_id"]


def _s(x: str) -> Column:
    return F.col(x).cast("string")


def _people(s: SparkSession, sf: str) -> DataFrame:
    """Contacts with gaps: no last name, blank telephones, malformed addresses."""
    k = F.col("contact_id")
    return view(s, sf, "contacts").select(
        "contact_id", F.when(k % 17 != 0, F.concat(F.lit(" "), "first_name")).alias("first_name"), F.when(k % 13 == 0, "  ").otherwise("Rossi").alias("last_name"), "company_name",
        F.when(k % 7 != 0, F.concat(F.lit("0171-"), k.cast("string"))).alias("phone"), F.when(k % 5 == 0, F.concat("email", F.lit(" x"))).otherwise(F.col("email")).alias("email"),
    )


def _recipients(s: SparkSession, sf: str) -> DataFrame:
    p = view(s, sf, "projects").select("project_id", "owner_user_id")
    people = view(s, sf, "contacts").select("contact_id", F.when(F.col("contact_id") % 2 == 0, "0").otherwise(F.col("company_name")).alias("company_name"), "first_name", F.when(F.col("contact_id") % 4 != 0, F.col("email")).alias("email"))
    contacts = p.where("project_id % 3 <> 0").join(people, F.col("owner_user_id") == F.col("contact_id")).drop("owner_user_id", "contact_id")
    f = view(s, sf, "project_fields").select("project_id", "display_order", F.when(F.col("display_order") != 4, F.when(F.col("project_id") % 2 == 0, "Alba").otherwise(F.upper("clone_selection"))).alias("municipality"), F.lit("CN").alias("province"))
    return c.recipients(p.select("project_id", "owner_user_id"), contacts, view(s, sf, "profiles"), f)


def _groups(s: SparkSession, sf: str) -> DataFrame:
    p = view(s, sf, "projects")
    people = view(s, sf, "contacts").select(F.col("contact_id").alias("owner_user_id"), "company_name", "first_name")
    contacts = p.where("project_id % 4 <> 0").select("project_id", "owner_user_id").join(people, "owner_user_id").drop("owner_user_id")
    return c.owner_groups(p, view(s, sf, "profiles").withColumn("display_name", F.when(F.col("user_id") % 2 == 0, F.col("display_name"))), contacts)


def _addresses(s: SparkSession, sf: str) -> DataFrame:
    f = view(s, sf, "project_fields")
    n, o = _s("display_order"), F.col("display_order")
    a = F.when(o % 4 == 0, F.concat(F.lit("Via Roma "), n, F.lit(", 12051 Alba (CN), Italia"))).when(o % 4 == 1, F.concat(F.lit("Via Po "), n, F.lit(", 10100, Torino (TO), ITA"))).when(o % 4 == 2, F.concat(F.lit(" Corso "), n, F.lit(" , Asti, AT"))).otherwise(F.concat(F.lit("Borgo "), n))
    return f.select(*KEY, c.address_parts(a).alias("a")).select(*KEY, "a.*")


def _titles(s: SparkSession, sf: str) -> DataFrame:
    e = view(s, sf, "counts_entries")
    q = F.col("quantity")
    given = {"variety_label": F.when(q % 2 == 0, F.lit(" barbera")), "rootstock_label": F.when(q % 3 == 0, F.lit("k5bb")), "post_type": F.when(q % 2 == 0, F.lit("testata")), "post_material": F.when(q % 5 == 0, F.lit("")).otherwise("acciaio"), "component_type": F.when(q % 4 == 0, F.lit("tiranti"))}
    return e.select("list_id", "client_field_id", c.reading_title(given, F.col("category")).alias("title"))


def _nested(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    f = view(s, sf, "project_fields").select("project_id", "display_order", F.struct(F.col("client_field_id"), F.lit("").alias("municipality"), F.lit("").alias("province"), F.lit("").alias("region")).alias("f"))
    nested = f.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("display_order", F.col("f.client_field_id").alias("k"), "f"))), lambda x: x["f"]).alias("field_plans"))
    nested = nested.select("project_id", "field_plans", *[F.lit("?").alias(x) for x in ("municipality", "province", "region")])
    patches = view(s, sf, "project_fields").where("display_order % 3 = 1").select(*KEY, F.concat(F.lit("M"), _s("display_order")).alias("municipality"), F.lit("CN").alias("province"), F.lit("Piemonte").alias("region"))
    return nested, patches


def _located(s: SparkSession, sf: str) -> DataFrame:
    out = c.located(*_nested(s, sf))
    return out.select("project_id", "municipality", "region", F.array_join(F.transform("field_plans", lambda x: x["municipality"]), "|").alias("fields"))


def _material(s: SparkSession, sf: str) -> DataFrame:
    f = view(s, sf, "project_fields").select(*KEY, "grape_variety", F.when(F.col("display_order") == 2, "Brand#99").when(F.col("display_order") != 3, F.col("clone_selection")).alias("clone_selection"), F.when(F.col("display_order") != 5, F.col("rootstock")).alias("rootstock"))
    return c.known_material(f, view(s, sf, "production_lots").where("clone_selection NOT LIKE '%3'"), KEY)


def _references(s: SparkSession, sf: str) -> DataFrame:
    f = view(s, sf, "project_fields")
    base = f.select("project_id", "client_field_id", F.upper("grape_variety").alias("municipality"), F.lit(None).cast("string").alias("section"), F.col("rootstock").alias("sheet"), F.lit("1 ").alias("parcel"), F.when(F.col("display_order") % 2 == 0, F.concat(F.lit("k"), _s("display_order"))).alias("lookup_key"))
    return c.merged_references(base.where("client_field_id % 3 = 0"), base.where("client_field_id % 3 <> 0").withColumn("municipality", F.lower("municipality")), "project_id", "client_field_id").select(*KEY)


def _codes(s: SparkSession, sf: str) -> DataFrame:
    p = view(s, sf, "projects")
    number = (F.col("project_id") * 2).cast("string")
    # Numbers of more than seven digits stay whole: lpad would cut them to other numbers' codes.
    used = p.where("project_id % 3 <> 0").select(F.concat(F.lit("VO-"), F.lpad(number, F.greatest(F.lit(7), F.length(number)), F.lit("0"))).alias("code"))
    return c.allocated_codes(p.where("project_id % 3 = 0").select("project_id", "created_at"), used, ["created_at", "project_id"]).select("project_id", "code")


def _controls(s: SparkSession, sf: str) -> DataFrame:
    e = view(s, sf, "counts_entries")
    pts = e.select(F.col("list_id").alias("field"), "client_field_id", F.concat(F.lit("segment:"), "category").alias("tract"), (F.col("quantity") / 40 - 0.1).alias("position"), (F.col("quantity") * 5.0 - 120).alias("offset_m"))
    out = c.curve_controls(pts, "field", "client_field_id", most=8, edge=0.02, reach=500.0, tract="tract")
    return out.select("field", F.size("controls").alias("n"), F.round(F.element_at("controls", 1)["position"], 6).alias("first"), F.round(F.element_at("controls", -1)["offset_m"], 6).alias("last_offset"))


def _clean(s: SparkSession, sf: str) -> DataFrame:
    f = with_rings(view(s, sf, "project_fields"))
    dirty = F.concat(F.slice("ring", 1, 2), F.slice("ring", 2, 1), F.slice("ring", F.lit(3), F.size("ring") - 3))
    out = f.select(*KEY, "ring", geo.clean_ring(dirty).alias("clean")).select(*KEY, "ring", "clean", geo.drop_vertex(F.col("clean"), F.lit(1)).alias("less"))
    return out.select(*KEY, (F.col("clean") == F.col("ring")).alias("same"), F.size("less").alias("n_less"))


def _media(s: SparkSession, sf: str) -> DataFrame:
    e = s.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("user_id").alias("owner_user_id"), "ts", F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "pending").otherwise("ready").alias("status"))
    return records.media_listing(e.withColumnRenamed("event_id", "media_id").withColumnRenamed("ts", "created_at"), 12, True)


def _notes(s: SparkSession, sf: str) -> DataFrame:
    e = s.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("user_id").alias("project_id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "error", "  ").otherwise(F.concat(F.lit(" "), "event_type")).alias("body")).withColumnRenamed("event_id", "note_id")
    old, new = e.where("note_id % 2 = 0 AND trim(body) <> ''"), e.where("note_id % 2 = 1")
    return records.with_notes(old, new).select("project_id", "note_id", "body", "place")


def _p(s: SparkSession, sf: str) -> DataFrame:
    return view(s, sf, "projects")


def _f(s: SparkSession, sf: str) -> DataFrame:
    return view(s, sf, "project_fields")


def _place(s: SparkSession, sf: str) -> DataFrame:
    o = F.col("display_order")
    row = {"city": F.when(o % 4 == 0, " Alba ").otherwise(" "), "district": F.when(o % 4 == 1, "Langa"), "neighborhood": F.when(o % 4 == 2, F.col("rootstock")), "province": F.lit(" CN"), "region": F.lit("")}
    return _f(s, sf).select(*KEY, records.location(row).alias("l")).select(*KEY, "l.*")


def _polylines(s: SparkSession, sf: str) -> DataFrame:
    e = view(s, sf, "counts_entries").select("list_id", "client_field_id", F.col("quantity").cast("double").alias("x"), F.col("entry_no").cast("double").alias("y"))
    return planting.polyline_lengths(e, ["list_id"], "client_field_id").withColumn("length_m", F.round("length_m", 6))


def _normal_soil(s: SparkSession, sf: str) -> DataFrame:
    """Profiles with unknown layers, gaps, long and padded texts, numbers out of range or with signs of per cent."""
    o, k = F.col("display_order"), F.col("project_id") % 10
    raw = view(s, sf, "project_fields").select(
        *KEY, F.when(o % 3 == 0, "texture").when(o % 3 == 1, "other").alias("layer"), F.when(o % 4 == 0, "  ").when(o % 4 == 1, F.concat(F.lit(" \t"), F.repeat("label", 60))).alias("description"),
        F.when(k < 5, F.concat(F.lit("\n"), "grape_variety", F.lit(" "))).alias("texture"), F.lit(None).cast("string").alias("soil_type"), F.when(k < 8, F.col("rootstock")).alias("soil_unit"), F.repeat(_s("display_order"), 90).alias("code"),
        (o * 3 - 4).alias("samples"), F.when(k == 1, "2024-01-02").alias("retrieved_at"), F.when(k < 3, "2020-05-06").alias("observed_at"), F.lit(None).cast("string").alias("geometry_signature"),
        F.lit(" ").alias("limestone"), F.col("clone_selection").alias("organic_matter"), F.lit(None).cast("string").alias("skeleton"), F.lit(None).cast("string").alias("drainage"), F.lit(None).cast("string").alias("reaction"),
        F.concat(k.cast("string"), F.lit(",5 %")).alias("sand"), (o * 25).alias("silt"), F.concat(F.lit("-"), k.cast("string")).alias("clay"), F.concat((k * 2).cast("string"), F.lit(".0")).alias("ph"),
        F.when(o % 2 == 0, F.array(F.struct(F.col("rootstock").alias("description"), F.lit(None).cast("string").alias("code")), F.struct(F.lit("").alias("description"), F.lit("x").alias("code")))).alias("units"),
    )
    return c.normal_soil(raw, KEY).select(*KEY, "layer", "description", "code", "samples", "retrieved_at", "texture", "soil_unit", "limestone", "organic_matter", "sand", "silt", "clay", "ph", F.size("units").alias("n_units"))


QUERIES = {
    "f10_normal_soil": _normal_soil,
    "s3_scan": lambda s, sf: _f(s, sf).select(*KEY, "label").orderBy(*KEY),
    "s5_notes": _notes,
    "s15_media": _media,
    "p9_displayable": lambda s, sf: with_rings(_f(s, sf)).select(*KEY, c.displayable(F.when(F.col("display_order") == 2, F.slice("ring", 1, 3)).when(F.col("display_order") != 3, F.col("ring"))).alias("valid")),
    "p10_status_update": lambda s, sf: records.status_updates(_p(s, sf).select("project_id", "status", "version"), _p(s, sf).where("project_id % 2 = 0").select("project_id", F.when(F.col("project_id") % 4 == 0, "contacted").otherwise("lost").alias("wanted"), (F.col("version") - (F.col("project_id") % 3 == 0).cast("int")).alias("expected"))),
    "p17_location": _place,
    "p18_located_fields": _located,
    "p20_quote_contacts": lambda s, sf: c.quote_contacts(_people(s, sf), "contact_id"),
    "p21_reading_titles": _titles,
    "p22_field_names": lambda s, sf: c.field_names(_f(s, sf).withColumns({"customised": F.col("client_field_id") % 3 == 0, "grape_variety": F.when(F.col("client_field_id") % 5 != 1, F.col("grape_variety")), "rootstock": F.when(F.col("client_field_id") % 5 > 2, F.col("rootstock"))}), KEY),
    "p23_recipients": _recipients,
    "p24_missing_fields": lambda s, sf: c.missing_fields(_people(s, sf), "contact_id"),
    "p26_address_parts": _addresses,
    "p27_unplaced": lambda s, sf: c.unplaced(with_rings(_f(s, sf)).withColumn("municipality", F.when(F.col("display_order") % 2 == 0, "Alba").otherwise(" ")), KEY),
    "j12_municipalities": lambda s, sf: c.named_municipalities(_f(s, sf).select(*KEY, F.col("clone_selection").alias("municipality_code")), view(s, sf, "production_lots").where("clone_selection LIKE '%1'").select(F.col("clone_selection").alias("code"), F.lower("clone_selection").alias("name")).distinct()),
    "j19_owner_groups": _groups,
    "j20_merged_references": _references,
    "a8_project_summary": lambda s, sf: c.project_summary(with_rings(_f(s, sf)).withColumn("ring", F.when(F.col("display_order") != 3, F.col("ring")))).withColumn("area_m2", F.round("area_m2", 2)),
    "a12_integrity": lambda s, sf: c.integrity(view(s, sf, "counts_entries").select("list_id", "entry_no"), _f(s, sf).where("clone_selection NOT LIKE '%4'").select(F.col("project_id").alias("list_id"), F.col("display_order").alias("entry_no")), "list_id", "entry_no"),
    "a15_weighted_median": lambda s, sf: c.weighted_lower_median(_f(s, sf).withColumn("weight", (F.col("area_m2") - 1000).cast("double")), ["project_id"], "row_spacing_m", "weight", "client_field_id"),
    "a16_bounding_boxes": lambda s, sf: _rounded(c.bounding_boxes(with_rings(_f(s, sf)), "project_id"), 7, "west", "east", "south", "north"),
    "a17_stale_drafts": lambda s, sf: _p(s, sf).where("owner_kind = 'guest' AND status = 'draft' AND deleted_at IS NULL AND updated_at < timestamp'2001-01-01' - interval 90 days").agg(F.count("*").alias("n")),
    "a19_known_material": _material,
    "o1_pending_operations": lambda s, sf: view(s, sf, "sync_ops").select("operation_id", "seq", "ts").orderBy("ts", F.col("operation_id").cast("string")).select("operation_id", "seq"),
    "o3_list_page": lambda s, sf: view(s, sf, "counts_lists").where("deleted_at IS NULL AND status = 'open'").join(view(s, sf, "counts_entries").where("verified"), "list_id", "left_semi").orderBy(F.desc("updated_at"), "list_id").limit(50).select("list_id", "updated_at"),
    "o4_natural_order": lambda s, sf: view(s, sf, "production_lots").select("clone_selection", "rootstock", c.numeric_key(F.concat_ws(" ", "clone_selection", F.upper("rootstock"))).alias("k")).distinct().orderBy("k"),
    "d4_last_parcels": lambda s, sf: c.last_of_each(_f(s, sf).select("grape_variety", "client_field_id", "label"), "grape_variety", "client_field_id"),
    "d6_curve_controls": _controls,
    "f11_counter_step": lambda s, sf: view(s, sf, "count_commands").select("op_id", F.when(F.col("action") == "set", F.col("set_value")).when(F.col("action") == "increment", F.col("set_value") % 3 + 1).otherwise(F.greatest(F.col("set_value") % 3 - 1, F.lit(0))).alias("quantity")),
    "f12_stable_json": lambda s, sf: _f(s, sf).select(*KEY, records.stable_json(F.create_map(F.lit("rootstock"), F.col("rootstock"), F.lit("clone"), F.col("clone_selection"), F.lit("Label"), F.col("label"))).alias("canonical")).select(*KEY, "canonical", F.sha2("canonical", 256).alias("digest")),
    "f15_public_codes": _codes,
    "g20_clean_rings": _clean,
    "w5_polyline_lengths": _polylines,
    "w9_quote_limit": lambda s, sf: folds.sliding_window(s.read.parquet(f"{sf}/events.parquet").where("event_type = 'purchase'").select("user_id", "ts"), "user_id", "ts", 20 * 86_400, 3),
    "st8_expiry": lambda s, sf: records.expired(_p(s, sf).select("project_id", "deleted_at"), "deleted_at", F.lit("2001-01-01").cast("timestamp"), 30),
}


def _rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({x: F.round(x, digits) for x in cols})


_PEOPLE = """people AS (SELECT contact_id, CASE WHEN contact_id % 17 <> 0 THEN first_name ELSE '' END AS first_name, CASE WHEN contact_id % 13 = 0 THEN '' ELSE 'Rossi' END AS last_name, coalesce(company_name, '') AS company_name,
  CASE WHEN contact_id % 7 <> 0 THEN concat('0171-', CAST(contact_id AS VARCHAR)) ELSE '' END AS phone, coalesce(lower(CASE WHEN contact_id % 5 = 0 THEN email || ' x' ELSE email END), '') AS email FROM contacts)"""
_LACKS = "[CASE WHEN first_name = '' THEN 'Nome' END, CASE WHEN last_name = '' THEN 'Cognome' END, CASE WHEN phone = '' THEN 'Telefono' END, CASE WHEN NOT regexp_full_match(email, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') THEN 'E-mail' END]"
_K = "project_id, client_field_id"
_SQL = {
    "f10_normal_soil": """WITH t AS (SELECT *, project_id % 10 AS k, display_order AS o FROM project_fields),
      d AS (SELECT *, CASE WHEN o % 4 = 0 THEN '' WHEN o % 4 = 1 THEN left(repeat(label, 60), 250) WHEN k < 5 THEN grape_variety WHEN k < 8 THEN rootstock END AS said FROM t)
      SELECT project_id, client_field_id, CASE WHEN o % 3 = 0 THEN 'texture' ELSE 'soil' END AS layer, said AS description, repeat(CAST(o AS VARCHAR), 80) AS code, CAST(CASE o WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 5 WHEN 4 THEN 8 ELSE 9 END AS DOUBLE) AS samples,
        CASE WHEN k = 1 THEN '2024-01-02' WHEN k < 3 THEN '2020-05-06' ELSE '' END AS retrieved_at, CASE WHEN k < 5 THEN grape_variety END AS texture, CASE WHEN k < 8 THEN rootstock END AS soil_unit, CAST(NULL AS VARCHAR) AS limestone, clone_selection AS organic_matter,
        k + 0.5e0 AS sand, CASE WHEN o <= 4 THEN o * 25e0 END AS silt, CAST(NULL AS DOUBLE) AS clay, CASE WHEN k <= 7 THEN k * 2e0 END AS ph, CAST(CASE WHEN o % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_units FROM d WHERE said <> ''""",
    "s3_scan": f"SELECT {_K}, label FROM project_fields",
    "s5_notes": "SELECT user_id AS project_id, event_id AS note_id, CASE WHEN event_id % 2 = 0 THEN ' ' ELSE '' END || event_type AS body, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE event_type <> 'error'",
    "s15_media": "SELECT event_id AS media_id, CASE event_type WHEN 'click' THEN 'pending' ELSE 'ready' END AS status, ts AS created_at FROM events WHERE user_id = 12 AND event_type <> 'error'",
    "p9_displayable": f"SELECT {_K}, display_order NOT IN (2, 3) AS valid FROM project_fields",
    "p10_status_update": "SELECT project_id, CASE WHEN project_id % 4 = 0 AND project_id % 3 <> 0 THEN 'contacted' ELSE status END AS status, CASE WHEN project_id % 2 <> 0 THEN 'untouched' WHEN project_id % 4 <> 0 THEN 'invalid' WHEN project_id % 3 = 0 THEN 'conflict' ELSE 'updated' END AS outcome, CASE WHEN project_id % 4 = 0 AND project_id % 3 <> 0 THEN version + 1 ELSE version END AS version FROM projects",
    "p17_location": f"SELECT {_K}, CASE display_order % 4 WHEN 0 THEN 'Alba' WHEN 1 THEN 'Langa' WHEN 2 THEN rootstock END AS label, CASE WHEN display_order % 4 < 3 THEN 'CN' END AS province, NULL AS region FROM project_fields",
    "p18_located_fields": """WITH f AS (SELECT *, CASE WHEN display_order % 3 = 1 THEN 'M' || CAST(display_order AS VARCHAR) ELSE '' END AS m FROM project_fields)
      SELECT project_id, CASE WHEN count(*) = 1 AND max(m) <> '' THEN max(m) ELSE '?' END AS municipality, CASE WHEN count(*) = 1 AND max(m) <> '' THEN 'Piemonte' ELSE '?' END AS region, string_agg(m, '|' ORDER BY display_order, client_field_id) AS fields FROM f GROUP BY project_id""",
    "p20_quote_contacts": f"WITH {_PEOPLE} SELECT *, list_filter({_LACKS}, lambda x: x IS NOT NULL)[1] AS error FROM people",
    "p21_reading_titles": """WITH q AS (SELECT *, CASE category WHEN 'plants' THEN concat_ws(' · ', CASE WHEN quantity % 2 = 0 THEN 'Barbera' END, CASE WHEN quantity % 3 = 0 THEN 'K5bb' END)
        WHEN 'posts' THEN concat_ws(' · ', CASE WHEN quantity % 2 = 0 THEN 'Testata' END, CASE WHEN quantity % 5 <> 0 THEN 'Acciaio' END) ELSE CASE WHEN quantity % 4 = 0 THEN 'Tiranti' ELSE '' END END AS d FROM counts_entries)
      SELECT list_id, client_field_id, CASE WHEN d <> '' THEN 'Conteggio · ' || d WHEN category = 'plants' THEN 'Conteggio barbatelle' WHEN category = 'posts' THEN 'Conteggio pali' ELSE 'Conteggio di…' END AS title FROM q""",
    "p22_field_names": f"""SELECT {_K}, CASE WHEN client_field_id % 3 = 0 THEN label WHEN client_field_id % 5 = 0 THEN grape_variety WHEN client_field_id % 5 = 2 THEN grape_variety WHEN client_field_id % 5 > 2 THEN grape_variety || ' · ' || rootstock
      ELSE 'Campo ' || CAST(row_number() OVER (PARTITION BY project_id ORDER BY display_order, project_id, client_field_id) AS VARCHAR) END AS name FROM project_fields""",
    "p23_recipients": """WITH f AS (SELECT project_id, display_order, CASE WHEN display_order <> 4 THEN CASE WHEN project_id % 2 = 0 THEN 'Alba' ELSE upper(clone_selection) END END AS m FROM project_fields),
      a AS (SELECT project_id, count(DISTINCT m) AS places, count(m) AS placed, count(*) AS n, arg_min(m, display_order) FILTER (m IS NOT NULL) AS first FROM f GROUP BY project_id)
      SELECT p.project_id, coalesce(CASE WHEN p.project_id % 3 <> 0 AND c.contact_id % 2 <> 0 THEN c.company_name END, r.company_name, '') AS company_name, coalesce(CASE WHEN p.project_id % 3 <> 0 THEN c.first_name END, r.display_name, '') AS first_name,
        coalesce(CASE WHEN p.project_id % 3 <> 0 AND c.contact_id % 4 <> 0 THEN c.email END, r.email, '') AS email, CASE WHEN coalesce(placed, 0) = 0 THEN '' WHEN places = 1 AND placed = n THEN first ELSE 'Località diverse (vedi campi)' END AS plant_location
      FROM projects p LEFT JOIN contacts c ON c.contact_id = p.owner_user_id LEFT JOIN profiles r ON r.user_id = p.owner_user_id LEFT JOIN a ON a.project_id = p.project_id""",
    "p24_missing_fields": f"WITH {_PEOPLE} SELECT contact_id, list_filter({_LACKS}, lambda x: x IS NOT NULL) AS missing FROM people",
    "p26_address_parts": f"""SELECT {_K}, [concat('Via Roma ', n), concat('Via Po ', n), concat('Corso ', n), concat('Borgo ', n)][display_order % 4 + 1] AS street, ['12051', '10100', '', ''][display_order % 4 + 1] AS postal_code, ['Alba', 'Torino', 'Asti', ''][display_order % 4 + 1] AS city,
      ['CN', 'TO', 'AT', ''][display_order % 4 + 1] AS province FROM (SELECT *, CAST(display_order AS VARCHAR) AS n FROM project_fields) f""",
    "p27_unplaced": f"SELECT {_K} FROM project_fields WHERE display_order % 2 <> 0",
    "j12_municipalities": f"SELECT {_K}, clone_selection AS municipality_code, CASE WHEN clone_selection LIKE '%1' THEN lower(clone_selection) ELSE clone_selection END AS municipality FROM project_fields",
    "j19_owner_groups": """WITH n AS (SELECT p.owner_user_id AS owner, p.project_id, p.updated_at, coalesce(r.company_name, CASE WHEN p.project_id % 4 <> 0 THEN c.company_name END, CASE WHEN r.user_id % 2 = 0 THEN r.display_name END, CASE WHEN p.project_id % 4 <> 0 THEN c.first_name END, CASE WHEN owner_kind = 'guest' THEN 'Ospite' ELSE 'Utente' END || ' · ' || public_code) AS name
        FROM projects p LEFT JOIN profiles r ON r.user_id = p.owner_user_id LEFT JOIN contacts c ON c.contact_id = p.owner_user_id WHERE p.deleted_at IS NULL)
      SELECT owner, first(name ORDER BY updated_at DESC, project_id) AS name, count(*) AS projects FROM n GROUP BY owner""",
    "j20_merged_references": """WITH b AS (SELECT *, client_field_id % 3 = 0 AS hand, CASE WHEN display_order % 2 = 0 THEN display_order END AS k FROM project_fields)
      SELECT project_id, client_field_id FROM b x WHERE hand OR NOT EXISTS (SELECT 1 FROM b m WHERE m.hand AND m.project_id = x.project_id AND (m.k = x.k OR (m.grape_variety = x.grape_variety AND m.rootstock = x.rootstock)))
      QUALIFY row_number() OVER (PARTITION BY project_id, grape_variety, rootstock ORDER BY CASE WHEN hand THEN 0 ELSE 1 END, client_field_id) = 1""",
    "a8_project_summary": "SELECT project_id, count(*) AS field_count, round(sum(CASE WHEN display_order <> 3 THEN area_m2 ELSE 0 END), 2) AS area_m2, CASE WHEN NOT bool_or(terrain_invalid) THEN CAST(sum(simulated_plants) AS DOUBLE) END AS plants FROM project_fields WHERE display_order <> 3 OR terrain_invalid GROUP BY project_id",
    "a12_integrity": """WITH a AS (SELECT list_id, entry_no, count(*) AS t FROM counts_entries GROUP BY ALL), p AS (SELECT DISTINCT project_id, display_order FROM project_fields WHERE clone_selection NOT LIKE '%4')
      SELECT list_id, CAST(sum(t) AS BIGINT) AS asked, count(*) AS distinct, count(p.project_id) AS matched, sum(t) = count(*) AND count(p.project_id) = sum(t) AS sound FROM a LEFT JOIN p ON p.project_id = list_id AND p.display_order = entry_no GROUP BY list_id""",
    "a15_weighted_median": """WITH w AS (SELECT project_id, client_field_id, row_spacing_m, area_m2 - 1000 AS weight FROM project_fields WHERE area_m2 > 1000),
      r AS (SELECT *, sum(weight) OVER (PARTITION BY project_id ORDER BY row_spacing_m, client_field_id) AS run, sum(weight) OVER (PARTITION BY project_id) AS total FROM w) SELECT project_id, min(row_spacing_m) AS median FROM r WHERE run >= total / 2 GROUP BY project_id""",
    "a16_bounding_boxes": f"WITH {_RING} SELECT project_id, round(min(lon), 7) AS west, round(max(lon), 7) AS east, round(min(lat), 7) AS south, round(max(lat), 7) AS north FROM g GROUP BY project_id",
    "a17_stale_drafts": "SELECT count(*) AS n FROM projects WHERE owner_kind = 'guest' AND status = 'draft' AND deleted_at IS NULL AND updated_at < TIMESTAMP '2001-01-01' - INTERVAL 90 DAY",
    "a19_known_material": """WITH c AS (SELECT * FROM production_lots WHERE clone_selection NOT LIKE '%3'), f AS (SELECT project_id, client_field_id, grape_variety, CASE WHEN display_order = 2 THEN 'Brand#99' WHEN display_order <> 3 THEN clone_selection END AS cl, CASE WHEN display_order <> 5 THEN rootstock END AS st FROM project_fields)
      SELECT project_id, client_field_id, cl IS NULL OR (grape_variety, cl) IN (SELECT (grape_variety, clone_selection) FROM c) AS clone_known,
        st IS NULL OR CASE WHEN cl IS NOT NULL AND (grape_variety, cl) IN (SELECT (grape_variety, clone_selection) FROM c) THEN (grape_variety, cl, st) IN (SELECT (grape_variety, clone_selection, rootstock) FROM c) ELSE (grape_variety, st) IN (SELECT (grape_variety, rootstock) FROM c) END AS rootstock_known FROM f""",
    "o1_pending_operations": "SELECT operation_id, seq FROM sync_ops",
    "o3_list_page": "SELECT list_id, updated_at FROM counts_lists l WHERE deleted_at IS NULL AND status = 'open' AND EXISTS (SELECT 1 FROM counts_entries e WHERE e.list_id = l.list_id AND verified) ORDER BY updated_at DESC, list_id LIMIT 50",
    "o4_natural_order": "SELECT DISTINCT clone_selection, rootstock, 'brand#' || lpad(substr(clone_selection, 7), 20, '0') || ' r' || lpad(substr(rootstock, 2), 20, '0') AS k FROM production_lots",
    "d4_last_parcels": "SELECT grape_variety, max(client_field_id) AS client_field_id, arg_max(label, client_field_id) AS label FROM project_fields GROUP BY grape_variety",
    "f11_counter_step": "SELECT op_id, CASE action WHEN 'set' THEN set_value WHEN 'increment' THEN set_value % 3 + 1 ELSE greatest(set_value % 3 - 1, 0) END AS quantity FROM count_commands",
    "f12_stable_json": f"""WITH j AS (SELECT {_K}, concat('{{"Label":"', label, '","clone":"', clone_selection, '","rootstock":"', rootstock, '"}}') AS canonical FROM project_fields) SELECT *, sha256(canonical) AS digest FROM j""",
    "f15_public_codes": """WITH u AS (SELECT project_id * 2 AS v FROM projects WHERE project_id % 3 <> 0), free AS (SELECT v, row_number() OVER (ORDER BY v) AS r FROM range(0, (SELECT 4 * count(*) + 10 FROM projects)) t(v) WHERE v NOT IN (SELECT v FROM u)),
      n AS (SELECT project_id, row_number() OVER (ORDER BY created_at, project_id) AS r FROM projects WHERE project_id % 3 = 0) SELECT project_id, 'VO-' || lpad(CAST(v AS VARCHAR), 7, '0') AS code FROM n JOIN free USING (r)""",
    "g20_clean_rings": f"SELECT {_K}, true AS same, CASE WHEN l_shape THEN 6 ELSE 4 END AS n_less FROM project_fields",
    "w5_polyline_lengths": "WITH s AS (SELECT list_id, sqrt((quantity - lag(quantity) OVER w) ** 2 + (entry_no - lag(entry_no) OVER w) ** 2) AS d FROM counts_entries WINDOW w AS (PARTITION BY list_id ORDER BY client_field_id)) SELECT list_id, round(coalesce(sum(d), 0), 6) AS length_m FROM s GROUP BY list_id",
    "w9_quote_limit": """WITH RECURSIVE tries AS (SELECT user_id, epoch_us(ts) AS at_us, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events WHERE event_type = 'purchase'),
      f AS (SELECT user_id, at_us, n, true AS allowed, [at_us] AS rec FROM tries WHERE n = 1
        UNION ALL SELECT a.user_id, a.at_us, a.n, len(list_filter(f.rec, lambda x: x >= a.at_us - 1728000000000)) < 3, CASE WHEN len(list_filter(f.rec, lambda x: x >= a.at_us - 1728000000000)) < 3 THEN list_append(f.rec, a.at_us) ELSE f.rec END FROM f JOIN tries a ON a.user_id = f.user_id AND a.n = f.n + 1)
      SELECT user_id, at_us, allowed FROM f""",
    "st8_expiry": "SELECT project_id, deleted_at FROM projects WHERE deleted_at < TIMESTAMP '2001-01-01' - INTERVAL 30 DAY",
}
ORACLES = {k: with_views(v) for k, v in _SQL.items()}
