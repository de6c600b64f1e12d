"""The administration dashboard over whole tables: field rows, project and client roll-ups, filters and totals.

Field rows are the grain; every roll-up is one aggregation with map-side combining on the project or client key. Dimension tables join by
plain equi-joins, which Spark broadcasts when its own statistics say that they are small. Deleted projects never enter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions.common import blank_to_null, contains_query, poisoned_sum, text

STATUSES = ("draft", "saved", "pdf_downloaded", "quote_requested", "contacted", "client")


def client_label(company: Column, first: Column, last: Column | None = None) -> Column:
    full = F.trim(F.concat_ws(" ", first, *([last] if last is not None else [])))
    return F.coalesce(blank_to_null(company), blank_to_null(full), F.lit("Da definire"))


def owner_label(kind: Column, owner: Column, username: Column, display: Column) -> Column:
    """Guests are named by the last four digits of their id; others by user name, display name, or a default."""
    digits = F.lpad(F.right(F.regexp_replace(owner.cast("string"), r"\D", ""), F.lit(4)), 4, "0")
    guest = F.when(F.trim(username).rlike(r"(?i)^Guest\d{4,}$"), F.trim(username)).otherwise(F.concat(F.lit("Guest"), digits))
    return F.when(kind == "guest", guest).otherwise(F.coalesce(blank_to_null(username), blank_to_null(display), F.lit("Utente")))


def field_rows(projects: DataFrame, fields: DataFrame, profiles: DataFrame, contacts: DataFrame) -> DataFrame:
    """One row per live field, with labels of its owner and client, its numbers (null where the terrain is invalid) and the searchable text."""
    live = projects.where(F.col("deleted_at").isNull())
    owners = profiles.select(F.col("user_id").alias("owner_user_id"), F.col("display_name").alias("__display"))
    clients = contacts.select(F.col("contact_id").alias("owner_user_id"), F.col("company_name").alias("__company"), F.col("first_name").alias("__first"), "municipality", "region")
    rows = live.join(fields, "project_id").join(owners, "owner_user_id", "left").join(clients, "owner_user_id", "left")
    number = lambda c: F.when(~F.col("terrain_invalid"), F.col(c))
    rows = rows.select(
        F.concat_ws(":", F.col("project_id").cast("string"), F.col("client_field_id").cast("string")).alias("row_id"),
        "project_id",
        F.col("client_field_id").alias("field_id"),
        "display_order",
        "owner_user_id",
        F.col("name").alias("project_name"),
        F.col("public_code").alias("project_code"),
        client_label(F.col("__company"), F.col("__first")).alias("client"),
        owner_label(F.col("owner_kind"), F.col("owner_user_id"), F.lit(None).cast("string"), F.col("__display")).alias("user_label"),
        F.coalesce("municipality", F.lit("")).alias("municipality"),
        F.when(F.col("planting_status") == "planted", "planted").otherwise("planned").alias("planting_status"),
        "label",
        "grape_variety",
        "clone_selection",
        "rootstock",
        "terrain_invalid",
        number("area_m2").alias("area_m2"),
        number("simulated_plants").alias("calculated_plants"),
        number("commercial_plants_25").alias("commercial_plants"),
        "environment",
        "status",
        "owner_kind",
        "origin",
        F.col("campaign_year").alias("year"),
    )
    searched = ["project_code", "project_name", "label", "client", "user_label", "municipality", "grape_variety", "clone_selection", "rootstock"]
    return rows.withColumn("search_text", F.concat_ws(" ", *[text(F.col(c)) for c in searched]))


def filter_rows(rows: DataFrame, query: str = "", planting_status: str = "", environment: str = "", status: str = "", owner_kind: str = "", origin: str = "", year_from: int = 0, year_to: int = 0, min_area: float = 0, min_plants: float = 0) -> DataFrame:
    """The dashboard's row filter; empty values don't filter."""
    keep = F.lit(True)
    if query.strip():
        keep = keep & contains_query(F.col("search_text"), query)
    for name, value in (("planting_status", planting_status), ("environment", environment), ("status", status), ("owner_kind", owner_kind), ("origin", origin)):
        if value.strip():
            keep = keep & (text(F.col(name)) == value.strip().lower())
    if year_from:
        keep = keep & (F.coalesce("year", F.lit(0)) >= year_from)
    if year_to:
        keep = keep & (F.coalesce("year", F.lit(0)) <= year_to)
    if min_area:
        keep = keep & (F.coalesce("area_m2", F.lit(0)) >= min_area)
    if min_plants:
        keep = keep & (F.coalesce("commercial_plants", F.lit(0)) >= min_plants)
    return rows.where(keep)


def project_totals(rows: DataFrame) -> DataFrame:
    bad = F.col("terrain_invalid")
    return rows.groupBy("project_id").agg(F.count("*").alias("field_count"), poisoned_sum(F.col("area_m2"), bad).alias("area_m2"), poisoned_sum(F.col("commercial_plants"), bad).alias("commercial_plants"))


def project_rollup(projects: DataFrame, rows: DataFrame, quotes: DataFrame) -> DataFrame:
    """Per live project: fields, area and plants (null if any field's terrain is invalid), and its sent quote, the first with a number."""
    sent = quotes.where(F.col("delivery_status") == "sent").groupBy("project_id").agg(F.min_by("quote_number", F.when(F.col("quote_number").isNotNull(), F.struct("created_at", "quote_number"))).alias("quote_number"), F.lit(True).alias("__sent"))
    live = projects.where(F.col("deleted_at").isNull()).select("project_id", F.col("public_code").alias("code"), "name", "status", "environment", F.col("campaign_year").alias("year"))
    out = live.join(project_totals(rows), "project_id", "left").join(sent, "project_id", "left")
    empty = F.col("field_count").isNull()
    return out.select(
        "project_id", "code", "name", "status", "environment", "year",
        F.coalesce("field_count", F.lit(0)).alias("field_count"),
        F.when(empty, 0.0).otherwise(F.col("area_m2")).alias("area_m2"),
        F.when(empty, 0).otherwise(F.col("commercial_plants")).alias("commercial_plants"),
        F.coalesce("__sent", F.lit(False)).alias("quote_requested"),
        F.coalesce("quote_number", F.lit("")).alias("quote_number"),
    )


def client_key(projects: DataFrame, profiles: DataFrame, contacts: DataFrame) -> DataFrame:
    """Live projects with the key of their client: the owner with a profile, else the e-mail, else the contact."""
    known = profiles.select(F.col("user_id").alias("owner_user_id"), F.lit(True).alias("__known"))
    mail = contacts.select(F.col("contact_id").alias("owner_user_id"), text(F.col("email")).alias("__mail"))
    out = projects.where(F.col("deleted_at").isNull()).join(known, "owner_user_id", "left").join(mail, "owner_user_id", "left")
    owner = F.col("owner_user_id").cast("string")
    key = F.when(F.col("__known"), F.concat(F.lit("owner:"), owner)).when(F.col("__mail") != "", F.concat(F.lit("email:"), F.col("__mail"))).otherwise(F.concat(F.lit("contact:"), owner))
    return out.withColumn("client_key", key).drop("__known", "__mail")


def client_rollup(projects: DataFrame, rows: DataFrame, profiles: DataFrame, contacts: DataFrame) -> DataFrame:
    """Per client: projects, fields, area, plants, and plants still to be planted. Fields are summed per project first."""
    keyed = client_key(projects, profiles, contacts).select("project_id", "client_key")
    bad, planned = F.col("terrain_invalid"), F.col("planting_status") == "planned"
    per = rows.groupBy("project_id").agg(
        F.count("*").alias("fields"), F.sum("area_m2").alias("area"), F.sum("commercial_plants").alias("plants"), F.bool_or(bad).alias("bad"),
        F.sum(F.when(planned, F.col("commercial_plants"))).alias("open"), F.bool_or(bad & planned).alias("bad_open"),
    )
    return keyed.join(per, "project_id", "left").groupBy("client_key").agg(
        F.count("*").alias("project_count"), F.coalesce(F.sum("fields"), F.lit(0)).alias("field_count"),
        poisoned_sum(F.col("area"), F.col("bad")).alias("area_m2"), poisoned_sum(F.col("plants"), F.col("bad")).alias("commercial_plants"), poisoned_sum(F.col("open"), F.col("bad_open")).alias("plants_to_plant"),
    )


def kpis(rows: DataFrame, project_rows: DataFrame, client_rows: DataFrame) -> DataFrame:
    """The dashboard's six totals, in one row."""
    bad, planned = F.col("terrain_invalid"), F.col("planting_status") == "planned"
    a = rows.agg(F.count("*").alias("total_fields"), poisoned_sum(F.when(planned, F.col("commercial_plants")), bad & planned).alias("plants_to_plant"), poisoned_sum(F.col("area_m2"), bad).alias("archive_area_m2"))
    b = project_rows.agg(F.count("*").alias("total_projects"), F.count_if("quote_requested").alias("quote_requests"))
    c = client_rows.agg(F.count("*").alias("total_clients"))
    one = F.lit(1).alias("k")
    return a.select("*", one).join(b.select("*", one), "k").join(c.select("*", one), "k").drop("k")


def filter_projects(projects: DataFrame, rows: DataFrame, environment: str = "", status: str = "", grape_variety: str = "", zone: str = "", rootstock: str = "", owner_kind: str = "", owner_user_id: str = "", origin: str = "", campaign_year: int = 0, min_plants: float = 0, min_area: float = 0, created_from: str | None = None, created_to: str | None = None, include_deleted: bool = False) -> DataFrame:
    """Projects by their own columns or by any of their fields; dates include the last day."""
    keep = F.lit(True) if include_deleted else F.col("deleted_at").isNull()
    for name, value in (("environment", environment), ("status", status), ("owner_kind", owner_kind), ("origin", origin)):
        if value.strip():
            keep = keep & (text(F.col(name)) == value.strip().lower())
    if owner_user_id.strip():
        keep = keep & (F.col("owner_user_id").cast("string") == owner_user_id.strip())
    if created_from:
        keep = keep & (F.col("created_at") >= F.lit(created_from).cast("timestamp"))
    if created_to:
        keep = keep & (F.col("created_at") < F.lit(created_to).cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    any_has = lambda c, v: F.bool_or(text(F.col(c)).contains(v.strip().lower()))
    per = rows.groupBy("project_id").agg(
        any_has("grape_variety", grape_variety).alias("__variety"), any_has("municipality", zone).alias("__zone"), any_has("rootstock", rootstock).alias("__rootstock"),
        F.bool_or(F.col("year") == campaign_year).alias("__year"), F.sum("commercial_plants").alias("__plants"), F.sum("area_m2").alias("__area"),
    )
    out = projects.where(keep).join(per, "project_id", "left")
    for value, flag in ((grape_variety, "__variety"), (zone, "__zone"), (rootstock, "__rootstock")):
        if value.strip():
            out = out.where(F.coalesce(flag, F.lit(False)))
    if campaign_year:
        out = out.where((F.col("campaign_year") == campaign_year) | F.coalesce("__year", F.lit(False)))
    if min_plants:
        out = out.where(F.coalesce("__plants", F.lit(0)) >= min_plants)
    if min_area:
        out = out.where(F.coalesce("__area", F.lit(0.0)) >= min_area)
    return out.select(*projects.columns)


def chain(projects: DataFrame, rows: DataFrame, clients: DataFrame, **filters) -> DataFrame:
    """The dashboard's filter chain: filtered field rows, and only the projects and clients that they leave."""
    kept = filter_rows(rows, **filters)
    left = projects.join(kept.select("project_id").distinct(), "project_id", "left_semi")
    return left.join(clients.select("project_id", "client_key"), "project_id").groupBy("client_key").agg(F.count("*").alias("projects"))


def summary(projects: DataFrame, rows: DataFrame) -> DataFrame:
    """Counts by condition and totals over all projects, deleted ones too."""
    per = rows.groupBy("project_id").agg(F.sum(F.coalesce("commercial_plants", F.lit(0))).alias("__plants"), F.sum(F.coalesce("area_m2", F.lit(0.0))).alias("__area"))
    return projects.join(per, "project_id", "left").agg(
        F.count("*").alias("total_projects"), F.count_if(F.col("status") == "quote_requested").alias("quote_requests"), F.count_if(F.col("status") == "client").alias("clients"),
        F.count_if(F.col("owner_kind") == "guest").alias("guest_projects"), F.count_if(F.col("owner_kind") == "user").alias("registered_projects"), F.count_if(F.col("origin") == "imported").alias("imported_projects"),
        F.coalesce(F.sum("__plants"), F.lit(0)).alias("total_plants"), F.coalesce(F.sum("__area"), F.lit(0.0)).alias("total_area_m2"),
    )


def report_summary(rows: DataFrame) -> DataFrame:
    """Per project: null-poisoned totals and the lists of varieties and rootstocks in order of first appearance."""
    seen = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("display_order", "field_id", c))), lambda s: s[c]))
    bad = F.col("terrain_invalid")
    return rows.groupBy("project_id").agg(
        poisoned_sum(F.col("area_m2"), bad).alias("area_m2"), poisoned_sum(F.col("calculated_plants"), bad).alias("calculated_plants"), seen("grape_variety").alias("varieties"), seen("rootstock").alias("rootstocks")
    )


def recent(projects: DataFrame, contacts: DataFrame, limit: int = 500) -> DataFrame:
    """The newest live projects with their contact; Spark plans a top-k per partition, not a full sort."""
    people = contacts.select(F.col("contact_id").alias("owner_user_id"), "company_name", "email")
    top = projects.where(F.col("deleted_at").isNull()).orderBy(F.desc("created_at"), "project_id").limit(limit)
    return top.join(people, "owner_user_id", "left").select("project_id", "public_code", "created_at", "company_name", "email")


def owned(projects: DataFrame, owner: int, environment: str) -> DataFrame:
    """An owner's live projects in one environment."""
    return projects.where((F.col("owner_user_id") == owner) & (F.col("environment") == environment) & F.col("deleted_at").isNull())


def fields_in_projects(projects: DataFrame, fields: DataFrame) -> DataFrame:
    """Projects with their fields nested in display order, empty where they have none."""
    nested = fields.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("display_order", "client_field_id", "label"))).alias("field_plans"))
    none = F.array().cast("array<struct<display_order:int,client_field_id:bigint,label:string>>")
    return projects.join(nested, "project_id", "left").withColumn("field_plans", F.coalesce("field_plans", none))


def exploded(nested: DataFrame) -> DataFrame:
    """The inverse: a row per embedded field with its index; projects without fields get one row, if they have an outline of their own."""
    legacy = F.array(F.struct(F.lit(1).alias("display_order"), F.lit(0).cast("long").alias("client_field_id"), F.lit("Campo").alias("label")))
    plans = F.when((F.size("field_plans") == 0) & (F.col("project_id") % 2 == 0), legacy).otherwise(F.col("field_plans"))
    return nested.select("project_id", F.posexplode(plans).alias("index", "f")).select("project_id", "index", "f.client_field_id", "f.label")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that is last in order, without sorting a group."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")


def page(rows: DataFrame, id_col: str, cursor: int | None, size: int) -> DataFrame:
    """A keyset page: the first rows after the cursor in order of id, and whether more follow (their cursor is the last id)."""
    n = max(1, min(100, size))
    after = rows.where(F.col(id_col) > cursor) if cursor is not None else rows
    got = after.orderBy(id_col).limit(n + 1)
    every = Window.partitionBy()
    more = F.count("*").over(every) > n
    return got.select("*", F.row_number().over(every.orderBy(id_col)).alias("__n"), more.alias("has_more")).where(F.col("__n") <= n).drop("__n")


def top_lists(lists: DataFrame, entries: DataFrame, n_lists: int = 5, n_entries: int = 5) -> DataFrame:
    """Each owner's most recent live lists, and the most recent entries of each."""
    by_owner = Window.partitionBy("owner_user_id").orderBy(F.desc("updated_at"), "list_id")
    top = lists.where(F.col("deleted_at").isNull()).withColumn("list_rank", F.row_number().over(by_owner)).where(F.col("list_rank") <= n_lists)
    by_list = Window.partitionBy("list_id").orderBy(F.desc("updated_at"), "entry_no", "client_field_id")
    first = entries.select("list_id", "client_field_id", "entry_no", "quantity", F.row_number().over(by_list).alias("entry_rank")).where(F.col("entry_rank") <= n_entries)
    return top.select("list_id", "owner_user_id", "list_rank").join(first, "list_id")
