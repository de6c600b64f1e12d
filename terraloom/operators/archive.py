"""Set operations, joins and maintenance jobs over projects, counts, revisions and lots: current state and log in, next state out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions.common import blank_to_null, ceil25, finite_or_null, text

CATEGORIES = ("plants", "posts", "other")
PUBLISHED = ("saved", "pdf_downloaded", "quote_requested", "contacted", "client")
#: Accented Latin letters and what they fold to.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def folded(x: Column) -> Column:
    """Lower case without accents, runs of other characters as one blank."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(x.cast("string"), F.lit(""))), *ACCENTS), "[^a-z0-9]+", " "))


def lot_key(variety: Column, clone: Column, rootstock: Column) -> Column:
    return F.concat_ws("|", folded(variety), F.regexp_replace(folded(clone), "^i ", ""), folded(rootstock))


def resolve_lots(fields: DataFrame, lots: DataFrame, key: list[str]) -> DataFrame:
    """Status and lot of each field: unique, ambiguous or unknown by its variety, clone and rootstock."""
    known = lots.groupBy(lot_key(F.col("grape_variety"), F.col("clone_selection"), F.col("rootstock")).alias("k")).agg(F.sort_array(F.collect_set("lot")).alias("candidates"))
    out = fields.select(*key, lot_key(F.col("grape_variety"), F.col("clone_selection"), F.col("rootstock")).alias("k")).join(known, "k", "left")
    n = F.coalesce(F.size("candidates"), F.lit(0))
    return out.select(*key, F.when(n == 1, "unique").when(n > 1, "ambiguous").otherwise("unknown").alias("status"), F.when(n == 1, F.element_at("candidates", 1)).alias("lot"), F.greatest(n, F.lit(0)).alias("n_candidates"))


def by_category(entries: DataFrame, key: str) -> DataFrame:
    """Live items and exact totals, as text, for every key and each of the three categories, zero where there are none."""
    keys = entries.select(key).distinct().select(key, F.explode(F.array(*map(F.lit, CATEGORIES))).alias("category"))
    sums = entries.groupBy(key, "category").agg(F.count("*").alias("items"), F.sum(F.col("quantity").cast("decimal(38,0)")).alias("total"))
    return keys.join(sums, [key, "category"], "left").select(key, "category", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce(F.col("total").cast("string"), F.lit("0")).alias("total"))


def owned_fields(fields: DataFrame, projects: DataFrame, owner: int) -> DataFrame:
    """Fields of an owner's live projects."""
    mine = projects.where((F.col("owner_user_id") == owner) & F.col("deleted_at").isNull())
    return fields.join(mine, "project_id", "left_semi")


def resolve_codes(asked: DataFrame, aliases: DataFrame, projects: DataFrame) -> DataFrame:
    """Project of each public code: the alias's project, or else the one with that code, if it is live and published. An alias that
    leads to another project hides a project's own code even then; texts that are no code give null."""
    own = projects.select(F.col("public_code").alias("__code"), F.col("project_id").alias("by_code"))
    named = aliases.select(F.col("code").alias("__alias"), F.col("project_id").alias("by_alias"))
    key = F.when(public_code_ok(F.upper(F.trim("code"))), F.upper(F.trim("code")))
    met = asked.select("code", key.alias("__key")).join(named, F.col("__key") == F.col("__alias"), "left").join(own, F.col("__key") == F.col("__code"), "left")
    open_ = projects.where(F.col("deleted_at").isNull() & F.col("status").isin(*PUBLISHED)).select(F.col("project_id").alias("open_id"))
    met = met.withColumn("found", F.coalesce("by_alias", "by_code"))
    return met.join(open_, met["found"] == open_["open_id"], "left").select("code", F.col("open_id").alias("project_id"))


def public_code_ok(code: Column) -> Column:
    return F.coalesce(code.rlike("^VO-[0-9]{7}$"), F.lit(False))


def lists_with_flag(lists: DataFrame, submissions: DataFrame) -> DataFrame:
    sent = submissions.select("list_id").distinct().withColumn("submitted", F.lit(True))
    return lists.where(F.col("deleted_at").isNull()).join(sent, "list_id", "left").select("list_id", "status", F.coalesce("submitted", F.lit(False)).alias("submitted"))


def check_snapshots(submissions: DataFrame, sent: DataFrame, live: DataFrame, limit: int = 500) -> DataFrame:
    """Per submission: accepted if it has 1 to limit entries, none twice, each live and unchanged; else what is wrong first."""
    key = ["list_id", "client_field_id", "entry_no"]
    now = live.select(*key, F.col("quantity").alias("now"))
    met = sent.join(now, key, "left").groupBy("submission_id").agg(F.count("*").alias("n"), F.count_distinct(F.struct("client_field_id", "entry_no")).alias("distinct"), F.count_if(F.col("now").isNull()).alias("gone"), F.count_if(F.col("now") != F.col("quantity")).alias("changed"))
    out = submissions.select("submission_id").join(met, "submission_id", "left")
    verdict = F.when(F.coalesce("n", F.lit(0)) == 0, "empty").when(F.col("n") > limit, "too_many").when(F.col("distinct") < F.col("n"), "repeated").when(F.col("gone") > 0, "gone").when(F.col("changed") > 0, "changed").otherwise("accepted")
    return out.select("submission_id", verdict.alias("verdict"), F.coalesce("n", F.lit(0)).alias("n_entries"))


def revision_changes(revisions: DataFrame, groups: dict[str, list[str]], key: str = "project_id", number: str = "revision_number") -> DataFrame:
    """Groups of values (group -> columns) that differ between each revision and the one before it, in the order of groups."""
    w = Window.partitionBy(key).orderBy(number)
    columns = [c for cs in groups.values() for c in cs]
    before = revisions.withColumn("b", F.lag(F.struct(*columns)).over(w)).where(F.col("b").isNotNull())
    differs = {n: ~F.struct(*cs).eqNullSafe(F.struct(*[F.col(f"b.{c}") for c in cs])) for n, cs in groups.items()}
    return before.select(key, number, F.array_compact(F.array(*[F.when(d, F.lit(n)) for n, d in differs.items()])).alias("changed"))


def compare_revisions(fields: DataFrame, other: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Full outer comparison of two field tables: added, removed, changed or same."""
    a = fields.select(*key, F.struct(*values).alias("a"))
    b = other.select(*key, F.struct(*values).alias("b"))
    verdict = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(*key, verdict.alias("verdict"))


def upsert_fields(state: DataFrame, snapshot: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Next state of the fields: listed ones take the snapshot's values where it has them and live again, others get a tombstone."""
    s = state.select(*key, *[F.col(v).alias(f"s_{v}") for v in values], F.lit(True).alias("in_state"))
    n = snapshot.select(*key, *[F.col(v).alias(f"n_{v}") for v in values], F.lit(True).alias("listed"))
    both = s.join(n, key, "full_outer")
    return both.select(*key, *[F.coalesce(f"n_{v}", f"s_{v}").alias(v) for v in values], F.col("listed").isNull().alias("deleted"), F.col("in_state").isNull().alias("inserted"))


def archive_idle(projects: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Guest drafts that nobody has touched for so many days get a deletion date."""
    idle = (F.col("owner_kind") == "guest") & (F.col("status") == "draft") & F.col("deleted_at").isNull() & (F.col("updated_at") < now - F.make_interval(days=F.lit(days)))
    return projects.withColumn("deleted_at", F.when(idle, now).otherwise(F.col("deleted_at")))


def restore(projects: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Deleted projects within the term come back; later ones are refused."""
    gone = F.col("deleted_at").isNotNull()
    good = gone & (F.col("deleted_at") >= now - F.make_interval(days=F.lit(days)))
    return projects.where(gone).select("project_id", F.when(good, "restored").otherwise("refused").alias("outcome"), F.when(good, F.lit(None).cast("timestamp")).otherwise(F.col("deleted_at")).alias("deleted_at"))


def transfer(rows: DataFrame, grants: DataFrame, owner: str = "owner_user_id") -> DataFrame:
    """Rows with the owner replaced where a grant (from_owner, to_owner) says so; each source once, never to itself."""
    one = grants.where(F.col("from_owner") != F.col("to_owner")).groupBy("from_owner").agg(F.min("to_owner").alias("to_owner"))
    return rows.join(one, rows[owner] == one["from_owner"], "left").withColumn(owner, F.coalesce("to_owner", owner)).select(*rows.columns)


def unique_references(refs: DataFrame, owner: str, order: str) -> DataFrame:
    """Cadastral references normalised, the first of each case-folded (municipality, section, sheet, parcel) of an owner."""
    parts = [text(F.col(c)) for c in ("municipality", "section", "sheet", "parcel")]
    w = Window.partitionBy(owner, *parts).orderBy(order)
    return refs.where((parts[0] != "") | (parts[2] != "") | (parts[3] != "")).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def parse_reference(x: Column) -> Column:
    """struct of municipality, section, sheet, attachment, development, parcel of a national cadastral reference; null if it isn't one."""
    pattern = r"^([A-Z0-9]{4})(.)(\d{4})(.)(.)\.([A-Z0-9/_-]+)$"
    v = F.upper(x)
    g = lambda i: F.regexp_extract(v, pattern, i)
    some = lambda i: F.when(~g(i).isin("_", "0"), g(i))
    return F.when(v.rlike(pattern), F.struct(g(1).alias("municipality_code"), some(2).alias("section"), g(3).cast("int").cast("string").alias("sheet"), some(4).alias("attachment"), some(5).alias("development"), g(6).alias("parcel")))


def orientation(x: Column) -> Column:
    """Degrees with a comma or point, clamped to 0..179.9, one decimal; null if not a number."""
    d = F.regexp_replace(F.trim(x.cast("string")), ",", ".").try_cast("double")
    return F.round(F.least(F.greatest(d, F.lit(0.0)), F.lit(179.9)), 1)


def headland(width: Column, mechanised: Column) -> Column:
    """Mechanised plots need at least six metres; a width that is no number or negative counts as none."""
    good = F.when(finite_or_null(width) >= 0, finite_or_null(width))
    return F.when(mechanised, F.greatest(F.coalesce(good, F.lit(6.0)), F.lit(6.0))).otherwise(good)


def advice(fields: DataFrame, key: list[str], mechanised: str = "mechanised", row: str = "row_spacing_m", plant: str = "plant_spacing_m", headland_col: str = "headland_width_m") -> DataFrame:
    """A row per piece of design advice: spacings that are missing or not positive; for mechanised harvest, a missing headland or else a
    machine to verify."""
    positive = lambda c: F.coalesce(finite_or_null(F.col(c)) > 0, F.lit(False))
    by_machine = F.when(positive(headland_col), F.lit("mechanization_verify_machine")).otherwise(F.lit("mechanization_headland_missing"))
    notes = F.array_compact(F.array(F.when(~(positive(row) & positive(plant)), F.lit("spacing_incomplete")), F.when(F.col(mechanised), by_machine)))
    return fields.select(*key, F.explode(notes).alias("advice"))


def count_violations(entries: DataFrame, key: list[str]) -> DataFrame:
    """A row per broken rule of a count entry."""
    rules = {
        "category": ~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)),
        "quantity": ~F.coalesce(F.col("quantity").between(0, 2**53 - 1), F.lit(False)),
        "field": F.col("verified") & F.col("client_field_id").isNull(),
    }
    return entries.select(*key, F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules.items()]))).alias("violation"))


def retries(ops: DataFrame) -> DataFrame:
    """Attempts of each queued operation, the last one's time and number; of attempts at the same time the one queued first counts."""
    last = F.when(F.col("ts").isNotNull() & F.col("seq").isNotNull(), F.struct("ts", (-F.col("seq")).alias("queued")))
    return ops.groupBy("operation_id").agg(F.count("*").alias("attempts"), F.max("ts").alias("last_attempt_at"), F.max_by("seq", last).alias("last_seq"))


def merge_archives(imported: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """Imported rows, and local ones that were not imported."""
    return imported.unionByName(local.join(imported.select(key), key, "left_anti").select(*imported.columns))


def quote_lines(fields: DataFrame, lots: DataFrame, key: list[str]) -> DataFrame:
    """Quote text of each project: its fields in order with rounded quantity and lot, at most fifty."""
    line = fields.join(resolve_lots(fields, lots, key), key).select("project_id", "display_order", "client_field_id", F.concat_ws(" ", F.col("label"), ceil25(F.col("simulated_plants")).cast("string"), F.coalesce("lot", F.lit("-"))).alias("line"))
    w = Window.partitionBy("project_id").orderBy("display_order", "client_field_id")
    first = line.withColumn("n", F.row_number().over(w)).where("n <= 50")
    return first.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "; ").alias("quote_text"))


def profile_errors(profiles: DataFrame) -> DataFrame:
    """Profiles with what is missing or clashing: e-mail, company, display names used twice."""
    same = profiles.groupBy(text(F.col("display_name")).alias("k")).agg(F.count("*").alias("n"))
    out = profiles.withColumn("k", text(F.col("display_name"))).join(same, "k")
    missing = F.array_compact(F.array(F.when(blank_to_null(F.col("email")).isNull(), F.lit("email")), F.when(blank_to_null(F.col("company_name")).isNull(), F.lit("company_name")), F.when(F.col("n") > 1, F.lit("display_name"))))
    return out.select("user_id", missing.alias("missing"))
