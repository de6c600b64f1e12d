"""Versioned table maintenance: current state and a log of requests in, outcomes and next state out.

Requests that depend on each other's outcome (a version that each success raises) are folded per key in order; everything else is joins. A state table has one row per
key, so these joins are even; logs are dealt out by key and streamed through the fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions.common import blank_to_null, text
from terraloom.operators.catalog import allocated_codes, located
from terraloom.operators.archive import public_code_ok
from terraloom.operators.folds import first_of_each, fold

#: The shape of a user name.
USERNAME = "^[a-z0-9._-]{3,32}$"


def create_revisions(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """Requests (project_id, seq, expected_version) against projects (version, latest_revision_number): each that expects the version its
    project has by then makes the next revision and raises both numbers; others are conflicts; requests on unknown projects are not found."""
    base = projects.select("project_id", F.col("version").cast("long").alias("base_version"), F.col("latest_revision_number").cast("long").alias("base_number"))
    log = requests.select("project_id", "seq", F.col("expected_version").cast("long").alias("expected_version")).join(base, "project_id", "left")

    def step(done: int, r: tuple) -> tuple:
        _, _, expected, version, number = r
        if version is None:
            return done, "not_found", None, None
        good = expected == version + done
        done += good
        return done, "saved" if good else "conflict", version + done, number + done if good else None

    return fold(log, "project_id", ["seq"], lambda: 0, step, "outcome string, server_version bigint, revision_number bigint").drop("base_version", "base_number", "expected_version")


def restore_revisions(requests: DataFrame, projects: DataFrame, revisions: DataFrame, fields: DataFrame, now: Column, values: tuple[str, ...] = ("label", "area_m2", "commercial_plants_25")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(projects, fields, new revisions) after a chosen revision becomes the state of its project again; at most one request (project_id, revision_number) per project.

    No version is checked: a restored project has its next version and revision, is not deleted any more, and takes name and campaign year of the snapshot where it has them. All its
    fields go (deleted_at = now), those of the snapshot (array ``fields`` of structs client_field_id and values) come back or are new, with the snapshot's values. The snapshot itself is the
    new revision. Without such a revision the outcome is not_found and nothing changes. Only projects that are asked for are returned, with ``outcome``.
    """
    snapshot = revisions.select("project_id", "revision_number", F.col("name").alias("__name"), F.col("campaign_year").alias("__year"), F.col("fields").alias("__fields"), F.lit(True).alias("__there"))
    met = requests.join(projects, "project_id", "left").join(snapshot, ["project_id", "revision_number"], "left").withColumn("good", F.coalesce("__there", F.lit(False)) & F.col("version").isNotNull())
    more = F.col("good").cast("int")
    state = met.select(
        "project_id", F.when(F.col("good"), "restored").otherwise("not_found").alias("outcome"), (F.col("version") + more).alias("version"), (F.col("latest_revision_number") + more).alias("latest_revision_number"),
        F.when(F.col("good"), F.coalesce(F.nullif("__name", F.lit("")), "name")).otherwise(F.col("name")).alias("name"), F.when(F.col("good"), F.coalesce("__year", "campaign_year")).otherwise(F.col("campaign_year")).alias("campaign_year"),
        F.when(~F.col("good"), F.col("deleted_at")).alias("deleted_at"),
    )
    again = met.where("good").select("project_id", (F.col("latest_revision_number") + 1).alias("revision_number"), F.col("revision_number").alias("restored_from"), F.lit("revision_restore").alias("reason"), F.col("__fields").alias("fields"))
    back = met.where("good").select("project_id", F.explode("__fields").alias("__f")).select("project_id", "__f.client_field_id", *[F.col(f"__f.{c}").alias(f"__{c}") for c in values], F.lit(True).alias("__back"))
    had = fields.select("project_id", "client_field_id", *values).join(met.where("good").select("project_id"), "project_id", "left_semi")
    both = had.join(back, ["project_id", "client_field_id"], "full_outer")
    rows = both.select("project_id", "client_field_id", *[F.when(F.col("__back"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in values], F.when(F.col("__back").isNull(), now).alias("deleted_at"))
    return state, rows, again


def edit_results(edits: DataFrame, fields: DataFrame, projects: DataFrame, longest: int = 80) -> DataFrame:
    """Outcome of each edit (project_id, seq, client_field_id, action, name, expected_version), in order: adds outcome, server_version and new_revision.

    An edit sees what the ones before it left: the version rises with each that is applied, so two that name the same version can't both be. A blank name or one that is too long is refused
    (name_required), so is a project that isn't there or has lost its last field (not_found), another version (conflict, with the project's), a field that is gone (field_not_found).
    """
    there = fields.groupBy("project_id").agg(F.collect_set("client_field_id").alias("__ids"))
    start = projects.select("project_id", F.col("version").cast("long").alias("__version"), F.col("latest_revision_number").cast("long").alias("__number")).join(there, "project_id", "left")
    log = edits.select("project_id", "seq", "client_field_id", "action", "name", "expected_version").join(start, "project_id", "left")

    def step(state: tuple | None, r: tuple) -> tuple:
        _, _, field, action, name, expected, version, number, ids = r
        now, revision, left = state or (version, number, frozenset(ids or ()))
        state = (now, revision, left)
        if action == "rename" and not 0 < len((name or "").strip(" ")) <= longest:
            return state, "name_required", now, None
        if now is None or not left:
            return state, "not_found", None, None
        if expected != now:
            return state, "conflict", now, None
        if field not in left:
            return state, "field_not_found", now, None
        state = (now + 1, revision + 1, left - {field} if action == "delete" else left)
        return state, "applied", now + 1, revision + 1

    return fold(log, "project_id", ["seq"], lambda: None, step, "outcome string, server_version bigint, new_revision bigint").drop("__version", "__number", "__ids")


def edit_fields(fields: DataFrame, edits: DataFrame, projects: DataFrame, longest: int = 80) -> tuple[DataFrame, DataFrame]:
    """(next fields, next projects) after renames and deletions in order, as edit_results() judges them.

    Names are trimmed; the last one of a field stays. Every applied edit is a version and a revision of its project, one whose last field goes is deleted; totals follow the fields.
    """
    key = ["project_id", "client_field_id"]
    done = edit_results(edits, fields, projects, longest).where("outcome = 'applied'")
    todo = done.groupBy(*key).agg(F.bool_or(F.col("action") == "delete").alias("__gone"), F.max_by(F.trim("name"), F.when(F.col("action") == "rename", F.col("seq"))).alias("__name"), F.max("server_version").alias("__last"))
    met = fields.join(todo, key, "left").withColumn("__gone", F.coalesce("__gone", F.lit(False)))
    left = met.where(~F.col("__gone")).withColumn("label", F.coalesce("__name", "label")).select(*fields.columns)
    totals = met.groupBy("project_id").agg(F.count_if(~F.col("__gone")).alias("n_fields"), F.sum(F.when(~F.col("__gone"), F.col("area_m2"))).alias("area_m2"), F.sum(F.when(~F.col("__gone"), F.col("commercial_plants_25"))).alias("plants"), F.max("__last").alias("__last"))
    # Each applied edit raised the version by one, so the last one tells their number: counted apart, they would be folded a second time.
    out = projects.join(totals, "project_id").withColumn("steps", F.coalesce(F.col("__last") - F.col("version"), F.lit(0)))
    return left, out.select(
        "project_id", (F.col("version") + F.col("steps")).alias("version"), (F.col("latest_revision_number") + F.col("steps")).alias("latest_revision_number"), "n_fields", F.coalesce("area_m2", F.lit(0.0)).alias("area_m2"), F.coalesce("plants", F.lit(0)).cast("long").alias("plants"), (F.col("n_fields") == 0).alias("deleted")
    )


def move_results(moves: DataFrame, projects: DataFrame) -> DataFrame:
    """Outcome of each move of a field to another project (op_id, seq, source_id, target_id, field_id, user_id, admin), in order.

    projects: (project_id, owner_user_id, deleted_at, version, latest_revision_number, field_ids, an array in display order). Both projects must be there, different, not deleted and of one owner,
    who is the user unless an administrator moves; no version is expected. A field whose id the target already has gets a new one (moved-<op_id>); a source that loses its last field gets a
    placeholder (empty-<op_id>). Both projects have their next version and revision. An operation that was done is answered alike when it comes again.

    Both projects of a move that can succeed are of one owner, so logs are dealt out by owner and two moves that meet in a project are always in one fold, whose state is the projects that
    it has met. Returns (seq, op_id, outcome, source_id, target_id, new_field_id, and of both projects version, revision and field_ids after the move).
    """
    side = lambda c: projects.select(F.col("project_id").alias(f"{c}_id"), F.col("owner_user_id").alias(f"{c}_owner"), F.struct("version", "latest_revision_number", F.transform("field_ids", lambda x: x.cast("string")).alias("ids"), F.col("deleted_at").isNotNull().alias("gone")).alias(f"{c}_project"))
    log = moves.select("op_id", "seq", "source_id", "target_id", F.trim(F.col("field_id").cast("string")).alias("field_id"), "user_id", "admin").join(side("source"), "source_id", "left").join(side("target"), "target_id", "left")
    log = log.select("source_owner", "seq", "op_id", "source_id", "target_id", "field_id", "user_id", "admin", "target_owner", "source_project", "target_project")

    def step(state: tuple | None, r: tuple) -> tuple:
        owner, _, op, source, target, field, user, admin, other, first, second = r
        now, done = state or ({}, {})
        state = (now, done)
        if op in done:
            return (state, *done[op])
        refused = lambda why: (state, why, *[None] * 7)
        if source == target:
            return refused("same_project")
        if not field:
            return refused("field_required")
        if first is None or second is None or first["gone"] or second["gone"] or owner != other or owner != user and not admin:
            return refused("access_denied")
        for k, found in ((source, first), (target, second)):
            now.setdefault(k, (found["version"], found["latest_revision_number"], tuple(found["ids"] or ())))
        (v0, n0, ids), (v1, n1, others) = now[source], now[target]
        if field not in ids:
            return refused("field_not_found")
        new = f"moved-{op}" if field in others else field
        now[source] = (v0 + 1, n0 + 1, tuple(x for x in ids if x != field) or (f"empty-{op}",))
        now[target] = (v1 + 1, n1 + 1, (*others, new))
        done[op] = ("field_moved", new, v0 + 1, v1 + 1, n0 + 1, n1 + 1, list(now[source][2]), list(now[target][2]))
        return (state, *done[op])

    out = "outcome string, new_field_id string, source_version bigint, target_version bigint, source_revision bigint, target_revision bigint, source_fields array<string>, target_fields array<string>"
    names = [c.split()[0] for c in out.split(", ")]
    return fold(log, "source_owner", ["seq"], lambda: None, step, out).select("seq", "op_id", "source_id", "target_id", "field_id", *names)


def moved_projects(results: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next projects, new revisions) of move_results(): version, revision and field ids after each project's last move; two revisions a move, with direction and the other project."""
    side = lambda me, you, way, field: F.struct(F.col(f"{me}_id").alias("project_id"), F.col(f"{me}_revision").alias("revision_number"), F.lit(way).alias("direction"), F.col(field).alias("field_id"), F.col(f"{you}_id").alias("other_project_id"), F.col(f"{me}_version").alias("version"), F.col(f"{me}_fields").alias("field_ids"))
    # Both sides of a move from one row: a union would run the fold, which no plan shares, once for each.
    sides = F.array(side("source", "target", "out", "field_id"), side("target", "source", "in", "new_field_id"))
    both = results.where("outcome = 'field_moved'").select(F.explode(sides).alias("s")).select("s.*")
    # A repeated operation has the revision of its first answer.
    both = both.dropDuplicates(["project_id", "revision_number"])
    last = both.groupBy("project_id").agg(F.max_by(F.struct("version", "revision_number", "field_ids"), "version").alias("l"))
    rest = projects.select("project_id", "version", "latest_revision_number", F.transform("field_ids", lambda x: x.cast("string")).alias("field_ids")).join(last, "project_id", "left")
    now = lambda new, old: F.coalesce(F.col(f"l.{new}"), F.col(old)).alias(old)
    return rest.select("project_id", now("version", "version"), now("revision_number", "latest_revision_number"), now("field_ids", "field_ids")), both.drop("version")


def set_locations(nested: DataFrame, patches: DataFrame, projects: DataFrame) -> DataFrame:
    """Embedded fields with their new locations; every project that has one gets its next version and revision."""
    asked = patches.select("project_id").distinct().withColumn("__asked", F.lit(1))
    out = located(nested, patches).join(projects.select("project_id", "version", "latest_revision_number"), "project_id").join(asked, "project_id", "left")
    more = F.coalesce("__asked", F.lit(0))
    return out.withColumns({"version": F.col("version") + more, "latest_revision_number": F.col("latest_revision_number") + more}).drop("__asked")


def report_errors(requests: DataFrame, projects: DataFrame, revisions: DataFrame) -> DataFrame:
    """What is wrong first with each report request (report_id, project_id, user_id, admin, revision_number, ids, disclaimer, token_hash): a project that isn't the user's (unless an
    administrator asks) or isn't there, an unknown revision, no ids, ids that the revision (array field_ids) lacks, the disclaimer, the token's hash; else null.

    Ids come back as they are used: trimmed, without blank ones, distinct and sorted.
    """
    trimmed = F.filter(F.transform(F.coalesce("ids", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    owned = projects.select("project_id", F.col("owner_user_id").alias("__owner"))
    out = requests.join(owned, "project_id", "left").join(revisions.select("project_id", "revision_number", "field_ids"), ["project_id", "revision_number"], "left").withColumn("sorted_ids", F.array_sort(F.array_distinct(trimmed)))
    allowed = (F.col("user_id") == F.col("__owner")) | (F.col("__owner").isNotNull() & F.col("admin"))
    error = (
        F.when(~F.coalesce(allowed, F.lit(False)), "access_denied")
        .when(F.col("field_ids").isNull(), "revision_not_found")
        .when(F.size("sorted_ids") < 1, "fields_required")
        .when(F.size(F.array_except("sorted_ids", "field_ids")) > 0, "fields_not_in_revision")
        .when(~F.coalesce("disclaimer", F.lit(False)), "disclaimer_required")
        .when(~F.coalesce(F.col("token_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)), "invalid_token_hash")
    )
    return out.select("report_id", "sorted_ids", error.alias("error"))


def apply_counts(ops: DataFrame, lists: DataFrame, base: DataFrame | None = None, fields: DataFrame | None = None) -> DataFrame:
    """Outcome of each operation (op_id, seq, count_id, list_id, owner, digest, expected, deletes, category, field) on count readings, in order: (seq, op_id, outcome, revision).

    In this order: an applied operation that comes again with its digest has its first result, an operation id with another digest is a VALIDATION_ERROR. The list must be there and the
    owner's, and a deleted list takes deletions only (NOT_FOUND_OR_FORBIDDEN). A reading keeps its list and category (VALIDATION_ERROR). A verified field must be among ``fields`` (owner,
    field), unless the reading already has it (FIELD_UNAVAILABLE). An existing reading must be at the expected revision, and after a deletion takes deletions only (VERSION_CONFLICT, with its
    revision); one that doesn't exist expects 0 (NOT_FOUND_OR_FORBIDDEN). An operation that failed is judged anew when it comes again.

    ``base``: readings before the log (count_id, revision, list_id, category, field, deleted). ``field`` is null where no verified field is named.
    """
    named = lists.select("list_id", F.col("owner_user_id").alias("owner"), F.lit(True).alias("there"), F.col("deleted_at").isNotNull().alias("shut"))
    first = ops.groupBy("op_id").agg(F.min_by("digest", "seq").alias("own"))
    log = ops.join(first, "op_id").join(named, ["list_id", "owner"], "left").withColumn("known", F.col("field").isNull())
    if fields is not None:
        log = log.join(fields.select("owner", "field", F.lit(True).alias("__known")).distinct(), ["owner", "field"], "left").withColumn("known", F.col("known") | F.coalesce("__known", F.lit(False)))
    row = ["count_id", "seq", "op_id", "list_id", "category", "field", "expected", "deletes", "there", "shut", "known"]
    log = log.select(*row, F.col("digest").eqNullSafe(F.col("own")).alias("same"))
    kinds = {"revision": "long", "list_id": "long", "category": "string", "field": "string", "deleted": "boolean"}
    if base is None:
        log = log.select("*", *[F.lit(None).cast(t).alias(f"b_{c}") for c, t in kinds.items()])
    else:
        log = log.join(base.select("count_id", *[(F.col(c) if c in base.columns else F.lit(None)).cast(t).alias(f"b_{c}") for c, t in kinds.items()]), "count_id", "left")

    def judged(state: dict, r: tuple) -> tuple[str, int | None]:
        _, _, op, list_id, category, field, expected, deletes, there, shut, known, same = r[:12]
        if not same:
            return "VALIDATION_ERROR", None
        if op in state["done"]:
            return "REPEATED", state["done"][op]
        if not there or shut and not deletes:
            return "NOT_FOUND_OR_FORBIDDEN", None
        if state["revision"] and (state["list_id"], state["category"]) != (list_id, category):
            return "VALIDATION_ERROR", None
        if not known and not (state["revision"] and state["field"] == field):
            return "FIELD_UNAVAILABLE", None
        if state["revision"] and (state["revision"] != expected or state["deleted"] and not deletes):
            return "VERSION_CONFLICT", state["revision"]
        if not state["revision"] and expected != 0:
            return "NOT_FOUND_OR_FORBIDDEN", None
        return "APPLIED", state["revision"] + 1

    def step(state: dict | None, r: tuple) -> tuple:
        if state is None:
            revision, list_id, category, field, deleted = r[12:17]
            state = {"revision": revision or 0, "list_id": list_id if list_id is not None else r[3], "category": category if revision else r[4], "field": field, "deleted": bool(deleted), "done": {}}
        outcome, revision = judged(state, r)
        if outcome == "APPLIED":
            state.update(revision=revision, list_id=r[3], category=r[4], field=r[5], deleted=bool(r[7]))
            state["done"][r[2]] = revision
        return state, "APPLIED" if outcome == "REPEATED" else outcome, revision

    return fold(log, "count_id", ["seq"], lambda: None, step, "outcome string, revision bigint").select("seq", "op_id", "outcome", "revision")


def accepted_submissions(verdicts: DataFrame, sent: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frozen entries, new deliveries) of accepted submissions that are not known yet; known ones are left as they are."""
    fresh = verdicts.where(F.col("verdict") == "accepted").join(known.select("submission_id"), "submission_id", "left_anti").select("submission_id")
    return sent.join(fresh, "submission_id", "left_semi"), fresh.select("submission_id", F.lit("pending").alias("state"), F.lit(0).alias("attempts"))


def merge_guest(guest: DataFrame, account: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """What becomes of each entry: the guest's is taken where the account has none, kept where they are equal, a conflict with a synced one, and a proposal beside one that isn't."""
    a = guest.select(*key, F.struct(*values).alias("g"))
    b = account.select(*key, F.struct(*values).alias("r"), "sync_state")
    verdict = F.when(F.col("r").isNull(), "taken").when(F.col("g").isNull(), "untouched").when(F.col("g").eqNullSafe(F.col("r")), "equal").when(F.col("sync_state") == "synced", "conflict").otherwise("proposal")
    return a.join(b, key, "full_outer").select(*key, verdict.alias("verdict"))


def backfilled_codes(projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(project_id, code) with a free code for each project without a valid one, by creation; and the old texts as aliases."""
    bad = projects.where(~public_code_ok(F.col("public_code")))
    good = projects.where(public_code_ok(F.col("public_code"))).select("project_id", F.col("public_code").alias("code"))
    new = allocated_codes(bad.select("project_id", "created_at"), good, ["created_at", "project_id"]).select("project_id", "code")
    return good.unionByName(new), bad.where(blank_to_null(F.col("public_code")).isNotNull()).select(F.col("public_code").alias("code"), "project_id")


def upsert_profiles(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """The last valid request of each user (user_id, seq, display_name, username, role) and its error, if its user name is another's; blank or long names
    and malformed user names never count. ``profiles`` (user_id, username) holds the names in use."""
    name, user = F.trim("display_name"), F.lower(F.trim("username"))
    kind = F.when(F.col("role") == "admin", "admin").when(F.col("role") == "anonymous", "guest").otherwise("user")
    good = requests.select("user_id", "seq", name.alias("display_name"), user.alias("username"), kind.alias("owner_kind")).where((F.length("display_name").between(1, 80)) & F.col("username").rlike(USERNAME))
    last = good.groupBy("user_id").agg(F.max_by(F.struct("display_name", "username", "owner_kind", "seq"), "seq").alias("r")).select("user_id", "r.*")
    stay = profiles.join(last.select("user_id"), "user_id", "left_anti").select(text(F.col("username")).alias("username"), F.lit(-1).cast("long").alias("seq"))
    first = last.select("username", "seq").unionByName(stay).groupBy("username").agg(F.min("seq").alias("first"))
    return last.join(first, "username").select("user_id", "display_name", "username", "owner_kind", F.when(F.col("seq") != F.col("first"), "username_taken").alias("error"))


def claimed(rows: DataFrame, grants: DataFrame, claims: DataFrame, owner: str = "owner_user_id") -> DataFrame:
    """Rows of guests handed over to users who present (token, user_id) a grant's (token_hash, guest, used_by) secret that they themselves used."""
    met = claims.withColumn("token_hash", F.sha2("token", 256)).join(grants, "token_hash").where((F.col("used_by") == F.col("user_id")) & (F.col("guest") != F.col("user_id")))
    one = met.groupBy("guest").agg(F.min("user_id").alias("__to"))
    return rows.join(one, rows[owner] == one["guest"], "left").withColumn(owner, F.coalesce("__to", owner)).select(*rows.columns)


def chosen_fields(projects: DataFrame, revisions: DataFrame, rows: DataFrame) -> DataFrame:
    """Ids of the fields to publish: those of the latest revision (array field_ids), or the live rows in display order where it has fewer or none."""
    last = revisions.groupBy("project_id").agg(F.max_by("field_ids", "revision_number").alias("a"))
    live = rows.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("display_order", "client_field_id"))), lambda x: x["client_field_id"]).alias("b"))
    out = projects.select("project_id").join(last, "project_id", "left").join(live, "project_id", "left")
    b = F.coalesce("b", F.array().cast("array<bigint>"))
    return out.select("project_id", F.when(F.col("a").isNull() | (F.size(b) > F.size("a")), b).otherwise(F.col("a")).alias("field_ids"))


def submission_list(submissions: DataFrame, deliveries: DataFrame, owners: DataFrame, state: str | None = None) -> DataFrame:
    out = submissions.join(deliveries, "submission_id").join(owners, "owner_user_id", "left")
    return out.where(F.col("state") == state) if state else out


def list_details(lists: DataFrame, entries: DataFrame, owners: DataFrame) -> DataFrame:
    """Each live list with its owner's kind and its entries in order, as an array."""
    own = entries.groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct("entry_no", "client_field_id", "quantity"))).alias("entries"))
    return lists.where(F.col("deleted_at").isNull()).join(owners, "owner_user_id", "left").join(own, "list_id", "left").select("list_id", "owner_kind", F.coalesce("entries", F.array()).alias("entries"))


SNAPSHOT = "struct<name:string,campaignYear:string,fields:array<struct<id:string,label:string,geometry:array<array<double>>,rowSpacingM:double,rootstock:string,metrics:struct<areaM2:double>>>>"


def snapshot_tables(snapshots: DataFrame, id_col: str, body_col: str) -> tuple[DataFrame, DataFrame]:
    """(project rows, field rows) of snapshots: outlines as WKT, the design as JSON of what is neither outline nor metric, order by place."""
    s = snapshots.select(id_col, F.from_json(body_col, SNAPSHOT).alias("s"))
    fields = s.select(id_col, F.posexplode("s.fields").alias("display_order", "f"))
    ring = F.array_join(F.transform("f.geometry", lambda p: F.concat_ws(" ", F.get(p, F.lit(0)).cast("string"), F.get(p, F.lit(1)).cast("string"))), ", ")
    wkt = F.when(F.size("f.geometry") >= 4, F.concat(F.lit("POLYGON(("), ring, F.lit("))")))
    design = F.to_json(F.struct(F.col("f.label").alias("label"), F.col("f.rowSpacingM").alias("rowSpacingM"), F.col("f.rootstock").alias("rootstock")))
    rows = fields.select(id_col, F.col("f.id").alias("client_field_id"), "display_order", wkt.alias("geometry"), design.alias("design"), F.col("f.metrics.areaM2").alias("gross_area_m2"))
    return s.select(id_col, "s.name", F.size("s.fields").alias("n_fields")), rows


def migrated_archives(archives: DataFrame, now: Column, latest: int = 3) -> DataFrame:
    """Archives (version, id, saved_at, campaign_year, fields or the single field of version 1) in the latest version: ids by default from the key, the year if it is
    one of 2000 to 2100, else that of saving, else this one; a version 1 field becomes a list of one."""
    year = F.col("campaign_year").try_cast("int")
    fields = F.when(F.col("version") == 1, F.when(F.col("single").isNotNull(), F.array("single")).otherwise(F.array())).otherwise(F.coalesce("fields", F.array()))
    known = archives.where(F.col("version").between(1, latest))
    return known.select(F.coalesce(blank_to_null(F.col("id")), F.concat(F.lit("project-"), F.col("key").cast("string"))).alias("id"), F.lit(latest).alias("version"), F.when(year.between(2000, 2100), year).otherwise(F.coalesce(F.year("saved_at"), F.year(now))).alias("campaign_year"), fields.alias("fields"))


def suggested_orientation(fields: DataFrame, suggestions: DataFrame, key: list[str]) -> DataFrame:
    """Fields with the suggested angle, unless their orientation is locked or there is no suggestion."""
    out = fields.join(suggestions.select(*key, F.col("angle").alias("__angle")), key, "left")
    return out.withColumn("orientation_deg", F.when(~F.coalesce("orientation_locked", F.lit(False)) & F.col("__angle").isNotNull(), F.col("__angle").cast("double")).otherwise(F.col("orientation_deg"))).drop("__angle")


def portion_matches(overlaps: DataFrame) -> DataFrame:
    """Old and new portions (owner, old, new, area) matched one to one, greatest overlap first, ties by old, then new; a field's portions are few, so its pairs
    fold in order within one array."""
    kind = "array<struct<old:bigint,new:bigint>>"
    pairs = overlaps.where(F.col("area") > 0).groupBy("owner").agg(F.array_sort(F.collect_list(F.struct((-F.col("area")).alias("less"), "old", "new"))).alias("ps"))
    free = lambda kept, p: ~F.exists(kept, lambda k: (k["old"] == p["old"]) | (k["new"] == p["new"]))
    add = lambda kept, p: F.when(free(kept, p), F.concat(kept, F.array(F.struct(p["old"].alias("old"), p["new"].alias("new"))))).otherwise(kept)
    return pairs.select("owner", F.explode(F.aggregate("ps", F.array().cast(kind), add)).alias("m")).select("owner", "m.old", "m.new")
