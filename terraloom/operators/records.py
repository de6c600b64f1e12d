"""Record keeping over whole tables: histories, queues, snapshots, redaction, locations, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions.common import blank_to_null


#: Kinds of event and the payload keys that are never kept for them.
PRIVATE = {"gps_used": ("latitude", "longitude", "lat", "lon", "lng", "accuracy", "coords")}


def counts_per_field(entries: DataFrame, key: list[str]) -> DataFrame:
    """Totals of the three categories and the latest update of every field."""
    total = lambda c: F.coalesce(F.sum(F.when(F.col("category") == c, F.col("quantity"))), F.lit(0)).alias(c)
    return entries.groupBy(*key).agg(total("plants"), total("posts"), total("other"), F.max("updated_at").alias("updated_at"))


def revision_history(revisions: DataFrame) -> DataFrame:
    """Per project its revision numbers, newest first."""
    return revisions.groupBy("project_id").agg(F.sort_array(F.collect_list("revision_number"), asc=False).alias("revision_numbers"))


def requested_ids(ids: Column) -> Column:
    """Trimmed, without blanks, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(ids, lambda x: F.trim(x)), lambda x: x != "")))


def next_revisions(requests: DataFrame, base: DataFrame) -> DataFrame:
    """Numbers for new revisions in order of request, after the project's last one."""
    w = Window.partitionBy("project_id").orderBy("seq")
    out = requests.join(base, "project_id", "left").withColumn("n", F.row_number().over(w))
    return out.select("project_id", "seq", (F.coalesce("latest_revision_number", F.lit(0)) + F.col("n")).alias("revision_number"))


def smallest_unused(rows: DataFrame, key: str, number: str) -> DataFrame:
    """The smallest positive number that a key's rows don't use."""
    w = Window.partitionBy(key).orderBy(number)
    used = rows.select(key, number).distinct().withColumn("after", F.lead(number).over(w))
    gap = used.where(F.col("after").isNull() | (F.col("after") > F.col(number) + 1)).groupBy(key).agg((F.min(number) + 1).alias("g"))
    low = rows.groupBy(key).agg(F.min(number).alias("low"))
    return low.join(gap, key).select(key, F.when(F.col("low") > 1, 1).otherwise(F.col("g")).cast("long").alias("unused"))


def merge_outbox(queued: DataFrame, retained: DataFrame, conflicted: DataFrame) -> DataFrame:
    """The last entry of every operation, without retained ones; operations of projects in conflict are blocked."""
    rest = [c for c in queued.columns if c != "operation_id"]
    last = queued.groupBy("operation_id").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("operation_id", "r.*")
    kept = last.join(retained, "operation_id", "left_anti")
    return kept.join(conflicted.withColumn("blocked", F.lit(True)), "project_id", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))


def redacted_events(events: DataFrame, consents: DataFrame, payload: str = "props", private: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Events with their payload as JSON less the private keys of their kind, and the visitor only where (user_id, consent) says analytics."""
    private = PRIVATE if private is None else private
    given = F.from_json(payload, "map<string,string>")
    without = lambda keys: F.map_filter(given, lambda k, v: ~k.isin(*keys))
    shown = given
    for kind, keys in private.items():
        shown = F.when(F.col("event_type") == kind, without(keys)).otherwise(shown)
    agreed = consents.where(F.col("consent") == "analytics").select("user_id").distinct().withColumn("__agreed", F.lit(True))
    return events.join(agreed, "user_id", "left").select("event_id", "event_type", F.to_json(shown).alias("payload"), F.when(F.col("__agreed"), F.col("user_id")).alias("visitor"))


def public_fields(nested: DataFrame, selected: DataFrame) -> DataFrame:
    """Ordered subset of each project's embedded fields by selected ids."""
    ids = selected.groupBy("project_id").agg(F.collect_set("client_field_id").alias("ids"))
    out = nested.join(ids, "project_id")
    return out.select("project_id", F.transform(F.filter("field_plans", lambda f: F.array_contains("ids", f["client_field_id"])), lambda f: f["client_field_id"]).alias("shown"))


def location(row: dict[str, Column]) -> Column:
    """struct(label, province, region): city, district or neighbourhood first; null without any."""
    place = F.coalesce(*[blank_to_null(row[c]) for c in ("city", "district", "neighborhood")])
    return F.when(place.isNotNull(), F.struct(place.alias("label"), blank_to_null(row["province"]).alias("province"), blank_to_null(row["region"]).alias("region")))


def acknowledged(snapshots: DataFrame) -> DataFrame:
    """Autosaves that a newer snapshot of the same project makes needless, and the one that does."""
    w = Window.partitionBy("project_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return snapshots.select("operation_id", "seq", "project_id", F.last("seq").over(w).alias("by_seq")).where(F.col("seq") != F.col("by_seq"))


def quote_states(attempts: DataFrame) -> DataFrame:
    """State of each quote after its last attempt; a sent quote stays sent."""
    return attempts.groupBy("project_id").agg(F.when(F.bool_or(F.col("outcome") == "sent"), "sent").otherwise(F.max_by("outcome", "attempt")).alias("state"), F.count("*").alias("attempts"))


def tokens_to_reports(asked: DataFrame, reports: DataFrame) -> DataFrame:
    """Reports that a token opens: by the token's hash, not revoked."""
    live = reports.where(F.col("revoked_at").isNull())
    return asked.select("token", F.sha2("token", 256).alias("token_hash")).join(live, "token_hash").select("token", "report_id")


def revoked(reports: DataFrame, now: Column, which: Column) -> DataFrame:
    """The first time of revoking stays."""
    return reports.withColumn("revoked_at", F.when(which, F.coalesce("revoked_at", now)).otherwise(F.col("revoked_at")))


def recompute_totals(projects: DataFrame, fields: DataFrame) -> DataFrame:
    """Project totals from its fields, zero without any."""
    sums = fields.groupBy("project_id").agg(F.sum("area_m2").alias("a"), F.sum("commercial_plants_25").alias("p"))
    return projects.join(sums, "project_id", "left").select("project_id", F.coalesce("a", F.lit(0.0)).alias("gross_area_m2"), F.coalesce("p", F.lit(0)).alias("commercial_plants_25"))


def signature(ring: Column) -> Column:
    """A ring's text with six decimals."""
    return F.array_join(F.transform(ring, lambda p: F.format_string("%.6f,%.6f", p["lon"], p["lat"])), ";")


def current(stored: Column, ring: Column) -> Column:
    """Whether a stored signature is that of the ring; one that is missing or empty never is."""
    return F.coalesce((stored != "") & (stored == signature(ring)), F.lit(False))


def reference_text(municipality: Column, section: Column, sheet: Column, parcel: Column) -> Column:
    """Display text of a cadastral reference; parts that are missing are left out."""
    part = lambda label, x: F.when(blank_to_null(x).isNotNull(), F.concat(F.lit(label), F.trim(x)))
    return F.concat_ws(" · ", blank_to_null(municipality), part("Sez. ", section), part("Fg. ", sheet), part("Part. ", parcel))


def horizontal_step(ground_m: Column, along: Column, across: Column) -> Column:
    """Horizontal distance between rows so that they are ground_m apart on a plane that climbs ``along`` the rows and ``across`` them."""
    return ground_m * F.sqrt((1 + along * along) / (1 + along * along + across * across))


DELIVERY = "state string, send boolean, attempts int"


def delivery_step(s: tuple, r: tuple) -> tuple[tuple, tuple]:
    """State (state, first attempt, lease's end, attempts) and answer (state, send, attempts) after a row (submission_id, at_s, seq, action)."""
    state, first, lease, n = s
    at, action = r[1], r[3]
    send = False
    if action == "claim":
        if state != "provider_accepted" and not (lease is not None and lease > at):
            if first is not None and first < at - 23 * 3600:
                state, lease = "uncertain", None
            else:
                state, first, lease, n, send = "sending", at if first is None else first, at + 120, n + 1, True
    elif state == "sending":
        state, lease = action, None
    return (state, first, lease, n), (state, send, n)


def deliveries(log: DataFrame) -> DataFrame:
    """Delivery states from a log (submission_id, at_s, seq, action): claims lease a delivery for two minutes and are refused while it is leased,
    accepted, or a day (23 hours) after its first attempt; results count only while it is being sent."""
    from terraloom.operators.folds import fold

    def step(s: tuple, r: tuple) -> tuple:
        now, values = delivery_step(s, r)
        return now, *values

    return fold(log.select("submission_id", "at_s", "seq", "action"), "submission_id", ["at_s", "seq"], lambda: ("pending", None, None, 0), step, DELIVERY)


def media_listing(media: DataFrame, owner: int, writable: bool) -> DataFrame:
    """An owner's ready media, and pending ones where they may write, newest first."""
    shown = ("ready", "pending") if writable else ("ready",)
    return media.where((F.col("owner_user_id") == owner) & F.col("status").isin(*shown)).select("media_id", "status", "created_at").orderBy(F.desc("created_at"), F.desc("media_id"))


def with_notes(notes: DataFrame, new: DataFrame) -> DataFrame:
    """Notes and new ones, trimmed, blank ones left out, with their place within the project, newest first."""
    fresh = new.withColumn("body", F.trim("body")).where(F.col("body") != "")
    w = Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("note_id"))
    return notes.unionByName(fresh.select(*notes.columns)).withColumn("place", F.row_number().over(w))


def status_updates(projects: DataFrame, wanted: DataFrame, statuses: tuple[str, ...] = ("draft", "saved", "pdf_downloaded", "quote_requested", "contacted", "client")) -> DataFrame:
    """Next status and version of each project; an unknown status is invalid, another version than expected a conflict."""
    out = projects.join(wanted, "project_id", "left")
    verdict = F.when(F.col("wanted").isNull(), "untouched").when(~F.col("wanted").isin(*statuses), "invalid").when(~F.col("expected").eqNullSafe(F.col("version")), "conflict").otherwise("updated")
    out = out.withColumn("outcome", verdict)
    done = F.col("outcome") == "updated"
    return out.select("project_id", F.when(done, F.col("wanted")).otherwise(F.col("status")).alias("status"), "outcome", (F.col("version") + done.cast("int")).alias("version"))


def stable_json(values: Column) -> Column:
    """Canonical text of a map: keys in order of code point."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))


def expired(rows: DataFrame, since: str, now: Column, days: int) -> DataFrame:
    """Rows whose time in ``since`` lies more than so many days back."""
    return rows.where(F.col(since) < now - F.make_interval(days=F.lit(days)))
