"""Bulk readers of text payloads: a column of documents in, rows out, rejects in a table of their own.

All parsing is by built-in JSON and regular-expression functions, one row at a time in the JVM; explodes make rows, nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions.common import blank_to_null, bound
from terraloom.functions.geo import close_ring
from terraloom.operators.archive import parse_reference
from terraloom.operators.planting import valid_rings

_POSITION = "array<array<array<double>>>"
_GEOMETRY = "struct<type:string,coordinates:string>"
_FEATURE = f"struct<type:string,properties:map<string,string>,geometry:{_GEOMETRY}>"


def geojson_fields(docs: DataFrame, id_col: str, body_col: str) -> tuple[DataFrame, DataFrame]:
    """(fields, rejects) of Feature, FeatureCollection, Polygon and MultiPolygon documents: one row per polygon part.

    Labels come from the feature's name or label, else its number; parts of a multi-polygon get their number too. Rings that are open,
    out of range, flat or self-crossing, and polygons with holes, are rejects, as are documents of another kind.
    """
    body = F.col(body_col)
    kind = F.get_json_object(body, "$.type")
    one = F.from_json(body, _FEATURE)
    bare = F.from_json(body, _GEOMETRY)
    many = F.from_json(body, f"struct<features:array<{_FEATURE}>>")["features"]
    features = F.when(kind == "FeatureCollection", many).when(kind == "Feature", F.array(one)).when(kind.isin("Polygon", "MultiPolygon"), F.array(F.struct(F.lit("Feature").alias("type"), F.create_map().cast("map<string,string>").alias("properties"), bare.alias("geometry"))))
    rows = docs.select(id_col, F.sha2(body, 256).alias("fingerprint"), F.posexplode_outer(features).alias("feature_index", "f"))
    geometry = F.col("f.geometry")
    polygons = F.when(geometry["type"] == "Polygon", F.array(F.from_json(geometry["coordinates"], _POSITION))).when(geometry["type"] == "MultiPolygon", F.from_json(geometry["coordinates"], f"array<{_POSITION}>"))
    label = F.coalesce(blank_to_null(F.col("f.properties")["name"]), blank_to_null(F.col("f.properties")["label"]), F.concat(F.lit("Campo storico "), (F.col("feature_index") + 1).cast("string")))
    rows = rows.select(id_col, "fingerprint", "feature_index", label.alias("base"), F.size(polygons).alias("parts"), F.posexplode_outer(polygons).alias("part_index", "rings"))
    ring = F.transform(F.get("rings", F.lit(0)), lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))
    rows = rows.select(id_col, "fingerprint", "feature_index", "part_index", F.when(F.col("parts") > 1, F.concat("base", F.lit(" · "), (F.col("part_index") + 1).cast("string"))).otherwise(F.col("base")).alias("label"), F.size("rings").alias("n_rings"), ring.alias("ring"))
    key = [id_col, "fingerprint", "feature_index", "part_index", "label", "n_rings"]
    judged = valid_rings(rows.select(*key, F.struct("ring").alias("kept"), "ring"), [*key, "kept"])
    good = F.coalesce(F.col("valid"), F.lit(False)) & (F.col("n_rings") == 1)
    # An empty explode drops rows without the verdict being pushed down and computed again for every mention of it.
    out = judged.select(F.struct(id_col, "fingerprint", "feature_index", "part_index", "label", "kept.ring").alias("r"), good.alias("good"))
    kept = lambda which: out.select(F.explode(F.when(which, F.array("r"))).alias("r"))
    return kept(F.col("good")).select("r.*"), kept(~F.col("good")).select(f"r.{id_col}", "r.feature_index", "r.part_index")


#: Character references of markup.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def decoded(x: Column) -> Column:
    for entity, c in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(c))
    return F.trim(x)


def _pieces(x: Column, name: str) -> Column:
    """What stands in each element of a name, with any prefix: the text is split at its tags, and every other piece is inside."""
    tags = rf"(?i)</?(?:[a-z]+:)?{name}(?:\s[^>]*)?>"
    return F.filter(F.split(x, tags, -1), lambda p, i: i % 2 == 1)


def _attribute(x: Column, name: str) -> Column:
    """Value of the first attribute of a name: what stands between the quotes after it."""
    quote = lambda p: F.substring(p["after"], 1, 1)
    quoted = lambda p: F.when(quote(p).isin('"', "'"), F.split_part(F.substring(p["after"], F.lit(2), F.length(p["after"])), quote(p), F.lit(1)))
    return bound(lambda q: blank_to_null(q["value"]), value=bound(quoted, after=F.get(F.split(x, f"(?i){name}=", 2), F.lit(1))))


def _rows(rows: DataFrame, good: Column) -> DataFrame:
    """The rows for which good holds. A plain filter is pushed below the columns that it reads, which are then computed again for each mention; so is what Spark infers from an inner explode."""
    return rows.select(F.explode_outer(F.when(good, F.array(F.struct(*rows.columns)))).alias("r")).where("r IS NOT NULL").select("r.*")


def gml_parcels(docs: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """Parcels of feature-service answers: id, reference, closed ring with longitude first, and whether the answer holds as many as it says.

    Parcels with fewer than three positions, an odd count, values that are no numbers or positions off the globe give no row.
    """
    rows = docs.select(id_col, _attribute(F.col(body_col), "numberReturned").try_cast("int").alias("said"), _pieces(F.col(body_col), "member").alias("members"))
    rows = rows.select(id_col, (F.coalesce("said", F.size("members")) == F.size("members")).alias("complete"), F.posexplode_outer("members").alias("ordinal", "m")).where("m IS NOT NULL")
    first = lambda name: F.get(_pieces(F.col("m"), name), F.lit(0))
    values = F.transform(F.filter(F.split(F.trim(first("posList")), r"\s"), lambda x: x != ""), lambda x: x.try_cast("double"))
    rows = rows.select(id_col, "complete", "ordinal", _attribute(F.col("m"), "gml:id").alias("gml_id"), blank_to_null(decoded(first("nationalCadastralReference"))).alias("reference"), values.alias("v"))
    pairs = lambda p: F.transform(F.filter(p["v"], lambda x, i: i % 2 == 0), lambda lat, k: F.struct(F.get(p["v"], 2 * k + 1).alias("lon"), lat.alias("lat")))
    there = lambda p: F.forall(p["ring"], lambda q: F.coalesce(q["lon"].between(-180, 180) & q["lat"].between(-90, 90), F.lit(False)))
    whole = lambda p: F.when((F.size(p["v"]) >= 6) & (F.size(p["v"]) % 2 == 0), bound(lambda q: F.when(there(q), close_ring(q["ring"])), ring=pairs(p)))
    rows = rows.select(id_col, "complete", "ordinal", "gml_id", "reference", bound(whole, v=F.col("v")).alias("ring"))
    return _rows(rows, F.col("ring").isNotNull())


def cadastral_html(docs: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """Reference of each page of header and value cells; a label cell overrides the parcel. Pages without a reference give nulls."""
    cell = lambda n: F.regexp_extract(F.col(body_col), rf"(?i)<th[^>]*>\s*{n}\s*</th>\s*<td[^>]*>([^<]*)</td>", 1)
    rows = docs.select(id_col, decoded(cell("NationalCadastralReference")).alias("reference"), blank_to_null(decoded(cell("Label"))).alias("label"))
    rows = rows.withColumn("p", parse_reference(F.col("reference")))
    names = ("municipality_code", "section", "sheet", "attachment", "development")
    return rows.select(id_col, *[F.col("p")[n].alias(n) for n in names], F.when(F.col("p").isNotNull(), F.coalesce("label", F.col("p.parcel"))).alias("parcel"))


#: Keys of soil answers and what they are called here, upper limits of numbers, words of answers that hold nothing.
SOIL_TEXT = {
    "soil_unit": "cod_ucs_50 unita_pedologica unita_di_suolo soil_unit",
    "soil_type": "tipo_suolo tipo_di_suolo soil_type",
    "texture": "tessitura texture tessitura_topsoil classe_tessitura_t",
    "limestone": "calcare calcare_topsoil limestone classe_calcare_t",
    "drainage": "drenaggio drainage classe_drenaggio",
    "reaction": "reazione reazione_topsoil classe_reazione_t",
    "organic_matter": "sostanza_organica carbonio_organico organic_matter",
    "skeleton": "scheletro skeleton",
    "code": "cod_ucs_50 codice cod id",
    "description": "descrizione descriz denominazione nome desc_calcare_t desc_drenaggio desc_reazione_t",
}
SOIL_NUMBER = {"sand": ("sabbia sabbia_pct sand", 100), "silt": ("limo limo_pct silt", 100), "clay": ("argilla argilla_pct clay", 100), "ph": ("ph reazione_ph", 14)}
NOTHING = ("serviceexception", "exceptionreport", "no features", "no results", "nessun risultato", "no data")
NO_VALUE = ("null", "undefined", "n/a")


def soil_profiles(docs: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """Typed profile of each answer of ``key: value`` or ``key = value`` lines; the last line of a key counts. A profile without a
    description takes its texture, type, unit, limestone, drainage or reaction. Error answers and those without any known key give no row."""
    def failed(p: Column) -> Column:
        out = F.lit(False)
        for w in NOTHING:
            out = out | p["low"].contains(w)
        return F.coalesce(out, F.lit(True))

    # Each value has a name of its own, as plain expressions are evaluated again for every mention.
    def read(line: Column) -> Column:
        return bound(lambda p: bound(lambda q: bound(judged, key=q["key"], value=q["value"], bare=bare(q)), key=F.lower(F.trim(F.get(p["cut"], F.lit(0)))), value=F.trim(F.replace(F.get(p["cut"], F.lit(1)), F.lit("\r"), F.lit("")))), cut=F.split(line, "[:=]", 2))

    def bare(q: Column) -> Column:
        value = q["value"]
        quoted = F.substring(value, 1, 1).isin('"', "'") & (F.length(value) > 1) & (F.substring(value, 1, 1) == F.right(value, F.lit(1)))
        return F.trim(F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value))

    def judged(r: Column) -> Column:
        good = F.length(r["key"]).between(2, 45) & F.length(r["value"]).between(1, 250) & (r["bare"] != "") & ~F.lower(r["bare"]).isin(*NO_VALUE)
        return F.when(good, F.struct(F.array_join(F.filter(F.split(F.translate(r["key"], " .-\t", "____"), "_"), lambda w: w != ""), "_").alias("k"), r["bare"].alias("v")))

    pairs = F.when(~bound(failed, low=F.lower(body_col)), F.array_compact(F.transform(F.split(F.col(body_col), "\n"), read)))
    known = [k for keys in SOIL_TEXT.values() for k in keys.split()] + [k for keys, _ in SOIL_NUMBER.values() for k in keys.split()]
    rows = docs.select(id_col, bound(lambda p: F.when(F.exists(p["kv"], lambda x: x["k"].isin(*known)), p["kv"]), kv=pairs).alias("kv"))
    rows = _rows(rows, F.col("kv").isNotNull())
    found = lambda keys: bound(lambda p: F.get(p["met"], F.size(p["met"]) - 1)["v"], met=F.filter("kv", lambda x: x["k"].isin(*keys.split())))

    def number(keys: str, top: int) -> Column:
        plain = lambda p: F.when(p["v"].rlike("^[0-9]") & p["v"].rlike("[0-9]$") & ~p["v"].rlike("[^0-9.]"), p["v"].try_cast("double"))
        value = bound(plain, v=F.rtrim(F.rtrim(F.translate(found(keys), ",", "."), F.lit("%"))))
        return bound(lambda p: F.when(p["d"].between(0, top), p["d"]), d=value)

    out = rows.select(id_col, *[found(k).alias(n) for n, k in SOIL_TEXT.items()], *[number(k, top).alias(n) for n, (k, top) in SOIL_NUMBER.items()])
    return out.withColumn("description", F.coalesce("description", "texture", "soil_type", "soil_unit", "limestone", "drainage", "reaction"))


def features(fields: DataFrame, key: list[str], ring_col: str, properties: list[str]) -> DataFrame:
    """One GeoJSON feature per row, as text, ready for write.text."""
    coordinates = F.array(F.transform(F.col(ring_col), lambda p: F.array(p["lon"], p["lat"])))
    feature = F.struct(F.lit("Feature").alias("type"), F.concat_ws(":", *[F.col(k).cast("string") for k in key]).alias("id"), F.struct(*properties).alias("properties"), F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"))
    return fields.select(F.to_json(feature).alias("value"))
