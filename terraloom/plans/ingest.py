"""Round trips through the text readers: payloads made from the views, read back; the SQL states the columns they were made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.sources import ingest
from terraloom.sources.views import view, with_rings, with_views

KEY = ["project_id", "client_field_id"]


def _id() -> Column:
    return F.concat_ws(":", *[F.col(k).cast("string") for k in KEY]).alias("id")


def _geojson(s: SparkSession, sf: str) -> DataFrame:
    f = with_rings(view(s, sf, "project_fields"))
    docs = ingest.features(f, KEY, "ring", ["label", "rootstock"]).select(F.get_json_object("value", "$.id").alias("id"), F.when(F.crc32(F.col("value")) % 2 == 0, F.concat(F.lit('{"type":"FeatureCollection","features":['), "value", F.lit("]}"))).otherwise(F.col("value")).alias("body"))
    good, _ = ingest.geojson_fields(docs, "id", "body")
    return good.select("id", "feature_index", "part_index", "label", F.size("ring").alias("n_points"))


def _gml(s: SparkSession, sf: str) -> DataFrame:
    f = view(s, sf, "project_fields").select(_id(), "lon0", "lat0", "dlon", "dlat", "rootstock")
    pos = F.concat_ws(" ", *[c.cast("string") for c in (F.col("lat0"), F.col("lon0"), F.col("lat0"), F.col("lon0") + F.col("dlon"), F.col("lat0") + F.col("dlat"), F.col("lon0"))])
    body = F.concat(F.lit('<wfs:FeatureCollection numberReturned="1"><wfs:member><CP:CadastralParcel gml:id="p'), "id", F.lit('"><CP:nationalCadastralReference>'), "rootstock", F.lit("</CP:nationalCadastralReference><gml:posList>"), pos, F.lit("</gml:posList></CP:CadastralParcel></wfs:member></wfs:FeatureCollection>"))
    out = ingest.gml_parcels(f.select("id", body.alias("body")), "id", "body")
    return out.select("id", "complete", "ordinal", "gml_id", "reference", F.size("ring").alias("n_points"), F.round(F.get("ring", F.lit(1))["lon"], 9).alias("lon1"))


def _html(s: SparkSession, sf: str) -> DataFrame:
    f = view(s, sf, "project_fields").select(_id(), "display_order", "rootstock")
    body = F.concat(F.lit("<table><tr><th>NationalCadastralReference</th><td>a12"), F.col("display_order").cast("string"), F.lit("_004500."), "rootstock", F.lit("</td></tr><tr><th> Label </th><td>"), F.when(F.col("display_order") > 3, "7/b").otherwise(""), F.lit("</td></tr></table>"))
    return ingest.cadastral_html(f.select("id", body.alias("body")), "id", "body")


def _soil(s: SparkSession, sf: str) -> DataFrame:
    f = view(s, sf, "project_fields").select(_id(), "display_order", "grape_variety", "rootstock", "row_spacing_m")
    body = F.concat(F.lit("Tessitura: '"), "grape_variety", F.lit("'\r\nSabbia pct = "), F.col("display_order").cast("string"), F.lit(",5 %\nUnita di suolo: "), "rootstock", F.lit("\nlimo: 140\ncalcare: n/a\npH: "), F.col("row_spacing_m").cast("string"))
    return ingest.soil_profiles(f.select("id", F.when(F.col("display_order") == 7, "no data").otherwise(body).alias("body")), "id", "body")


QUERIES = {"s6_geojson": _geojson, "s7_gml_parcels": _gml, "s8_cadastral_html": _html, "s9_soil_text": _soil}

_ID = "concat(CAST(project_id AS VARCHAR), ':', CAST(client_field_id AS VARCHAR)) AS id"
_SQL = {
    "s6_geojson": f"SELECT {_ID}, 0 AS feature_index, 0 AS part_index, label, CASE WHEN l_shape THEN 7 ELSE 5 END AS n_points FROM project_fields",
    "s7_gml_parcels": f"SELECT {_ID}, true AS complete, 0 AS ordinal, concat('p', CAST(project_id AS VARCHAR), ':', CAST(client_field_id AS VARCHAR)) AS gml_id, rootstock AS reference, 4 AS n_points, round(lon0 + dlon, 9) AS lon1 FROM project_fields",
    "s8_cadastral_html": f"SELECT {_ID}, concat('A12', CAST(display_order AS VARCHAR)) AS municipality_code, NULL AS section, '45' AS sheet, NULL AS attachment, NULL AS development, CASE WHEN display_order > 3 THEN '7/b' ELSE rootstock END AS parcel FROM project_fields",
    "s9_soil_text": f"SELECT {_ID}, rootstock AS soil_unit, NULL AS soil_type, grape_variety AS texture, NULL AS limestone, NULL AS drainage, NULL AS reaction, NULL AS organic_matter, NULL AS skeleton, NULL AS code, grape_variety AS description, display_order + 0.5e0 AS sand, NULL AS silt, NULL AS clay, row_spacing_m AS ph FROM project_fields WHERE display_order <> 7",
}
ORACLES = {k: with_views(v) for k, v in _SQL.items()}
