"""Text readers: odd answers, and plans that read each text once."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from terraloom.sources import ingest  # noqa: E402


def mentions(df, name):
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_soil_lines(spark):
    texts = ["Tessitura: 'A'\r\npH = 7,5 %\ntessitura = B\nSabbia pct: 101\nlimo: n/a", "x: 1\ny", "No Data\ntessitura: a", None, "", "tessitura: ''\nargilla = 30\r", "TESSITURA : '\n ph:5\nclay=1.2.3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    out = ingest.soil_profiles(docs, "id", "body")
    assert {r.id: (r.texture, r.description, r.ph, r.sand, r.silt, r.clay) for r in out.collect()} == {0: ("B", "B", 7.5, None, None, None), 5: (None, None, None, None, None, 30.0), 6: ("'", "'", 5.0, None, None, None)}
    # The lines of a text are cut once, not again for every mention of their values.
    assert mentions(out, "split(body") == 1 and mentions(out, "[:=]") == 1


def test_parcels(spark):
    member = lambda m: f"<wfs:member>{m}</wfs:member>"
    parcel = lambda pos: f'<P gml:id="a"><r:nationalCadastralReference> R&amp;1 </r:nationalCadastralReference><gml:posList>{pos}</gml:posList></P>'
    texts = ['<F numberReturned="2">' + member(parcel("44 8 44 9 45 9")) + member(parcel("44 8 44 9")) + "</F>", member(parcel("44 8 44 9 45 9 44 8")), member(parcel("44 8 44 9 95 9")), member(parcel("44 8 x 9 45 9")), "<F numberReturned=2></F>", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    out = ingest.gml_parcels(docs, "id", "body")
    assert {r.id: (r.complete, r.ordinal, r.gml_id, r.reference, [tuple(p) for p in r.ring]) for r in out.collect()} == {
        0: (True, 0, "a", "R&1", [(8, 44), (9, 44), (9, 45), (8, 44)]), 1: (True, 0, "a", "R&1", [(8, 44), (9, 44), (9, 45), (8, 44)])}
    assert mentions(out, "posList") == 1
