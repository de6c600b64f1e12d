"""The whole pipeline on small tables: what each stage decides takes effect on what the next one sees."""

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from terraloom.llm import cube_mixing, quality_rules, secret_scan, simhash  # noqa: E402

WORDS = "the of and to in that it was for on are with as his they be at one have this from or had by hot word but what some we can out other were all there when up use your how said an each she".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
KEY = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


def prose(seed, n):
    rng = np.random.RandomState(seed)
    return " ".join(WORDS[i] + str(rng.randint(0, 50)) if i % 5 == 0 else WORDS[i] for i in rng.randint(0, len(WORDS), n))


def table():
    rows = [(i, prose(i, 60 + i % 30), "en", "abc"[i % 3]) for i in range(120)]
    rows += [(200 + i, rows[i][1], "en", "a") for i in range(10)]  # exact copies
    rows += [(300, "too short", "en", "a"), (301, None, None, None), (302, "", "en", "b"), (303, "buy " * 200, "en", "c"), (304, prose(1, 9000), "en", None)]
    rows += [(400, prose(900, 80) + f' token = "{KEY}"', "en", "b"), (5, rows[5][1], "en", "c")]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(table(), SCHEMA).write.parquet(f"{place}/documents.parquet")
    return place


def test_stages_take_effect_one_after_the_other(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    seen = {0: docs}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        out = stage(spark, seen[k - 1], made)
        out.write.parquet(f"{made}/stage{k}")
        seen[k] = spark.read.parquet(f"{made}/stage{k}")
    ids = {k: sorted((r.doc_id for r in v.select("doc_id").collect()), key=str) for k, v in seen.items()}
    good = {r.doc_id for r in quality_rules.quality_rules(docs).where("kept").select("doc_id").collect()}
    assert set(ids[1]) == good and not good & {300, 301, 302, 303} and {0, 119, 304, 400} <= good
    of = {r.doc_id: r.component_id for r in simhash.groups(seen[1]).collect()}
    assert ids[2] == sorted(set(of.values()), key=str) and not set(ids[2]) & set(range(200, 210)) and 5 in ids[2]
    assert ids[3] == ids[2]
    texts = {r.doc_id: r for r in seen[3].collect()}
    assert KEY not in texts[400].text and texts[400].n_chars == len(texts[400].text)
    assert all(r.text == texts[r.doc_id].text for r in seen[2].collect() if r.doc_id != 400)
    for k in range(4):
        assert seen[k].columns == docs.columns
    taken = {r.doc_id: r.copies for r in cube_mixing.mix(seen[3]).collect() if r.copies}
    assert {d: ids[4].count(d) for d in set(ids[4])} == taken
    pieces = seen[5].collect()
    assert {r.doc_id for r in pieces} == set(ids[4])
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
    windows = {}
    for r in pieces:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for at in windows.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= 4096


def test_run_equals_its_stages(spark, made):
    got = corpus_pipeline.run(spark, made)
    assert got.columns == spark.read.parquet(f"{made}/stage5").columns
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(got) == key(spark.read.parquet(f"{made}/stage5"))


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_masking_leaves_null_empty_and_clashing_columns(spark):
    rows = [(1, None, "a", "x"), (2, "", "a", "y"), (3, f'secret = "{KEY}" {KEY}', None, "z"), (3, f'secret = "{KEY}" {KEY}', None, "w")]
    out = secret_scan.redacted(spark.createDataFrame(rows, "doc_id long, text string, source string, live string"))
    got = sorted(((r.doc_id, r.text, r.live) for r in out.collect()), key=str)
    assert [g[1] for g in got[:2]] == [None, ""] and all(KEY not in g[1] for g in got[2:]) and {g[2] for g in got} == {"x", "y", "z", "w"}
    assert secret_scan.redacted(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
