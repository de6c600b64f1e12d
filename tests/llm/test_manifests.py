"""Line dedup, whitening and manifests against brute force, on small tables with nulls, ties, repeats, empty and long texts, clashing columns."""

import collections
import hashlib
import math
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.llm import line_runs, merkle, queries, whitening

DATA = "/root/testdata/sf0.001"
BLANKS = b" \t\n\r\x0b\x0c"


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


@pytest.mark.parametrize("name", ["op11_line_dedup", "op13_merkle_manifest"])
def test_query_matches_sql(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    found = con.sql(queries.ORACLES[name])
    at = [found.columns.index(c) for c in cols]
    assert collections.Counter(map(tuple, df.select(*cols).collect())) == collections.Counter(tuple(r[i] for i in at) for r in found.fetchall())


# 11 -----------------------------------------------------------------------------------------------------------------------

LINES = ["All rights reserved.", "  all Rights reserved.\t", "ÀÉ line", "àé line", "", "  ", "x", "unique", "\x0bmenu\x0c", "menu", "tail\r"]


def line_table(n=60, seed=5):
    rng = random.Random(seed)
    rows = [(k, "\n".join(rng.choice(LINES) + (str(rng.randrange(400)) if rng.random() < 0.5 else "") for _ in range(rng.randrange(1, 12)))) for k in range(n)]
    rows += [(1, rows[1][1]), (1, rows[1][1]), (None, None), (None, ""), (97, "\n\n\n"), (98, "All rights reserved.\n" * 3000), (99, "long " * 60000 + "\nmenu")]
    return rows


def dropped(rows, limit=10, least=1):
    key = lambda line: line.strip(BLANKS).lower()
    held = collections.Counter(k for _, t in rows for k in {key(x) for x in (t or "").encode().split(b"\n")})
    out = collections.Counter()
    for i, t in rows:
        lines = (t or "").encode().split(b"\n")
        left = [x for x in lines if len(key(x).decode()) < least or held[key(x)] < limit]
        out[i, len(lines), len(lines) - len(left), b"\n".join(left).decode()] += 1
    return out


@pytest.mark.parametrize("most", [500_000, 0])
def test_lines_of_many_documents_go(spark, most):
    rows = line_table()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_lines": F.lit(7), "h1": F.lit("x"), "batch": F.lit(None).cast("string")})
    got = line_runs.dedup(docs, most=most)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == dropped(rows)


def test_line_limits(spark):
    rows = line_table(30, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_runs.dedup(docs, limit=4, least=5, batches=3).collect()
    assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == dropped(rows, 4, 5)
    assert line_runs.dedup(docs.where("false")).count() == 0


def test_runs_take_batches_one_after_the_other(spark, tmp_path):
    """Runs opened again go on; compaction leaves one run a level; full keys aren't counted again."""
    folder = f"file://{tmp_path}/runs"
    rows = line_table(80, 7)
    batches = [rows[k::5] for k in range(5)]
    frame = lambda b: spark.createDataFrame(b, "doc_id long, text string")
    seen = []
    for b in batches:
        runs = line_runs.Runs(spark, folder, limit=10, buckets=3)
        runs.add(line_runs.line_keys(frame(b)).select("h1", "h2"))
        seen += b
        assert sorted(k for k, _ in runs.runs.values()) == sorted(k for k in range(4) if len(seen) and (batches.index(b) + 1) >> k & 1)
        got = line_runs.drop_lines(frame(seen), runs.frequent()).collect()
        assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == dropped(seen)
    assert runs.full
    runs.remove()


# 12 -----------------------------------------------------------------------------------------------------------------------


def exact(rows):
    """n and n * x - S of vectors of one length, as integers."""
    xs = [[math.floor(Fraction(c) * 1024) for c in v] for _, v in rows]
    sums = [sum(x[d] for x in xs) for d in range(len(xs[0]))]
    return len(xs), [[len(xs) * x[d] - sums[d] for d in range(len(sums))] for x in xs]


def whitened(rows):
    """By the definition, with Python's integers."""
    sizes = collections.Counter(len(v) for _, v in rows if v and all(c is not None and math.isfinite(c) for c in v))
    dims = max(sizes, key=lambda d: (sizes[d], d))
    good = [(i, [math.floor(1024 * c) + 100000 for c in v]) for i, v in rows if v and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    n, sums = len(good), [sum(x[d] for _, x in good) for d in range(dims)]
    around = [[n * x[d] - sums[d] for d in range(dims)] for _, x in good]
    cov = np.array([[sum(a[i] * a[j] for a in around) / n**3 for j in range(dims)] for i in range(dims)], float)
    values, axes = np.linalg.eigh(cov)
    return good, n, around, cov, values[::-1], axes[:, ::-1]


def vectors(n=300, dims=12, seed=3):
    rng = np.random.RandomState(seed)
    mix = rng.normal(size=(dims, dims))
    out = [(k, [float(x) for x in np.float32(rng.normal(size=dims) @ mix)]) for k in range(n)]
    return out + [(5, out[5][1]), (None, out[6][1]), (900, None), (901, []), (902, [float("nan")] + [0.0] * (dims - 1)), (903, [None] + [1.0] * (dims - 1)), (904, [float("-inf")] * dims), (905, [1.0, 2.0])]


def test_whitening(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"component": F.lit("x"), "n": F.lit(1)}).repartition(5)
    got = whitening.whiten(df).collect()
    good, n, around, cov, values, axes = whitened(rows)
    assert len(got) == len(good) * 8 and {r.n for r in got} == {n}
    assert collections.Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == collections.Counter((i, sum(v * v for v in a)) for (i, _), a in zip(good, around))
    by = {(r.vec_id, r.component): r for r in got}
    for k in range(8):
        want = np.array([[v / n for v in a] for a in around]) @ axes[:, k] / math.sqrt(values[k])
        have = np.array([by[i, k + 1].whitened for i, _ in good])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-8
        assert by[good[0][0], k + 1].explained == pytest.approx(values[k] / np.trace(cov), rel=1e-9)
    white = np.array([[by[i, k + 1].whitened for k in range(8)] for i, _ in good])
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10
    assert np.abs(np.cov(white.T, bias=True) - np.eye(8)).max() < 1e-10


def test_whitening_of_few_equal_and_huge_vectors(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(frame([])).count() == 0 and whitening.whiten(frame([(1, None)])).count() == 0
    one = whitening.whiten(frame([(1, [0.5, 2.0, -1.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one, key=lambda r: r.component)] == [(k, 1, 0, None, 0.0, None) for k in (1, 2, 3)]
    line = whitening.whiten(frame([(k, [float(k), 2.0 * k, 3.0]) for k in range(4)])).collect()
    assert [sum(r.component == k and r.whitened is not None for r in line) for k in (1, 2, 3)] == [4, 0, 0]
    rows = [(1, [1e308, 0.0]), (2, [-1e308, 1.0]), (3, [0.25, 3.0]), (4, [7e17, 9.0])]
    huge = {(r.vec_id, r.component): r for r in whitening.whiten(frame(rows)).collect()}
    _, around = exact(rows)
    assert len(huge) == 8 and all(huge[i, 1].deviation is None and huge[i, 1].deviation_digits == str(sum(v * v for v in a)) for (i, _), a in zip(rows, around))
    assert huge[1, 1].whitened == pytest.approx(-huge[2, 1].whitened) and abs(huge[1, 1].whitened) == pytest.approx(math.sqrt(2))
    wide = [(k, [float(k) * 1e13, float(k % 3)]) for k in range(9)]
    _, around = exact(wide)
    assert {(r.vec_id, r.deviation_digits) for r in whitening.whiten(frame(wide)).collect()} == {(i, str(sum(v * v for v in a))) for (i, _), a in zip(wide, around)}


def test_bit_planes_count_products(spark):
    values = np.array([[0, 5], [3, 1], [7, 7], [2, 0]], np.int64)
    planes = whitening._planes(values, [3, 3])
    ones = np.array([[int(np.bitwise_count(a & b).sum()) for b in planes] for a in planes])
    assert whitening._weighted(ones, [0, 3], [3, 3], 0, 1) == int((values[:, 0] * values[:, 1]).sum())
    assert whitening._weighted(ones, [0, 3], [3, 3], 1, 1) == int((values[:, 1] ** 2).sum())


# 13 -----------------------------------------------------------------------------------------------------------------------

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def leaf(row, more=0):
    i, source, lang, n, text = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, None if n is None else n + more, text)))


def climb(nodes):
    """Levels of a tree up to its one node."""
    out = [nodes]
    while len(out[-1]) > 1:
        now = out[-1]
        out.append([sha("".join(now[k : k + 2])) for k in range(0, len(now), 2)])
    return out


def way(levels, at):
    return [(at >> k & 1, row[(at >> k) ^ 1] if (at >> k) ^ 1 < len(row) else "") for k, row in enumerate(levels[:-1])]


def proved(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, out = [], collections.Counter()
    groups = [sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs]
    trees = [climb([leaf(r) for r in group]) for group in groups]
    crown = climb([t[-1][0] for t in trees])
    for g, group in enumerate(groups):
        for at, r in enumerate(group):
            steps = way(trees[g], at) + way(crown, g)
            node = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
            for right, other in steps:
                node = sha(other + node if right else node + other)
            out[r[0], leaf(r), trees[g][-1][0], crown[-1][0], sha("".join(o for _, o in steps)), node, node == crown[-1][0]] += 1
    return out


def manifested(df):
    got = merkle.manifest(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return collections.Counter(map(tuple, got.collect()))


def test_manifest(spark):
    rng = random.Random(1)
    rows = [(rng.choice([k, k * 40000, -k, 2**62 + k]), rng.choice(["a", None]), rng.choice(["en", "en", "en", "de", "é", "", None]), rng.choice([k, None]), rng.choice(["t%d" % k, "", None, "long " * 5000])) for k in range(150)]
    rows += [(7, "s", "en", 5, "same")] * 40 + [(7, "s", "en", k, "tie") for k in range(30)] + [(None, "s", "en", k, None) for k in range(5)] + [(None, None, None, None, None)] * 3 + [(1, "s", "only", 2**63 - 1, "x")]
    rows += [(k, "s", "dense", 1, "") for k in range(-200, 600, 2)] + [(k, "s", "dense", 2, "") for k in range(0, 600, 6)]
    df = spark.createDataFrame(rows, COLUMNS).withColumns({"slot": F.lit("x"), "g": F.lit(2), "leaf": F.lit(None).cast("int")})
    assert manifested(df.repartition(3)) == proved(rows)


@pytest.mark.parametrize("rows", [[], [(3, "a", "en", 1, "x")], [(3, "a", None, 1, "x")] * 2, [(k, "a", "l%d" % k, 1, "x") for k in range(5)]])
def test_small_manifests(spark, rows):
    assert manifested(spark.createDataFrame(rows, COLUMNS)) == (proved(rows) if rows else collections.Counter())


def test_manifest_of_several_rounds(spark, monkeypatch):
    """Blocks of four slots make many rounds, in the groups and over them."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    rows = [(k, "s", "g%03d" % (k % 19 if k % 3 else 0), k, "") for k in range(330)]
    assert merkle._up.__globals__["LEVELS"] == 2
    with pytest.MonkeyPatch.context() as m:
        # The tasks' code is pickled by reference, so what they do with a block is asked here.
        m.setattr(merkle, "LEVELS", 2)
        nodes = [sha(str(k)) for k in range(11)]
        tree = climb(nodes)
        assert list(merkle._steps(nodes, 4))[10] == ["-", "L" + tree[1][4], "-", "L" + tree[3][0]]
    monkeypatch.undo()
    assert manifested(spark.createDataFrame(rows, COLUMNS)) == proved(rows)


def test_ranks_of_ids(spark):
    """Chunks with bitmaps, sparse chunks, repeats: every row's place is its number in order."""
    rng = random.Random(2)
    ids = [rng.randrange(-40000, 40000) for _ in range(3000)] + [5] * 100 + [rng.randrange(-(2**63), 2**63) for _ in range(200)] + [2**63 - 1, -(2**63)]
    leaves = spark.createDataFrame([(0, i, sha(str(k)), "") for k, i in enumerate(ids)], "g long, id long, leaf string, given string")
    got = sorted((r.slot, r.id, r.leaf) for r in merkle._placed(leaves).collect())
    assert got == [(n, i, x) for n, (i, x) in enumerate(sorted((i, sha(str(k))) for k, i in enumerate(ids)))]


def test_more_leaves_than_a_block(spark):
    rows = [(k, None, "a" if k % 5 else "b", None, None) for k in range(12000)]
    assert manifested(spark.createDataFrame(rows, COLUMNS)) == proved(rows)
