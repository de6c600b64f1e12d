"""Re-Pair grammar compression of token ids, in files with random access.

Documents are tokenised where they are read and dealt to ranges of ascending id. Within a range, in order of id, they
are cut into shards of a bounded number of ids; each shard is compressed by replacing its frequent pairs of symbols by nonterminals, round
after round, until no pair is found often enough to pay for its rule. A file row holds one shard: the rules, the number of ids that each rule stands for, the
remaining sequence, and ids and lengths of its documents. A stretch of ids is decoded by looking up, in the running sum of
expansion lengths, which symbols cover it.

The ranges' bounds are quantiles of the id column alone (at most ``ranges`` numbers), so texts are shuffled only once, as ids.

Defined cases: a null text counts as empty and has only the end id; null ids come last; rows that repeat an id follow
each other; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm.common import shared_dir
from terraloom.llm.packing import narrowed, tokenising

#: Ids per shard; a pair is frequent from this count on: its rule costs two symbols and a length, so fewer uses don't pay for it.
SHARD, FREQUENT = 1 << 20, 4
NONE = 2**31 - 1  # rank of what isn't frequent
FIRST = 1 << 16  # nonterminals are numbered from here
FILE = "range int, shard int, first_id long, n_ids long, doc_id binary, missing int, doc_length binary, rules binary, rule_length binary, sequence binary"


def _classes(a: np.ndarray, b: np.ndarray, h: np.ndarray, buckets: int) -> np.ndarray:
    """For each pair (a, b) the place of one pair that equals it, the same for all equal ones; h is a hash of the pair below buckets."""
    table = np.empty(buckets, np.int32)
    every = np.arange(len(a), dtype=np.int32)
    # One pair per bucket stands for its equals; what differs from it goes around again.
    table[h] = every
    out = table[h]
    todo = np.flatnonzero((a != a[out]) | (b != b[out]))
    while len(todo):
        table[h[todo]] = every[todo]
        out[todo] = table[h[todo]]
        todo = todo[(a[todo] != a[out[todo]]) | (b[todo] != b[out[todo]])]
    return out


def frequent_pairs(s: np.ndarray, asked: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places among ``asked`` of s (sorted) where a pair begins that is found ``least`` times there, its rank by falling count, and the pairs by rank."""
    bits = min(20, max(8, len(asked).bit_length() + 1))
    a, b = s[asked], s[asked + 1]
    h = ((a.astype(np.uint32) * np.uint32(0x9E3779B1) + b.astype(np.uint32) * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)).astype(np.int32)
    of = _classes(a, b, h, 1 << bits)
    n = np.bincount(of, minlength=len(of))
    chosen = np.flatnonzero(n >= least)
    chosen = chosen[np.lexsort((b[chosen], a[chosen], -n[chosen]))]
    named = np.full(len(of), -1, np.int32)
    named[chosen] = np.arange(len(chosen), dtype=np.int32)
    rank = named[of]
    some = rank >= 0
    return asked[some], rank[some], np.stack([a[chosen], b[chosen]], axis=1)


def compress(ids: np.ndarray, least: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(rules, sequence): rule k is the pair that symbol FIRST + k stands for."""
    s, rules, known = ids.astype(np.int32), [], 0
    asked = np.arange(len(s) - 1, dtype=np.int32)
    while len(asked):
        place, rank, pairs = frequent_pairs(s, asked, least)
        if not len(pairs):
            break
        beside = place[1:] - place[:-1] == 1
        before, after = np.full((2, len(rank)), NONE, np.int32)
        before[1:][beside], after[:-1][beside] = rank[:-1][beside], rank[1:][beside]
        # A pair is replaced where it is more frequent than the pairs that overlap it; in a run of one symbol, at every other place.
        at = np.flatnonzero((rank <= before) & (rank <= after))
        if (runs := rank[at] == before[at]).any():
            heads, some = np.flatnonzero(rank != before), at[runs]
            start = heads[np.searchsorted(heads, some, side="right") - 1]
            runs[runs] = (some - start - (rank[start] > before[start])) % 2 == 1
            at = at[~runs]
        good = np.bincount(rank[at], minlength=len(pairs)) >= least
        at = at[good[rank[at]]]
        if not len(at):
            break
        named = np.cumsum(good) - 1
        made = place[at]
        s[made] = (FIRST + known + named.astype(np.int32))[rank[at]]
        gone = np.zeros(len(s), bool)
        gone[made + 1] = True
        before = np.cumsum(gone, dtype=np.int32)
        s = s[~gone]
        # A pair that wasn't frequent never will be; left to ask are frequent pairs that stayed and pairs with a new symbol.
        live = np.zeros(len(s), bool)
        stayed = place[~gone[place]]
        live[stayed - before[stayed]] = True
        new = made - before[made]
        live[new] = True
        live[np.maximum(new - 1, 0)] = True
        asked = np.flatnonzero(live[:-1]).astype(np.int32)
        rules.append(pairs[good])
        known += int(good.sum())
    return (np.concatenate(rules) if rules else np.zeros((0, 2))).astype(np.int32), s


def expansion_lengths(rules: np.ndarray) -> np.ndarray:
    """Ids that each rule stands for; a rule uses only earlier ones."""
    out = np.zeros(len(rules), np.int64)
    todo = np.arange(len(rules))
    size = lambda x: np.where(x < FIRST, 1, out[np.maximum(x - FIRST, 0)])
    while len(todo):
        a, b = size(rules[todo, 0]), size(rules[todo, 1])
        ready = (a > 0) & (b > 0)
        out[todo[ready]] = (a + b)[ready]
        todo = todo[~ready]
    return out


def _by_levels(symbols: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for, all of one level at a time."""
    s = symbols
    while (big := s >= FIRST).any():
        at = np.concatenate([[0], np.cumsum(1 + big)])
        out = np.empty(at[-1], np.int32)
        out[at[:-1]] = np.where(big, rules[np.where(big, s - FIRST, 0), 0] if len(rules) else s, s)
        out[at[:-1][big] + 1] = rules[s[big] - FIRST, 1]
        s = out
    return s


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """The ids that symbols stand for: each rule that occurs is expanded once, then all are copied in one go."""
    big = symbols >= FIRST
    if not big.any():
        return symbols
    lengths = expansion_lengths(rules) if lengths is None else lengths
    used, which = np.unique(symbols[big], return_inverse=True)
    n = lengths[used - FIRST]
    table = np.concatenate([_by_levels(used, rules), symbols[~big]])
    size, start = np.ones(len(symbols), np.int64), np.empty(len(symbols), np.int64)
    size[big], start[big] = n[which], (np.cumsum(n) - n)[which]
    start[~big] = n.sum() + np.arange(np.count_nonzero(~big))
    return table[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def part(rules: np.ndarray, rule_length: np.ndarray, sequence: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a shard; only the symbols that cover them are expanded."""
    ends = np.cumsum(np.where(sequence < FIRST, 1, rule_length[np.maximum(sequence - FIRST, 0)] if len(rules) else 1))
    i, j = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
    skipped = int(ends[i - 1]) if i else 0
    return expand(sequence[i:j], rules, rule_length)[start - skipped : stop - skipped]


def _ranging(bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            at = np.searchsorted(bounds, ids.fill_null(0).to_numpy(), side="left")
            at[ids.is_null().to_numpy(zero_copy_only=False)] = len(bounds) + 1
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), ids, b.column("ids")], names=["range", "doc_id", "ids"])

    return run


def _compressing(shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FILE.split(", ")]
        now, shard, first = None, 0, 0
        held: list[tuple[int | None, np.ndarray]] = []

        def row() -> pa.RecordBatch:
            lengths = np.array([len(x) for _, x in held], "<i8")
            rules, seq = compress(np.concatenate([x for _, x in held]))
            blobs = (np.array([d or 0 for d, _ in held], "<i8"), lengths, rules.astype("<i4"), expansion_lengths(rules).astype("<i8"), seq.astype("<i4"))
            doc, length, *rest = (x.tobytes() for x in blobs)
            values = [now, shard, first, int(lengths.sum()), doc, int(held[0][0] is None), length, *rest]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        size = 0
        for b in batches:
            for r, d, x in zip(b.column("range").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids")):
                if held and (r != now or size >= shard_ids):
                    yield row()
                    shard, first, held, size = shard + 1, first + size, [], 0
                if r != now:
                    now, shard, first = r, 0, 0
                held.append((d, np.frombuffer(x.as_py(), "<u2")))
                size += len(held[-1][1])
        if held:
            yield row()

    return run


def write(docs: DataFrame, folder: str, path: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD, range_rows: int = 4096, ranges: int = 4096) -> None:
    """Writes the ids of all documents, in ascending order of id, as compressed shards under folder."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    n = ids.count()
    cuts = min(ranges, n // range_rows)
    bounds = ids.select(F.percentile_approx("doc_id", [k / (cuts + 1) for k in range(1, cuts + 1)], 100_000)).first()[0] if cuts else []
    encode, place = tokenising(path, True, end), _ranging(np.unique(np.array(bounds or [], np.int64)))
    # One Python worker does both: a second operator would hold a second process per task.
    dealt = narrowed(docs, id_col, text_col).mapInArrow(lambda batches: place(encode(batches)), "range int, doc_id long, ids binary")
    ordered = dealt.repartition(max(1, min(cuts + 1, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "range").sortWithinPartitions("range", "doc_id", "ids")
    ordered.mapInArrow(_compressing(shard_ids), FILE).write.option("compression", "zstd").parquet(folder)


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            rules = np.frombuffer(r["rules"], "<i4").reshape(-1, 2)
            ids = expand(np.frombuffer(r["sequence"], "<i4"), rules, np.frombuffer(r["rule_length"], "<i8")).astype("<u4")
            n = np.frombuffer(r["doc_length"], "<i8")
            ends = np.cumsum(n)
            crc = [zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(ends, n)]
            doc = pa.array(np.frombuffer(r["doc_id"], "<i8"), mask=np.full(len(n), bool(r["missing"])))
            cols = [pa.array(np.full(len(n), r["range"]), pa.int32()), doc, pa.array(r["first_id"] + ends - n), pa.array(n), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["range", "doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, decoded from the files: ids of all documents before it, its number of ids, and their checksum."""
    files = spark.read.schema(FILE).parquet(folder)
    # One row per range, at most as many as write() was told to make.
    before, offsets = 0, []
    for r in files.groupBy("range").agg(F.sum("n_ids").alias("n")).orderBy("range").collect():
        offsets.append((r["range"], before))
        before += r["n"]
    at = spark.createDataFrame(offsets, "range int, before long")
    docs = files.mapInArrow(_reading, "range int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(at), "range").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str, **options) -> DataFrame:
    """write() to a new place in the shared folder, then read()."""
    folder = f"{shared_dir(docs.sparkSession)}/repair-{uuid.uuid4().hex}"
    write(docs, folder, path, **options)
    return read(docs.sparkSession, folder)
