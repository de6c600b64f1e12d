"""Lexical retrieval packing: windows of tokens filled with documents that share their words.

Documents are dealt by their words to shards of a bounded number of tokens: a tree of spherical k-means over hashed BM25 vectors, fitted on a
sample, puts documents that share telling words in one leaf; small leaves beside each other share a shard, and a leaf beyond the bound (copies
of one document) is spread over several by a hash of a row number that is written with the rows. Each shard holds a BM25 inverted index of its
documents, with document frequencies and mean length of the whole corpus. The first unused document is the seed of a window; the index
returns unused neighbours by BM25 score of all the seed's terms, as many as the window takes, and they fill it greedily; what doesn't fit is cut
and seeds the next window. Documents that share no term with the seed are taken in order. The last window of a shard is cut into
powers of two, which need no padding, so no sequence is padded at all.

What this leaves out: a corpus of more than one shard is searched within the seed's shard only, so a neighbour that the tree deals elsewhere isn't found
(README has the measured share).

Token ids are written once to the shared folder and shuffled once. The tree works on whole numbers, so redone work deals alike.

Defined cases: a null text counts as empty and has only the end id; null ids are kept; rows that repeat an id are packed one
by one; a document longer than a window fills windows of its own first; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import parts, written
from terraloom.llm.tokens import encoder

WINDOW = 4096
K1, B = 1.2, 0.75
#: Neighbours fetched first; each further fetch takes four times as many.
FETCH = 64
#: Width of hashed vectors, children of a node, sampled documents a shard and at most, rounds of k-means.
WIDTH, BRANCH, PER_SHARD, SAMPLE, ROUNDS = 256, 16, 64, 1 << 16, 8
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenising(path: str, blank_joins: bool, end: int):
    tail = np.array([end], dtype="<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for i in range(0, len(texts), 256):
                ids = [x + tail for x in encoder(path, blank_joins).encode(texts[i : i + 256])]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, 256), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def narrowed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def tokenised(docs: DataFrame, path: str, blank_joins: bool, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every row's text and the end id, as little-endian unsigned 16-bit numbers."""
    return narrowed(docs, id_col, text_col).mapInArrow(tokenising(path, blank_joins, end), "doc_id long, ids binary")


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, tokens = np.zeros(size, np.int64), 0, 0
        for b in batches:
            for x in b.column("ids"):
                ids = np.frombuffer(x.as_buffer(), "<u2")
                df[terms_of(ids)[0]] += 1
                docs, tokens = docs + 1, tokens + len(ids)
        t = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([t, [-1, -2]]), pa.int32()), pa.array(np.concatenate([df[t], [docs, tokens]]), pa.int64())], names=["t", "n"])

    return run


def terms_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their counts; numpy sorts 16-bit numbers by radix."""
    s = np.sort(ids, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[at], np.diff(at, append=len(s))


def telling(ids: np.ndarray, idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their BM25 weights in a document."""
    t, tf = terms_of(ids)
    return t, idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean))


def sketches(docs: list[np.ndarray], idf: np.ndarray, mean: float) -> np.ndarray:
    """Hashed vectors of BM25 weight times idf, so that their products stand for scores; whole numbers, whose sums are exact in any order."""
    draw = np.random.RandomState(7)
    place, sign = draw.randint(0, WIDTH, len(idf)), draw.randint(0, 2, len(idf)) * 2.0 - 1
    out = np.zeros((len(docs), WIDTH))
    for i, ids in enumerate(docs):
        t, w = telling(ids, idf, mean)
        out[i] = np.bincount(place[t], sign[t] * np.minimum(np.rint(16 * w * idf[t]), 1 << 20), WIDTH)
    return out


class Tree:
    """Leaves of at most so many tokens, as far as the sampled documents differ; leaves in order make shards."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, tokens: int, shard_tokens: int):
        self.nodes: list[tuple[np.ndarray, list[int]]] = []  # centres, and children: a node, or -1 - leaf
        leaves: list[float] = []
        each = sizes * (tokens / max(1, sizes.sum()))
        unit = vectors / np.maximum(np.sqrt((vectors**2).sum(1)), 1e-9)[:, None]

        def grown(at: np.ndarray) -> int:
            total = each[at].sum()
            k = int(min(BRANCH, -(-total // shard_tokens), len(at)))
            if k > 1:
                centres = np.rint(1024 * self.means(unit[at], k))
                to = (vectors[at] @ centres.T).argmax(1)
                some = np.unique(to)
                if len(some) > 1:
                    self.nodes.append((centres[some], []))
                    me = len(self.nodes) - 1
                    for c in some:
                        self.nodes[me][1].append(grown(at[to == c]))
                    return me
            leaves.append(total)
            return -len(leaves)

        self.root = grown(np.arange(len(vectors))) if len(vectors) else -1
        self.count = max(1, len(leaves))

    def dealt(self, totals: np.ndarray, shard_tokens: int) -> "Tree":
        """Sets each leaf's first shard and the number of its shards by the leaves' tokens."""
        self.first, self.spread, full, now = [], [], 0.0, 0
        for total in totals:
            n = max(1, int(-(-total // shard_tokens)))
            if full and full + total > shard_tokens:
                now, full = now + 1, 0.0
            self.first.append(now)
            self.spread.append(n)
            now, full = (now + n, 0.0) if n > 1 else (now, full + total)
        return self

    @staticmethod
    def means(unit: np.ndarray, k: int) -> np.ndarray:
        """Spherical k-means from spread-out starts."""
        centres, near = [unit[0]], unit @ unit[0]
        for _ in range(k - 1):
            centres.append(unit[near.argmin()])
            near = np.maximum(near, unit @ centres[-1])
        now = np.array(centres)
        for _ in range(ROUNDS):
            to = (unit @ now.T).argmax(1)
            sums = np.array([unit[to == c].sum(0) if (to == c).any() else now[c] for c in range(k)])
            now = sums / np.maximum(np.sqrt((sums**2).sum(1)), 1e-9)[:, None]
        return now

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros(len(vectors), np.int64)
        todo = [(self.root, np.arange(len(vectors)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = -1 - node
                continue
            centres, children = self.nodes[node]
            to = (vectors[at] @ centres.T).argmax(1)
            todo += [(child, at[to == c]) for c, child in enumerate(children) if (to == c).any()]
        return out


def _arrays(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u2") for x in b.column("ids")]


def _sampling(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = _arrays(b)
            v = sketches(docs, *sent.value).astype("<i4")
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([len(d) for d in docs], pa.int64()), pa.array([x.tobytes() for x in v], pa.binary())], names=["row", "size", "v"])

    return run


def _weighing(sent, tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(tree.value.count, np.int64)
        for b in batches:
            docs = _arrays(b)
            np.add.at(totals, tree.value.leaves(sketches(docs, *sent.value)), [len(d) for d in docs])
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(totals[some], pa.int64())], names=["leaf", "size"])

    return run


def _dealing(sent, tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, spread = np.array(tree.value.first), np.array(tree.value.spread)
        for b in batches:
            leaf = tree.value.leaves(sketches(_arrays(b), *sent.value))
            shard = first[leaf] + b.column("salt").to_numpy() % spread[leaf]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), b.column("row"), pa.array(shard, pa.int64())], names=["doc_id", "ids", "row", "shard"])

    return run


class Index:
    """BM25 over the documents of one shard; postings are grouped by term, those of common terms are rows of a matrix."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        owners, weights = [], []
        self.terms: list[np.ndarray] = []
        for i, ids in enumerate(docs):
            t, w = telling(ids, idf, mean)
            self.terms.append(t)
            owners.append(np.full(len(t), i, np.int32))
            weights.append(w.astype(np.float32))
        terms = np.concatenate(self.terms)
        order = np.argsort(terms, kind="stable")
        self.owner, self.weight = np.concatenate(owners)[order], np.concatenate(weights)[order]
        self.at = np.searchsorted(terms[order], np.arange(len(idf) + 1))
        self.n = len(docs)
        common = np.flatnonzero(np.diff(self.at) > max(16, self.n // 16))
        self.row = np.full(len(idf), -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), self.n), np.float32)
        for k, t in enumerate(common):
            s = slice(self.at[t], self.at[t + 1])
            self.matrix[k, self.owner[s]] = self.weight[s]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for all terms of the seed."""
        t = self.terms[seed]
        row = self.row[t]
        asked = np.zeros(len(self.matrix), np.float32)
        asked[row[row >= 0]] = 1
        spans = [slice(a, b) for a, b in zip(self.at[t[row < 0]], self.at[t[row < 0].astype(np.int64) + 1])]
        rare = np.bincount(np.concatenate([self.owner[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n) if spans else np.zeros(self.n)
        return rare + asked @ self.matrix

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """All unused documents that share a term, by falling score, ties in order; fetched as they are asked for."""
        score = self.scores(seed)
        score[used] = 0
        k = FETCH
        while (n := np.count_nonzero(score)) > 0:
            if k < n:
                # Whatever ties with the last one comes along, so that ties stay in order.
                best = np.flatnonzero(score >= np.partition(score, self.n - k)[self.n - k])
            else:
                best = np.flatnonzero(score)
            yield from best[np.lexsort((best, -score[best]))]
            score[best] = 0
            k *= 4


def fill(sizes: np.ndarray, neighbours, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length); neighbours(seed, used) names unused documents until the window is full."""
    used = np.zeros(len(sizes), bool)
    out: list[list[tuple[int, int, int]]] = []
    now: list[tuple[int, int, int]] = []
    room, following = window, 0

    def put(doc: int, start: int) -> tuple[int, int] | None:
        """Adds what fits; the rest of the document, if it was cut."""
        nonlocal room, now
        n = min(room, int(sizes[doc]) - start)
        now.append((doc, start, n))
        room -= n
        if not room:
            out.append(now)
            now, room = [], window
        return (doc, start + n) if start + n < sizes[doc] else None

    rest: tuple[int, int] | None = None
    while True:
        if rest is None:
            while following < len(sizes) and used[following]:
                following += 1
            if following == len(sizes):
                break
            rest = (following, 0)
            used[following] = True
        seed = rest[0]
        while rest and (rest := put(*rest)) is not None:
            pass
        if now:
            for d in neighbours(seed, used):
                used[d] = True
                rest = put(int(d), 0)
                if not now:
                    break
            if now:
                continue
    if now:  # the last one: powers of two need no padding
        todo, left = now[::-1], window - room
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            seq = []
            while size:
                doc, start, n = todo.pop()
                if n > size:
                    todo.append((doc, start + size, n - size))
                    n = size
                seq.append((doc, start, n))
                size -= n
            out.append(seq)
    return out


def _packing(sent, window: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        idf, mean = sent.value
        order = np.argsort(table.column("row").to_numpy(), kind="stable")
        doc_ids = table.column("doc_id").to_pylist()
        blobs = table.column("ids").combine_chunks()
        docs = [np.frombuffer(blobs[int(i)].as_buffer(), "<u2") for i in order]
        index = Index(docs, idf, mean)
        cols: list[list] = [[] for _ in range(7)]
        base = key[0].as_py() << 32
        for k, seq in enumerate(fill(np.array([len(d) for d in docs]), index.neighbours, window)):
            offset = 0
            for d, start, n in seq:
                crc = zlib.crc32(docs[d][start : start + n].astype("<u4").tobytes())
                for c, v in zip(cols, (doc_ids[order[d]], start, n, crc, len(docs[d]), base + k, offset)):
                    c.append(v)
                offset += n
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in PIECE.split(", ")])

    return run


def pack(docs: DataFrame, path: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_tokens: int = 2_000_000, vocabulary: int = 1 << 16) -> DataFrame:
    """A row per piece: its document, the place in it, the sequence that holds it and the place there."""
    spark = docs.sparkSession
    rows = written(tokenised(docs, path, False, end, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "tokens")
    # One number per id of the vocabulary: bounded, whatever the corpus.
    df = np.zeros(vocabulary, np.int64)
    total = {-1: 0, -2: 0}
    for t, n in rows.mapInArrow(_frequencies(vocabulary), "t int, n long").groupBy("t").agg(F.sum("n")).collect():
        if t < 0:
            total[t] = n
        else:
            df[t] = n
    count, tokens = total[-1], total[-2]
    idf = np.log1p((count - df + 0.5) / (df + 0.5))
    sent = spark.sparkContext.broadcast((idf.astype(np.float64), tokens / max(count, 1)))
    shards = max(1, -(-tokens // shard_tokens))
    if shards == 1:
        dealt = rows.withColumn("shard", F.lit(0).cast("long"))
    else:
        # The sample decides where leaves begin and end; every row is weighed and dealt by its own words.
        wanted = min(SAMPLE, PER_SHARD * shards)
        drawn = rows.where(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(1 << 32)) < int((1 << 32) * min(1.0, wanted / count)))
        sample = sorted(drawn.select("row", "ids").mapInArrow(_sampling(sent), "row long, size long, v binary").collect())
        vectors = np.array([np.frombuffer(r.v, "<i4") for r in sample], np.float64).reshape(-1, WIDTH)
        tree = Tree(vectors, np.array([r["size"] for r in sample], np.float64), tokens, shard_tokens)
        weighed = rows.mapInArrow(_weighing(sent, spark.sparkContext.broadcast(tree)), "leaf long, size long").groupBy("leaf").agg(F.sum("size").alias("n"))
        totals = np.zeros(tree.count)
        for r in weighed.collect():
            totals[r.leaf] = r.n
        tree = spark.sparkContext.broadcast(tree.dealt(totals, shard_tokens))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(1 << 40)))
        dealt = salted.mapInArrow(_dealing(sent, tree), "doc_id long, ids binary, row long, shard long")
    return dealt.repartition(parts(docs), "shard").groupBy("shard").applyInArrow(_packing(sent, window), PIECE)
