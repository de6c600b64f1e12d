"""Document quality by a linear-chain conditional random field over lines.

Every line gets features of its own and of its two neighbours (shares of symbols, exclamation marks, capitals, digits, function
words, repeated and stuttering words, lengths, copies of the line in the document). The field labels lines good or bad; training gives all lines of
a labelled document its label. A document's quality is the mean of its lines' forward-backward marginals for good,
weighted by their length.

Scoring runs where the documents are read, one batch at a time, without a shuffle; whole texts are used. The model is a few hundred
numbers, fitted on at most ``sample`` labelled documents, drawn by a hash of the id; nothing else is collected.

Defined cases: a null or blank text is one empty line and gets the score that the model has for it; null ids are scored and
not held out; rows that repeat an id are scored one by one, and an id with several labels counts as the lowest of them; without any
labelled row all scores are 0.5; an empty table gives an empty table; labels, language, source and id are never features.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm.quality_rules import STOP_WORDS

STOPS = frozenset(STOP_WORDS)
SYMBOLS = "#*$%&|<>"
#: Upper ends of the bins of each feature; a last bin is open.
SHARE = (0.0, 0.01, 0.03, 0.07, 0.15, 0.3, 0.5)
BINS = {
    "chars": (0, 10, 40, 100, 300, 1000),
    "words": (0, 2, 5, 10, 20, 60, 200),
    "mean_word": (2, 3.5, 4.5, 5.5, 6.5, 8, 11),
    "symbols": SHARE,
    "exclaims": SHARE,
    "capitals": (0.0, 0.03, 0.08, 0.2, 0.5, 0.8),
    "digits": SHARE,
    "stops": (0.0, 0.02, 0.05, 0.1, 0.2, 0.4),
    "repeats": (0.0, 0.1, 0.25, 0.4, 0.6, 0.8),
    "stutter": SHARE,
    "copies": (0, 1, 3, 10),
}
OWN = sum(len(b) + 1 for b in BINS.values())
#: Own features, those of the line before and after (or none), and a constant.
WIDTH = 3 * (OWN + 1) + 1


def _classes() -> np.ndarray:
    """A bit field per code point of the first planes' letters: 1 symbol, 2 '!', 4 capital, 8 digit, 16 letter."""
    out = np.zeros(0x10000, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        out[i] = (c in SYMBOLS) | (c == "!") << 1 | c.isupper() << 2 | c.isdigit() << 3 | c.isalpha() << 4
    return out


_table: list[np.ndarray] = []


def raw(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Raw features (line x feature) of all lines that aren't blank, and the number of lines of each text, at least one."""
    if not _table:
        _table.append(_classes())
    lines: list[str] = []
    counts, words, copies = [], [], []
    for t in texts:
        own = [x for x in (t or "").split("\n") if x and not x.isspace()] or [""]
        counts.append(len(own))
        many: dict[str, int] = {}
        for x in own:
            many[x] = many.get(x, 0) + 1
        for x in own:
            w = x.split()
            kinds = set(w)
            n = len(w) or 1
            words.append((len(w), sum(map(len, w)) / n, sum(v in STOPS for v in map(str.lower, kinds)) / (len(kinds) or 1), 1 - len(kinds) / n, sum(map(eq, w, w[1:])) / n))
            copies.append(many[x] - 1)
        lines += own
    size = np.array([len(x) for x in lines])
    code = np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _table[0][np.minimum(code, 0xFFFF)]
    starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    n = np.maximum(size, 1)
    share = [np.add.reduceat((kind >> b) & 1, starts, dtype=np.int64) for b in range(5)]
    w = np.array(words)
    cols = [size, w[:, 0], w[:, 1], share[0] / n, share[1] / n, share[2] / np.maximum(share[4], 1), share[3] / n, w[:, 2], w[:, 3], w[:, 4], np.array(copies)]
    return np.stack(cols, axis=1), np.array(counts)


def active(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of the features that are 1, for each line: its own, its neighbours' and the constant."""
    own = np.empty((len(x), len(BINS)), np.int32)
    base = 0
    for i, ends in enumerate(BINS.values()):
        own[:, i] = base + np.searchsorted(ends, x[:, i], side="left")
        base += len(ends) + 1
    first, last = np.zeros(len(x), bool), np.zeros(len(x), bool)
    ends = np.cumsum(counts)
    first[ends - counts] = True
    last[ends - 1] = True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = OWN, OWN
    return np.concatenate([own, before + OWN + 1, after + 2 * (OWN + 1), np.full((len(x), 1), WIDTH - 1)], axis=1)


def marginals(unary: np.ndarray, counts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of each line, expected transitions summed over all documents, and log Z of each document.

    All documents step through their lines together, the longest first, so that those still running are a prefix.
    """
    order = np.argsort(-counts, kind="stable")
    start, n = (np.cumsum(counts) - counts)[order], counts[order]
    running = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right")
    emit = np.stack([np.zeros(len(unary)), unary], axis=1)
    top = emit.max(axis=1)
    emit = np.exp(emit - top[:, None])
    t = np.exp(trans - trans.max())
    alpha, scale = np.empty_like(emit), np.empty(len(unary))
    for k, m in enumerate(running):
        at = start[:m] + k
        a = emit[at] if k == 0 else (alpha[at - 1] @ t) * emit[at]
        scale[at] = a.sum(axis=1)
        alpha[at] = a / scale[at][:, None]
    beta, moves = np.ones_like(emit), np.zeros((2, 2))
    for k in range(len(running) - 1, 0, -1):
        at = start[: running[k]] + k
        ahead = emit[at] * beta[at] / scale[at][:, None]
        moves += t * (alpha[at - 1].T @ ahead)
        beta[at - 1] = ahead @ t.T
    good = alpha * beta
    doc = np.repeat(np.arange(len(counts)), counts)
    log_z = np.bincount(doc, np.log(scale) + top) + (counts - 1) * trans.max()
    return good[:, 1] / good.sum(axis=1), moves, log_z


def fit(x: np.ndarray, counts: np.ndarray, label: np.ndarray, steps: int = 200, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transition scores that maximise the labels' likelihood (Adam, with a ridge)."""
    feature = active(x, counts)
    y = np.repeat(label, counts).astype(float)
    docs = len(counts)
    theta = np.zeros(WIDTH + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label, label), counts - 1)
    for k in range(1, steps + 1):
        w, trans = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
        good, moves, _ = marginals(w[feature].sum(axis=1), counts, trans)
        off = y - good
        g = np.bincount(feature.ravel(), np.repeat(off, feature.shape[1]), WIDTH)
        g = np.concatenate([g, (seen - moves).ravel()]) / docs - decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return theta[:WIDTH], theta[WIDTH:].reshape(2, 2)


def score(texts: list[str | None], model: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    x, counts = raw(texts)
    good, _, _ = marginals(model[0][active(x, counts)].sum(axis=1), counts, model[1])
    doc = np.repeat(np.arange(len(counts)), counts)
    weight = np.maximum(x[:, 0], 1)
    return np.clip(np.bincount(doc, good * weight) / np.bincount(doc, weight), 0.0, 1.0)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if len(b):
            x, counts = raw(b["text"].tolist())
            rows = np.split(x.astype(np.float32), np.cumsum(counts)[:-1])
            yield pd.DataFrame({"quality": b["quality"], "x": [r.tobytes() for r in rows]})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 4000) -> tuple[np.ndarray, np.ndarray] | None:
    """The model, from at most ``sample`` labelled documents that are not held out."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.min("quality").alias("quality"))
    drawn = known.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(drawn), id_col).select("text", "quality")
    got = rows.mapInPandas(_features, "quality int, x binary").toPandas()
    if got.empty:
        return None
    got = got.sort_values(["quality", "x"], kind="stable")
    x = [np.frombuffer(b, np.float32).reshape(-1, len(BINS)) for b in got["x"]]
    return fit(np.concatenate(x), np.array([len(r) for r in x]), got["quality"].to_numpy())


def _scoring(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            made = [score(texts[i : i + 512], sent.value) for i in range(0, len(texts), 512)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(np.concatenate(made) if made else [], pa.float64())], names=["id", "held_out", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 4000, at_least: float = 0.3) -> DataFrame:
    """Score of every document, and the label that it predicts."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, sample))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_scoring(sent), "id long, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", F.when(F.col("score") >= at_least, 1).otherwise(0).alias("predicted"))
