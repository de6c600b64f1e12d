"""Mixing sources to target weights by balanced sampling with the cube method.

Each source has a target in words. A document of a source is repeated ``target / source size`` times on average: the whole
part of that rate is certain, the fraction is an inclusion probability. The flight phase moves the probabilities of
three documents at a time along a direction in the null space of the two balancing constraints (words, documents) until
at most two per block are neither 0 nor 1; totals don't move. Blocks of bounded size, by a hash of the document,
fly in parallel; what is left of them flies again in fewer blocks, until one block per source is left, where the last one
or two documents land on the rounding that changes the words least.

Only (source, key, size) rows are shuffled, never texts. A source may hold any share of the rows: its blocks are dealt out
like all others. Random numbers come from a hash of block and seed, and blocks are sorted, so reruns agree.

Defined cases: a null text has size 0; null sources form a source of their own, which comes last; rows that repeat
document and text share one decision row, in which whole repeats are counted first; documents of size 0 take no words
(``taken`` 0); an empty table gives an empty table. A source whose words are all in one document is off its target by
at most half of that document. Other columns of the input are ignored by mix() and kept by mixed().
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import n_words, parts, written

BLOCK = 1024
CLOSE = 1e-9


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """Target words per source from (source, source_size): weights repeat over the sources by code point, null last.

    Filling by weight with a ceiling for each source: in order of ceiling per weight, the first sources stay at their ceiling
    and the rest share what is left by weight; the first source at which that share fits fixes the level for all.
    """
    every = Window.partitionBy()
    ranked = sizes.select("source", "source_size", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())).alias("n"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    top = F.col("source_size") * limit
    ranked = ranked.select("source", "source_size", "n", weight.alias("w"), top.alias("top"))
    before = every.orderBy(F.col("top") / F.col("w"), "n").rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("w") <= F.col("top"), F.col("level"))
    # Levels rise until the first that fits and fall after it never below; the smallest that fits is that first one.
    first = F.min_by("level", F.when(fits.isNotNull(), F.struct(F.col("top") / F.col("w"), F.col("n")))).over(every)
    ranked = ranked.withColumn("first", first)
    return ranked.select("source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("first") * F.col("w"), F.col("top"))).alias("target"))


def fly(size: np.ndarray, pi: np.ndarray, rng: np.random.RandomState, last: bool) -> np.ndarray:
    """Probabilities after the flight phase, in the order given; with ``last``, after landing too."""
    out, n = pi.astype(float).copy(), len(pi)
    draws = rng.random_sample(2 * n + 4)
    hand: list[int] = []
    used = 0

    def move(units: list[int], way: list[float]) -> None:
        """Along the direction or against it, to the nearer wall, by chances that keep the mean."""
        nonlocal used
        ahead = min(((1 - out[k]) / v if v > 0 else out[k] / -v) for k, v in zip(units, way) if v)
        back = min((out[k] / v if v > 0 else (1 - out[k]) / -v) for k, v in zip(units, way) if v)
        step = ahead if draws[used % len(draws)] * (ahead + back) < back else -back
        used += 1
        for k, v in zip(units, way):
            x = out[k] + step * v
            out[k] = 0.0 if x < CLOSE else 1.0 if x > 1 - CLOSE else x

    for k in range(n):
        if 0 < out[k] < 1:
            hand.append(k)
        while len(hand) == 3:
            a, b, c = hand
            way = [size[b] - size[c], size[c] - size[a], size[a] - size[b]]
            scale = max(map(abs, way))
            move(hand, [v / scale for v in way] if scale else [1.0, -1.0, 0.0])
            hand = [x for x in hand if 0 < out[x] < 1]
    if last:
        while len(hand) == 2:
            a, b = hand
            scale = max(size[a], size[b])
            move(hand, [size[b] / scale, -size[a] / scale] if size[a] and size[b] else [1.0, 0.0] if size[b] else [0.0, 1.0])
            hand = [x for x in hand if 0 < out[x] < 1]
        for k in hand:
            out[k] = float(out[k] >= 0.5)
    return out


def _flight(seed: int):
    def flight(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "key"], ascending=[False, True], kind="stable").reset_index(drop=True)
        rng = np.random.RandomState((seed * 1_000_003 + int(rows["block"].iloc[0]) * 7919 + int(rows["source_key"].iloc[0]) % 2_147_483_647) % 4_294_967_291)
        rows["pi"] = fly(rows["size"].to_numpy(float), rows["pi"].to_numpy(float), rng, bool(rows["last"].iloc[0]))
        return rows[["source_key", "key", "size", "pi"]]

    return flight


def decide(units: DataFrame, block: int = BLOCK, seed: int = 1) -> DataFrame:
    """(source_key, key, pi of 0 or 1) of units (source_key, key, size, pi): flights in blocks until one block a source lands."""
    n = parts(units)
    done: DataFrame | None = None
    todo, level = units, 0
    while True:
        counts = todo.groupBy("source_key").agg(F.ceil(F.count("*") / block).alias("blocks"))
        dealt = todo.join(counts, "source_key").withColumns(
            {"block": F.pmod(F.xxhash64("key", F.lit(level)), "blocks"), "last": F.col("blocks") == 1}
        )
        flown = written(
            dealt.repartition(n, "source_key", "block").groupBy("source_key", "block").applyInPandas(_flight(seed + level), "source_key long, key long, size double, pi double"), "flight"
        )
        settled = flown.where("pi = 0 or pi = 1").select("source_key", "key", "pi")
        done = settled if done is None else done.unionByName(settled)
        todo = flown.where("pi > 0 and pi < 1")
        level += 1
        if todo.isEmpty():
            return done


def _unit_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col), F.length(F.col(text_col)))


def _plan(rows: DataFrame, weights: tuple[int, ...], share: float, limit: float, block: int, seed: int) -> DataFrame:
    """rows (key, source, size) -> a row per (source, key): copies of every repeat, and how many repeats get one more."""
    units = written(rows.groupBy("source", "key", "size").agg(F.count("*").alias("m")), "units")
    sizes = units.groupBy("source").agg(F.sum(F.col("m") * F.col("size")).alias("source_size"))
    aim = targets(sizes, weights, share, limit).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    aim = written(aim.withColumn("source_key", F.xxhash64(F.col("source"), F.col("source").isNull())), "targets")
    planned = units.join(aim, units["source"].eqNullSafe(aim["source"])).select(
        units["source"], "source_key", "key", "size", "m", "source_size", "target", F.floor("rate").alias("copies"), ((F.col("rate") - F.floor("rate")) * F.col("m")).alias("more")
    )
    planned = planned.withColumn("pi", F.col("more") - F.floor("more"))
    flying = planned.where((F.col("pi") > CLOSE) & (F.col("pi") < 1 - CLOSE) & (F.col("size") > 0))
    chosen = decide(flying.select("source_key", "key", F.col("size").cast("double").alias("size"), "pi"), block, seed)
    out = planned.join(chosen.select("source_key", "key", F.col("pi").alias("won")), ["source_key", "key"], "left")
    return out.select("source", "key", "size", "source_size", "target", "m", "copies", (F.floor("more") + F.coalesce("won", F.round("pi")).cast("long")).alias("extra"))


def _decided(docs: DataFrame, id_col: str, text_col: str, source_col: str, whole: bool, weights, share, limit, block, seed) -> DataFrame:
    base = [F.col(id_col).alias("__id"), _unit_key(id_col, text_col).alias("__key"), F.col(source_col).alias("__source"), n_words(F.col(text_col)).alias("__size")]
    rows = docs.select(*base)
    if not whole:
        rows = written(rows, "sizes")
    plan = _plan(rows.select(F.col("__key").alias("key"), F.col("__source").alias("source"), F.col("__size").alias("size")), weights, share, limit, block, seed)
    plan = plan.select(*[F.col(c).alias(f"__{c}" if c in ("key", "source", "size") else f"__p_{c}") for c in plan.columns])
    left = docs.select(*base, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")) if whole else rows
    met = (left["__key"] == plan["__key"]) & left["__source"].eqNullSafe(plan["__source"]) & (left["__size"] == plan["__size"])
    joined = left.join(plan, met).select(*[left[c] for c in left.columns], *[c for c in plan.columns if c.startswith("__p_")])
    # Repeats of a row are the same, so any order among them gives the same result.
    place = F.when(F.col("__p_m") == 1, F.lit(1)).otherwise(F.row_number().over(Window.partitionBy("__source", "__key", "__size").orderBy("__id")))
    return joined.withColumn("__times", F.col("__p_copies") + (place <= F.col("__p_extra")).cast("long"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, block: int = BLOCK, seed: int = 1
) -> DataFrame:
    """Per document: its size in words, its source's size and target, and the words that the mix takes of it."""
    out = _decided(docs, id_col, text_col, source_col, False, weights, share, limit, block, seed)
    return out.select(
        F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__p_source_size").alias("source_size"), F.col("__p_target").alias("target"), (F.col("__times") * F.col("__size")).alias("taken"), F.col("__times").alias("copies")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, block: int = BLOCK, seed: int = 1) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it was taken, with the columns of docs."""
    out = _decided(docs, id_col, text_col, source_col, True, weights, share, limit, block, seed)
    return out.where("__times > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select("__row.*")
