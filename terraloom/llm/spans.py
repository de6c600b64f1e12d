"""Positions of regular-expression matches in code points, with built-in functions only.

regexp_extract_all gives the matches and split the gaps between them; their lengths add up to the positions.
Patterns are written so that no part can be matched in two ways (possessive loops, look-behind), which keeps Java's matcher
linear and free of recursion on very long runs of one kind of character.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 256
SPAN = "start int, rank int, end int, kind string, value string"


@dataclass(frozen=True)
class Kind:
    """A kind of span: what a text must match to be searched at all, the pattern, the group that holds the value, the test."""

    name: str
    hint: str
    pattern: str
    group: int
    test: Callable[[Column], Column]


def _running(a: Column) -> Column:
    return F.aggregate(a, F.array().cast("array<int>"), lambda out, x: F.concat(out, F.array(F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0)) + x)))


def _in_chunks(a: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / CHUNK).cast("int")), lambda c: _running(F.slice(a, c * CHUNK + 1, F.lit(CHUNK))))


def _joined(runs: Column, totals: Column) -> Column:
    return F.flatten(F.transform(runs, lambda p, c: F.transform(p, lambda x: x + F.coalesce(F.get(totals, F.when(c > 0, c - 1)), F.lit(0)))))


def _made(parts: Column, kind: Kind, rank: int) -> Column:
    good = F.filter(parts, lambda p: kind.test(p["v"]))
    return F.transform(good, lambda p: F.struct(p["s"].alias("start"), F.lit(rank).alias("rank"), (p["s"] + F.length(p["h"])).alias("end"), F.lit(kind.name).alias("kind"), p["v"].alias("value")))


def find(df: DataFrame, text: str, kinds: tuple[Kind, ...], out: str = "found", first_rank: int = 0) -> DataFrame:
    """Adds ``out``: all spans of all kinds that pass their test, in order of start, then kind as listed.

    Running sums are made over chunks and then over the chunks' totals, so a text with very many matches stays cheap.
    """
    base = [F.col(f"`{c}`") for c in df.columns]
    t = F.col(text)
    n = range(len(kinds))
    hits = [F.when(t.rlike(k.hint), F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0))) for k in kinds]
    values = [F.when(t.rlike(k.hint), F.regexp_extract_all(t, F.lit(k.pattern), F.lit(k.group))) for k in kinds]
    df = df.select(*base, *[hits[i].alias(f"__hit{i}") for i in n], *[(values[i] if kinds[i].group else F.lit(None).cast("array<string>")).alias(f"__val{i}") for i in n])
    rows = [F.size(f"__hit{i}") > 0 for i in n]
    lens = []
    for i, k in enumerate(kinds):
        h = F.col(f"__hit{i}")
        gaps = F.transform(F.slice(F.split(t, k.pattern, -1), F.lit(1), F.size(h)), lambda x: F.length(x))
        back = F.concat(F.array(F.lit(0)), F.transform(F.slice(h, F.lit(1), F.size(h) - 1), lambda x: F.length(x)))
        lens.append(F.when(rows[i], F.zip_with(gaps, back, lambda a, b: a + b)).alias(f"__len{i}"))
    df = df.select(*base, *[f"__hit{i}" for i in n], *[f"__val{i}" for i in n], *lens)
    # A column that is used twice is computed once; used once, it would be copied into the lambda and computed for each element.
    chunked = [F.when(rows[i], _in_chunks(F.col(f"__len{i}"))).alias(f"__run{i}") for i in n]
    df = df.select(*base, *[f"__hit{i}" for i in n], *[f"__val{i}" for i in n], *chunked)
    totals = [F.when(rows[i], _running(F.transform(F.col(f"__run{i}"), lambda p: F.element_at(p, -1)))).alias(f"__tot{i}") for i in n]
    df = df.select(*base, *[f"__hit{i}" for i in n], *[f"__val{i}" for i in n], *[f"__run{i}" for i in n], *totals)
    spans = []
    for i, k in enumerate(kinds):
        starts = _joined(F.col(f"__run{i}"), F.col(f"__tot{i}"))
        parts = F.arrays_zip(starts.alias("s"), F.col(f"__hit{i}").alias("h"), F.coalesce(f"__val{i}", f"__hit{i}").alias("v"))
        spans.append(F.when(rows[i], _made(parts, k, first_rank + i)).otherwise(F.array().cast(f"array<struct<{SPAN.replace(' ', ':').replace(',:', ',')}>>")))
    return df.select(*base, F.sort_array(F.concat(*spans)).alias(out))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def replaced(text: Column, spans: Column, label: Callable[[Column], Column]) -> Column:
    """The text with every span (sorted by start) replaced by its label; spans that overlap are covered by the first one's label."""
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), label(s))).alias("out")),
        ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)
