"""Column helpers that most operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(f: Callable[[Column], Column], **values: Column) -> Column:
    """f of a struct of values, each evaluated once however often f names it; plain expressions are repeated with every mention."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), f), 1)


def text(x: Column) -> Column:
    """Trimmed lower case; null is empty."""
    return F.lower(F.trim(F.coalesce(x.cast("string"), F.lit(""))))


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x.cast("string")), F.lit(""))


def finite_or_null(x: Column) -> Column:
    d = x.cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf")), d)


def finite(*xs: Column) -> Column:
    """The first finite number, else 0."""
    return F.coalesce(*[finite_or_null(x) for x in xs], F.lit(0.0))


def ceil25(x: Column) -> Column:
    """Commercial rounding: up to the next multiple of 25; 0 where not finite or not positive."""
    d = finite_or_null(x)
    return F.when(d > 0, F.ceil(d / 25) * 25).otherwise(F.lit(0)).cast("long")


def poisoned_sum(x: Column, bad: Column) -> Column:
    """Aggregate: null if any row is bad, else the sum, 0 over nothing; nulls among good rows count as 0."""
    return F.when(F.coalesce(F.bool_or(bad), F.lit(False)), F.lit(None)).otherwise(F.coalesce(F.sum(x), F.lit(0)))


def contains_query(searched: Column, query: str) -> Column:
    """The whole query or each of its words occurs in the text."""
    q = " ".join(query.lower().split())
    parts = F.lit(True)
    for w in q.split():
        parts = parts & searched.contains(w)
    return searched.contains(query.strip().lower()) | parts
