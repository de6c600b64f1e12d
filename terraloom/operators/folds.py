"""Order-sensitive folds over operation logs.

A fold runs down each key's log in order and keeps a few numbers of state. Rows are dealt out by key, sorted within the partition (Spark
spills that sort) and streamed through the fold in Arrow batches, so a task holds one batch and one state, however long a key's log
is. Counter logs need no fold: running sums and minima over windows give the same numbers.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom.functions import rows as rows_of

# Executors get the helper with the job and need no installed package for it.
cloudpickle.register_pickle_by_value(rows_of)


def fold(log: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, tuple], tuple], out: str) -> DataFrame:
    """Rows of log in order within each key, each with what step(state, row) returned for it; step returns (state, *values).

    ``out`` declares the values. Null keys are one key. Rows are tuples in the order of log's columns.
    """
    schema = T.StructType(log.schema.fields + T.StructType.fromDDL(out).fields)
    names, at = schema.names, log.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in schema.fields]
        state, now, began = None, None, False
        for b in batches:
            rows, made = list(zip(*[rows_of.values(c) for c in b.columns])), []
            for r in rows:
                if not began or r[at] != now:
                    state, now, began = start(), r[at], True
                state, *values = step(state, r)
                made.append(values)
            cols = [b.column(i).cast(k) for i, k in enumerate(kinds[: b.num_columns])]
            cols += [pa.array([m[i] for m in made], k) for i, k in enumerate(kinds[b.num_columns :])]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return log.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def first_of_each(log: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """The first row of each operation id: a repeated operation gets its first result again."""
    rest = [c for c in log.columns if c != id_col]
    return log.groupBy(id_col).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(id_col, "r.*").select(*log.columns)


def apply_operations(ops: DataFrame) -> DataFrame:
    """Version checks of a log (operation_id, project_id, ts, seq, expected_version): each operation once, applied if it expects the
    version that the project has by then (0 before it exists), else a conflict that names the server's version."""

    def step(version: int, r: tuple) -> tuple:
        good = r[4] == version
        return version + good, "applied" if good else "conflict", version + good

    once = first_of_each(ops.select("operation_id", "project_id", "ts", "seq", "expected_version"), "operation_id", ["seq"])
    return fold(once, "project_id", ["ts", "seq"], lambda: 0, step, "status string, server_version bigint")


def answers(ops: DataFrame) -> DataFrame:
    """Every row of the log with the result of its operation: a repeated operation is answered with its first result and changes nothing."""
    w = Window.partitionBy("operation_id").orderBy("seq")
    results = apply_operations(ops).select("operation_id", F.col("project_id").alias("__project"), "status", "server_version")
    asked = ops.select("seq", "operation_id").withColumn("repeated", F.row_number().over(w) > 1)
    return asked.join(results, "operation_id").withColumnRenamed("__project", "project_id")


def fixed_window(attempts: DataFrame, key: str, ts: str, window_s: int = 900, limit: int = 10) -> DataFrame:
    """Allowed attempts of a counter that restarts with the first attempt after its window has passed."""
    rows = attempts.select(F.col(key), F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"))

    def step(state: tuple, r: tuple) -> tuple:
        begun, n = state
        begun, n = (r[1], 1) if begun is None or begun < r[1] - window_s * 1_000_000 else (begun, n + 1)
        return (begun, n), n, n <= limit

    return fold(rows, key, ["at_us"], lambda: (None, 0), step, "attempts int, allowed boolean")


def sliding_window(attempts: DataFrame, key: str, ts: str, window_s: int = 600, limit: int = 12) -> DataFrame:
    """Allowed attempts where only allowed ones are recorded: fewer than limit recorded within the window before."""
    rows = attempts.select(F.col(key), F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"))

    def step(recorded: deque, r: tuple) -> tuple:
        while recorded and recorded[0] < r[1] - window_s * 1_000_000:
            recorded.popleft()
        good = len(recorded) < limit
        if good:
            recorded.append(r[1])
        return recorded, good

    return fold(rows, key, ["at_us"], deque, step, "allowed boolean")


def counters(commands: DataFrame, key: str = "count_id", order: tuple[str, ...] = ("ts", "op_id")) -> DataFrame:
    """Value of each counter after each command (set, increment, decrement not below zero), by windows alone.

    Since the last set, the value is the running sum less the lowest the sum has been below zero.
    """
    w = Window.partitionBy(key).orderBy(*order)
    is_set = F.col("action") == "set"
    step = F.when(is_set, F.greatest(F.col("set_value"), F.lit(0))).when(F.col("action") == "increment", 1).otherwise(-1)
    out = commands.withColumns({"__part": F.sum(is_set.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__step": step.cast("long")})
    v = Window.partitionBy(key, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("__sum", F.sum("__step").over(v))
    return out.withColumn("quantity", F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(v))).drop("__part", "__step", "__sum")


def sessions(events: DataFrame, key: str = "user_id", gap: str = "30 minutes") -> DataFrame:
    """Sessions by inactivity: start, last seen and number of events."""
    return events.groupBy(key, F.session_window("ts", gap)).agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_seen_at"), F.count("*").alias("n_events")).drop("session_window")


def consenting(kind: Column, user: Column) -> Column:
    return F.when(kind == "analytics", user)
