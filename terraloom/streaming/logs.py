"""Structured Streaming forms of the log operators: the same folds as operators.folds, over state that outlives a batch.

State per key is a few numbers. Rows of a key that arrive in one micro-batch are put in order of (ts, id) first; a row older than what
its key has seen by more than the delay is not lost but returned with ``late`` set, for a dead-letter sink.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terraloom.operators.records import delivery_step

DELAY = "1 day"


def counters(commands: DataFrame) -> DataFrame:
    """(count_id, op_id, quantity, late) for a stream of (count_id, op_id, ts, action, set_value)."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, seen = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "op_id"])
        out = []
        for op, at, action, target in zip(rows["op_id"], rows["ts"].astype("int64"), rows["action"], rows["set_value"]):
            late = at < seen
            if not late:
                value = max(0, int(target)) if action == "set" else value + 1 if action == "increment" else max(0, value - 1)
                seen = at
            out.append((key[0], op, value, late))
        state.update((value, seen))
        yield pd.DataFrame(out, columns=["count_id", "op_id", "quantity", "late"])

    rows = commands.select("count_id", "op_id", F.col("ts").cast("timestamp").alias("ts"), "action", "set_value").withWatermark("ts", DELAY)
    return rows.groupBy("count_id").applyInPandasWithState(run, "count_id long, op_id long, quantity long, late boolean", "value long, seen long", "append", GroupStateTimeout.NoTimeout)


def _folded(rows: DataFrame, key: str, order: list[str], start: tuple, step: Callable[[tuple, tuple], tuple], kept: str, out: str) -> DataFrame:
    """Rows of a stream (key, ts, ...) with what ``step`` says of each: (state, row) to (state, values); a late row has nulls and changes nothing. A key's state is kept for good."""
    columns = [f.name for f in rows.schema]
    n, at = len(out.split(",")), columns.index("ts")

    def run(key_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *now, seen = state.get if state.exists else (*start, None)
        now, found = tuple(now), []
        for r in pd.concat(list(frames)).sort_values(order).itertuples(index=False, name=None):
            us = r[at].value // 1000
            late = seen is not None and us < seen
            values = (None,) * n
            if not late:
                now, values = step(now, (*r[:at], us, *r[at + 1 :]))
                seen = us
            found.append((*r, *values, late))
        state.update((*now, seen))
        yield pd.DataFrame(found, columns=[*columns, *[c.split()[0] for c in out.split(",")], "late"]).astype({c.split()[0]: "object" for c in out.split(",")})

    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in rows.schema], out, "late boolean"])
    return rows.groupBy(key).applyInPandasWithState(run, schema, f"{kept}, seen long", "append", GroupStateTimeout.NoTimeout)


def operations(ops: DataFrame) -> DataFrame:
    """(operation_id, project_id, ts, seq, expected_version, status, server_version, late): version checks of a stream of operations; a repeated id within the delay is dropped."""

    def step(state: tuple, r: tuple) -> tuple:
        good = r[4] == state[0]
        return (state[0] + int(good),), ("applied" if good else "conflict", state[0] + int(good))

    rows = ops.select("operation_id", "project_id", F.col("ts").cast("timestamp").alias("ts"), "seq", "expected_version").withWatermark("ts", DELAY).dropDuplicatesWithinWatermark(["operation_id"])
    return _folded(rows, "project_id", ["ts", "seq"], (0,), step, "version long", "status string, server_version long")


def _attempts(attempts: DataFrame, key: str, ts: str) -> DataFrame:
    return attempts.select(F.col(key), F.col(ts).cast("timestamp").alias("ts"))


def fixed_window(attempts: DataFrame, window_s: int = 900, limit: int = 10, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """(key, ts, attempts, allowed, late): a limit that restarts with the first attempt after its window."""

    def step(state: tuple, r: tuple) -> tuple:
        begun, n = state
        begun, n = (r[1], 1) if begun is None or begun < r[1] - window_s * 1_000_000 else (begun, n + 1)
        return (begun, n), (n, n <= limit)

    return _folded(_attempts(attempts, key, ts), key, ["ts"], (None, 0), step, "begun long, n int", "attempts int, allowed boolean")


def sliding_window(attempts: DataFrame, window_s: int = 600, limit: int = 12, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """(key, ts, allowed, late): fewer than ``limit`` allowed attempts within the window before; refused ones are not recorded. A key's state is at most ``limit`` times."""

    def step(state: tuple, r: tuple) -> tuple:
        recorded = [t for t in state[0] if t >= r[1] - window_s * 1_000_000]
        good = len(recorded) < limit
        return ([*recorded, r[1]] if good else recorded,), (good,)

    return _folded(_attempts(attempts, key, ts), key, ["ts"], ([],), step, "recorded array<long>", "allowed boolean")


def deliveries(log: DataFrame) -> DataFrame:
    """(submission_id, ts, seq, action, state, send, attempts, late): records.deliveries() for a stream of (submission_id, ts, seq, action). Settled deliveries refuse
    claims for good, so their state stays."""

    def step(s: tuple, r: tuple) -> tuple:
        now, values = delivery_step(s, (r[0], r[1] / 1_000_000, r[2], r[3]))
        return now, values

    rows = log.select("submission_id", F.col("ts").cast("timestamp").alias("ts"), "seq", "action")
    return _folded(rows, "submission_id", ["ts", "seq"], ("pending", None, None, 0), step, "state string, first double, lease double, n int", "state string, send boolean, attempts int")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions by inactivity, emitted once the watermark has passed their end."""
    rows = events.select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", DELAY)
    out = rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_seen_at"), F.count("*").alias("n_events"))
    return out.drop("session_window")
