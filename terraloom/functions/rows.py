"""Arrow columns as Python values."""

from __future__ import annotations

import pyarrow as pa


def values(column: pa.Array) -> list:
    """column.to_pylist(), without a scalar object for each value: of arrays and structs those would cost more than the fold itself."""
    kind = column.type
    if pa.types.is_struct(kind):
        names = [f.name for f in kind]
        rows = [dict(zip(names, r)) for r in zip(*[values(c) for c in column.flatten()])]
        return rows if not column.null_count else [r if ok else None for r, ok in zip(rows, column.is_valid().to_pylist())]
    if pa.types.is_list(kind):
        inner, ends, at = values(column.flatten()), [], 0
        for n in column.value_lengths().to_pylist():
            ends.append(None if n is None else inner[at : at + n])
            at += n or 0
        return ends
    if pa.types.is_string(kind) or not column.null_count and (pa.types.is_integer(kind) or pa.types.is_floating(kind)):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()
