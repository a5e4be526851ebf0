"""Whole-number vectors for the exact vector operators: floats scaled and floored, stored as packed bytes."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of vectors that are worked on at once inside a task.
CHUNK_BYTES = 4 << 20


def most(dims: int) -> int:
    """The largest component for which four times any squared distance of ``dims`` components fits a long."""
    return min(2**31 - 1, math.isqrt((2**59 - 1) // max(1, dims)))


def chunks(batches: Iterator[pa.RecordBatch], row_bytes: int = 0) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about CHUNK_BYTES."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, int(CHUNK_BYTES // max(1, row_bytes or batch.nbytes / batch.num_rows)))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)


def whole_vectors(df: DataFrame, scale: int, carry: Sequence[str], column: str = "embedding", dims: int | None = None) -> DataFrame:
    """``carry`` and ``v``: floor(scale * x) of every component as packed 4-byte integers.

    Rows whose vector is null or holds a null or a non-finite component go, and, if ``dims`` is given, those of another
    length.  A vector with a component beyond ``most`` of its length stays with a null ``v``: its squared distances would
    not fit a long."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "v binary"])
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            lists = part.column(len(carry))
            rows = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            lists = lists.take(pa.array(rows))
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            ends = np.cumsum(lengths)
            starts = ends - lengths
            per_row = lambda odd: (total := np.concatenate(([0], np.cumsum(odd))))[ends] - total[starts]
            finite = np.isfinite(flat)
            good = per_row(~finite) == 0
            if dims is not None:
                good &= lengths == dims
            whole = np.floor(np.where(finite, flat, 0.0) * scale)
            limits = np.array([most(int(n)) for n in np.unique(lengths)])[np.searchsorted(np.unique(lengths), lengths)] if len(lengths) else lengths
            fits = per_row(np.abs(whole) > np.repeat(limits, lengths)) == 0
            kept = np.flatnonzero(good)
            packed = np.where(np.repeat(good & fits, lengths), whole, 0).astype("<i4")
            all_v = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64) * 4), pa.py_buffer(packed)])
            v = pc.if_else(pa.array(fits), all_v, pa.scalar(None, pa.large_binary())).take(pa.array(kept)).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(rows[kept])) for i in range(len(carry))), v], schema=arrow)

    return df.select(*(F.col(f"`{c}`") for c in carry), F.col(f"`{column}`").alias("__e")).mapInArrow(run, schema)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The packed vectors of a column without nulls, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(-1, dims) if dims else np.zeros((len(column), 0), dtype="<i4")


def add_rows(sums: np.ndarray, counts: np.ndarray, rows: np.ndarray, to: np.ndarray) -> None:
    """Adds every row to the sums and counts of its entry, in whole numbers."""
    if len(rows):
        order = np.argsort(to, kind="stable")
        entries, first = np.unique(to[order], return_index=True)
        sums[entries] += np.add.reduceat(rows[order].astype(np.int64), first, axis=0)
        counts[entries] += np.bincount(to, minlength=len(counts))[entries]


def sha_text(values: np.ndarray) -> str:
    """Whole numbers in decimal, joined by commas."""
    return ",".join(map(str, values.ravel().tolist()))
