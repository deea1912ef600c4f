"""What the vector operators share: valid vectors as binary, and streams of rows cut at group borders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task gathers before it handles the groups that are complete.
GATHER = 32_768


def vector_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, embedding`` of the rows with an id, in double precision."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("embedding"))
    return rows.where("vec_id is not null")


def valid(embedding: str = "embedding"):
    """Not null, not zero, and without null or non-finite components."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Equally long lists or binary values of doubles as rows."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), dim)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def binary(rows: np.ndarray) -> pa.Array:
    """Rows of doubles as binary values."""
    rows = np.ascontiguousarray(rows, "<f8")
    step = rows.shape[1] * 8 if rows.ndim > 1 else 0
    raw = rows.tobytes()
    return pa.array([raw[i * step : (i + 1) * step] for i in range(len(rows))], pa.binary())


def by_group(keys: list[str], handle: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow that passes on whole groups, several at a time, of rows sorted by ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n < GATHER:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            change = np.zeros(len(rows), bool)
            for k in keys:
                v = rows.column(k).to_numpy()
                change[1:] |= v[1:] != v[:-1]
            borders = np.flatnonzero(change)
            cut = int(borders[-1]) if len(borders) else 0
            if cut:
                yield from handle(rows.slice(0, cut))
            held, n = rows.slice(cut).to_batches(), len(rows) - cut
        if n:
            yield from handle(pa.Table.from_batches(held).combine_chunks())

    return run


def group_starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the groups start, and the end."""
    change = np.ones(len(rows), bool)
    if len(rows):
        change[1:] = False
        for k in keys:
            v = rows.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), len(rows))
