"""The change envelope and what makes it from rows.

A change stream is a DataFrame with columns ``kind`` ('U' or 'D'), ``id`` (not blank), ``value`` (a
struct, also for deletes), ``seq`` (order of the source) and ``sub`` (order at equal ``seq``). An id's
changes have different ``(seq, sub)``. It may be a batch or a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.guards import checked_id, checked_value
from ..names import checked_name

UPSERT, DELETE = "U", "D"
ENVELOPE = ("kind", "id", "value", "seq", "sub")

Key = Callable[[Column], Column]


def change_schema(value: T.DataType) -> T.StructType:
    """The schema of changes of ``value``."""
    return T.StructType(
        [
            T.StructField("kind", T.StringType(), False),
            T.StructField("id", T.StringType(), False),
            T.StructField("value", value, False),
            T.StructField("seq", T.LongType(), False),
            T.StructField("sub", T.LongType(), False),
        ]
    )


def changes_from(name: str, rows: DataFrame, id: Key, is_deleted: Key, seq: Key, value: Key | None = None, sub: Key | None = None) -> DataFrame:
    """Rows as changes: a delete with the row as value where ``is_deleted``, else an upsert.

    ``id``, ``is_deleted``, ``seq``, ``value`` and ``sub`` (0 if left out) get the row as a struct
    column. Nothing is deduplicated or reordered, and no state is kept.
    """
    checked_name(name, "changes name")
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    body = row if value is None else checked_value(value(row), name)
    return rows.select(
        F.when(is_deleted(row), DELETE).otherwise(UPSERT).alias("kind"),
        checked_id(id(row), name).alias("id"),
        body.alias("value"),
        seq(row).cast("long").alias("seq"),
        (F.lit(0) if sub is None else sub(row)).cast("long").alias("sub"),
    )


def union_changes(*streams: DataFrame) -> DataFrame:
    """Several change streams of one type as one."""
    out = streams[0].select(*ENVELOPE)
    for s in streams[1:]:
        out = out.unionByName(s.select(*ENVELOPE))
    return out
