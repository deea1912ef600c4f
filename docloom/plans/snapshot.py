"""Final documents from complete change logs, as plain joins and aggregates that Catalyst plans.

A snapshot gives what the last change per id would be. It differs from the full changelog where history
matters: an unmatched move under ``require_match`` (the last enriched value survives downstream) and a
parent that came back after a delete at a chained level. ``plans.replay`` gives those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import checked_key, checked_value
from ..operators.changes import DELETE, UPSERT, Key

#: Set on frames that hold one live change per id, as the snapshots give them; any further operation drops it.
_SINGLE = "_docloom_single"


def latest(changes: DataFrame) -> DataFrame:
    """The last change per id, upserts and deletes: one aggregate whose partial results go through the shuffle."""
    last = F.max_by(F.struct("kind", "value", "seq", "sub"), F.struct("seq", "sub")).alias("c")
    return changes.groupBy("id").agg(last).select("c.kind", "id", "c.value", "c.seq", "c.sub")


def live(changes: DataFrame) -> DataFrame:
    """The last change per id where that is an upsert. A snapshot's output is that already."""
    return changes if getattr(changes, _SINGLE, False) else latest(changes).where(F.col("kind") == UPSERT)


def _single(changes: DataFrame) -> DataFrame:
    setattr(changes, _SINGLE, True)
    return changes


def lookup_snapshot(entities: DataFrame, dimensions: DataFrame, key: Key, enrich, require_match: bool, what: str) -> DataFrame:
    """Each live entity with the live dimension of its key: a left join, or an inner join with ``require_match``.

    A null key or enriched value fails the job.
    """
    left = live(entities).withColumn("__key", checked_key(key(F.col("value")), F.col("id"), what))
    right = live(dimensions).select(F.col("id").alias("__dim"), F.col("value").alias("__dimension"))
    joined = left.join(right, F.col("__key") == F.col("__dim"), "inner" if require_match else "left")
    enriched = F.when(F.col("__key").isNotNull(), enrich(F.col("value"), F.col("__dimension")))  # so the key is checked even if the dimension is not used
    value = checked_value(enriched, what)
    return _single(joined.select("kind", "id", value.alias("value"), "seq", "sub"))


def grouped_children(children: DataFrame, parent_key: Key, what: str) -> DataFrame:
    """``parent, children``: the live children of each parent with their order, sorted by id."""
    rows = live(children).withColumn("parent", checked_key(parent_key(F.col("value")), F.col("id"), what))
    return rows.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("id", "value", "seq"))).alias("children"))


def live_parents(parents: DataFrame) -> DataFrame:
    """The live parents with ``cleared``: the order of their last delete, null without any. One aggregate."""
    if getattr(parents, _SINGLE, False):
        return parents.withColumn("cleared", F.lit(None).cast("long"))
    last = F.max_by(F.struct("kind", "value", "seq", "sub"), F.struct("seq", "sub")).alias("c")
    rows = parents.groupBy("id").agg(last, F.max(F.when(F.col("kind") == DELETE, F.col("seq"))).alias("cleared"))
    return rows.where(F.col("c.kind") == UPSERT).select("c.kind", "id", "c.value", "c.seq", "c.sub", "cleared")


def nest_snapshot(parents: DataFrame, slots: dict[str, tuple[DataFrame, Key]], assemble, what: str) -> DataFrame:
    """Each live parent with its slots' children: ``assemble(parent, {slot: array of values})``.

    Every slot is aggregated before it is joined, so a parent's rows meet one row per slot. A parent's
    delete forgets the children that came before it; at equal ``seq`` the parent comes first. A null
    parent key or document fails the job.
    """
    out, arrays = live_parents(parents), {}
    for name, (children, parent_key) in slots.items():
        side = grouped_children(children, parent_key, f"{what} {name}")
        side = side.select(F.col("parent").alias(f"__parent_{name}"), F.col("children").alias(f"__children_{name}"))
        out = out.join(side, F.col("id") == F.col(f"__parent_{name}"), "left")
        arrays[name] = values(F.col(f"__children_{name}"), F.col("cleared"))
    value = checked_value(assemble(F.col("value"), arrays), what)
    return _single(out.select("kind", "id", value.alias("value"), "seq", "sub"))


def values(children: Column, cleared: Column) -> Column:
    """The values of the children that were not cleared; an empty array for a parent without any."""
    kept = F.when(cleared.isNull(), children).otherwise(F.filter(children, lambda c: c["seq"] >= cleared))
    return F.coalesce(F.transform(kept, lambda c: c["value"]), F.array())
