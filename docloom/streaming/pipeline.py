"""Streaming forms of the operators: routing, union and one stateful step, then a projection.

The documents themselves are columns on top of what the processors emit, so Catalyst sees them.
Checkpoints bind state to an operator's place in the query; keep the shape of a query while you keep
its checkpoint. Timers fire between micro-batches, so an orphan may stay until the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.guards import checked_value
from ..names import state_id
from ..operators.changes import Key
from ..options import LookupOptions, NestOptions, millis
from .processors import LookupProcessor, NestProcessor, RouteProcessor


def _mode(*durations: object) -> str:
    """Timers and TTLs need processing time; without any, a query that is to stop at the end of its input can."""
    return "ProcessingTime" if any(d is not None for d in durations) else "None"


def route_stream(inputs: list[tuple[DataFrame, Key, str, int | None, str]], mode: str) -> DataFrame:
    """Several sources' (changes, key, state id, TTL, name) routed by one stateful step: ``src, kind, id, value_<src>..., seq, sub, key, relocation``."""
    kinds = [c.schema["value"].dataType for c, *_ in inputs]
    rows = None
    for src, (changes, key, *_) in enumerate(inputs):
        values = [(F.col("value") if k == src else F.lit(None).cast(kind)).alias(f"value_{k}") for k, kind in enumerate(kinds)]
        part = changes.select(F.lit(src).alias("src"), "kind", "id", *values, "seq", F.col("sub").cast("long").alias("sub"), key(F.col("value")).cast("string").alias("key"))
        rows = part if rows is None else rows.unionByName(part)
    out = T.StructType(
        [T.StructField("src", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("id", T.StringType())]
        + [T.StructField(f"value_{k}", kind) for k, kind in enumerate(kinds)]
        + [T.StructField("seq", T.LongType()), T.StructField("sub", T.LongType()), T.StructField("key", T.StringType()), T.StructField("relocation", T.BooleanType())]
    )
    slots = [(state, kind, ttl, what) for (_, _, state, ttl, what), kind in zip(inputs, kinds, strict=True)]
    return rows.groupBy("src", "id").transformWithState(RouteProcessor(slots), out, "Update", mode)


def lookup_stream(name: str, entities: DataFrame, dimensions: DataFrame, key: Key, enrich, options: LookupOptions) -> DataFrame:
    ttl = millis(options.state_ttl)
    mode = _mode(ttl)
    entity, dimension = entities.schema["value"].dataType, dimensions.schema["value"].dataType
    routed = route_stream([(entities, key, state_id("route", name), ttl, f"lookup {name}")], mode)
    left = routed.select("key", "kind", "id", F.col("value_0").alias("entity"), F.lit(None).cast(dimension).alias("dimension"), "relocation", "seq", "sub", F.lit(1).alias("src"))
    right = dimensions.select(
        F.col("id").alias("key"), "kind", "id", F.lit(None).cast(entity).alias("entity"), F.col("value").alias("dimension"), F.lit(False).alias("relocation"), "seq",
        F.col("sub").cast("long").alias("sub"), F.lit(0).alias("src"),
    )
    out = T.StructType(
        [
            T.StructField("kind", T.StringType()), T.StructField("id", T.StringType()), T.StructField("entity", entity), T.StructField("dimension", dimension),
            T.StructField("seq", T.LongType()), T.StructField("sub", T.LongType()),
        ]
    )
    processor = LookupProcessor(name, entity, dimension, ttl, options.require_match)
    emitted = left.unionByName(right).groupBy("key").transformWithState(processor, out, "Update", mode)
    value = checked_value(enrich(F.col("entity"), F.col("dimension")), f"lookup {name}")
    return emitted.select("kind", "id", value.alias("value"), "seq", "sub")


def nest_stream(name: str, parents: DataFrame, inputs: dict, assemble, options: NestOptions) -> DataFrame:
    """``inputs`` has (changes, parent key, options) by slot in declaration order. One step routes the children of all slots, one nests them."""
    parent_ttl, orphan = millis(options.parent_state_ttl), millis(options.orphan_timeout)
    ttls = {n: millis(o.state_ttl) for n, (_, _, o) in inputs.items()}
    mode = _mode(parent_ttl, orphan, *ttls.values())
    parent = parents.schema["value"].dataType
    kinds = {n: c.schema["value"].dataType for n, (c, _, _) in inputs.items()}
    routed = route_stream([(c, k, state_id("child_route", name, n), ttls[n], f"nest {name} {n}") for n, (c, k, _) in inputs.items()], mode)
    tops = [F.lit(None).cast(kind).alias(f"child_{n}") for n, kind in kinds.items()]
    tops = parents.select(F.col("id").alias("parent_id"), "kind", "id", F.col("value").alias("parent"), *tops, "seq", F.col("sub").cast("long").alias("sub"), F.lit(0).alias("src"))
    children = [F.col(f"value_{k}").alias(f"child_{n}") for k, n in enumerate(kinds)]
    rows = routed.select(F.col("key").alias("parent_id"), "kind", "id", F.lit(None).cast(parent).alias("parent"), *children, "seq", "sub", (F.col("src") + 1).alias("src"))
    out = T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("id", T.StringType()), T.StructField("parent", parent)]
        + [T.StructField(f"children_{n}", T.ArrayType(kind)) for n, kind in kinds.items()]
        + [T.StructField("seq", T.LongType()), T.StructField("sub", T.LongType())]
    )
    processor = NestProcessor(name, parent, [(n, kinds[n], ttls[n]) for n in inputs], parent_ttl, orphan, options.coalesce)
    emitted = tops.unionByName(rows).groupBy("parent_id").transformWithState(processor, out, "Update", mode)
    value = checked_value(assemble(F.col("parent"), {n: F.col(f"children_{n}") for n in inputs}), f"nest {name}")
    return emitted.select("kind", "id", value.alias("value"), "seq", "sub")
