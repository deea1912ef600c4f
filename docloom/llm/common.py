"""What the corpus operators share: scratch tables, native hashes, prefix sums and connected components."""

from __future__ import annotations

import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import remove_path, scratch_path

#: Bytes of an Arrow batch that goes to Python while a table is made. Rows with long values come a few at a time.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_PATH = "_docloom_path"


def small_batches(spark: SparkSession) -> None:
    """Lets the session send Arrow batches of at most BATCH_BYTES from now on, also for frames that are written later."""
    spark.conf.set(_BATCH, str(BATCH_BYTES))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back: lineage ends at replicated files."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before) if before is not None else spark.conf.unset(_BATCH)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables made by ``materialize`` that nothing will read again, not even to repeat a lost task."""
    for t in tables:
        remove_path(t.sparkSession, getattr(t, _PATH))


_RESIDENT: dict[Any, Any] = {}


def resident(key: Any = None, make: Callable[[], Any] | None = None) -> Any:
    """The large object of a Python worker, one at a time: workers outlive stages, and what an earlier one left must go.

    To be called as a task begins, without a key where it needs none. Freed memory goes back to the system.
    """
    if key not in _RESIDENT:
        _RESIDENT.clear()
        gc.collect()
        if make:
            _RESIDENT[key] = make()
    pa.default_memory_pool().release_unused()
    return _RESIDENT.get(key)


def md5_bits(text: Column, bits: int) -> Column:
    """The first ``bits`` bits (at most 60, a multiple of 4) of the MD5 of ``text`` as a long."""
    return F.conv(F.substring(F.md5(text), 1, bits // 4), 16, 10).cast("long")


def id_text(column: str) -> Column:
    """The id as text for hashing; null ids hash as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def utf8_bytes(column: str) -> Column:
    """UTF-8 size of a text column; null counts as none."""
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")


def prefix_offsets(counts: DataFrame, key: str, n: str, low_bits: int = 10) -> DataFrame:
    """Adds ``before``: the sum of ``n`` over smaller ``key``.

    ``key`` is a dense integer. Sums run within runs of ``2**low_bits`` keys and then over the runs,
    so no task sees more than that many rows while there are fewer than ``4**low_bits`` keys.
    """
    high = F.shiftright(F.col(key), low_bits)
    inner = Window.partitionBy("__high").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(F.lit(0)).orderBy("__high").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.withColumn("__high", high)
    totals = runs.groupBy("__high").agg(F.sum(n).alias("__run"))
    totals = totals.select("__high", F.coalesce(F.sum("__run").over(outer), F.lit(0)).alias("__base"))
    runs = runs.withColumn("__in", F.coalesce(F.sum(n).over(inner), F.lit(0)))
    return runs.join(totals, "__high").select(*counts.columns, (F.col("__in") + F.col("__base")).alias("before"))


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Smallest reachable id for each id of ``edges(a, b)`` (longs): rows ``(node, component)``.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Each half round takes the
    smallest neighbour of a node by a map-side combined aggregate and joins it back to the edges, so a
    hub's neighbours are never gathered in one task; each is written to the shared scratch folder.
    An id without edges has no row. Self-links, repeated and reversed edges change nothing.
    """
    spark = edges.sparkSession
    edges = edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("v < u").distinct()
    edges = materialize(edges, tag)
    seen = _state(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("v"), F.col("v").alias("u")).distinct()
        large = materialize(large, tag)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("m").alias("v"), F.col("v").alias("u"))
        small = materialize(small.unionByName(least.select(F.col("m").alias("v"), "u")).distinct(), tag)
        discard(edges, large)
        edges = small
        before, seen = seen, _state(edges)
        if before == seen:
            break
    if not seen[0]:
        return spark.createDataFrame([], "node long, component long")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    """Count and order-free checksum of the edges, to see whether a round changed them."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)
