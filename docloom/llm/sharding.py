"""Sharding: proportional stratified interleaving.

Every source's rows are put into a seeded random order; the row of rank r among n gets the fractional
rank (r - 1 + phase) / n, where the phase between 0 and 1 is drawn from seed and source, so that sources
of equal size do not fall into step and sources of one row spread out. Sorting all rows by fractional
rank interleaves the sources in proportion, and cutting that order into equal runs gives shards that
all match the corpus mixture, with counts at most one apart (law ``rows``).

Only DataFrame functions are used. No window holds a whole source: ranks are row numbers within
(source, hash range) plus the counts of smaller ranges, and positions are row numbers within ranges of
the fractional rank plus the counts of smaller ranges.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, materialize, md5_bits, prefix_offsets, utf8_bytes

#: Rows that one hash range should hold on average at most.
RANGE_ROWS = 20_000
HASH_BITS = 48
PHASE_BITS = 40


def shard_documents(
    docs: DataFrame,
    n_shards: int = 24,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, source, fraction``.

    Null texts count no bytes and have the checksum of the empty text; a null source is a stratum of
    its own, sorted before the others; null ids hash as the empty text. Rows that share an id differ
    in their hash by size and checksum; equal rows are interchangeable. Texts are only measured, so very
    long ones are rows like others. Fewer rows than shards leave shards empty; an empty table gives an
    empty result. Other columns of ``docs`` are not looked at.
    """
    n = docs.count()
    bits = min(24, max(8, math.ceil(math.log2(max(n, 1) / RANGE_ROWS))))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        (utf8_bytes(text_col) + 8).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("text_crc32"),
    )
    name = F.concat_ws(":", F.lit(str(seed)), id_text("doc_id"), "size", "text_crc32")
    base = base.withColumn("key", md5_bits(name, HASH_BITS)).withColumn("range", F.shiftright("key", HASH_BITS - bits).cast("int"))
    counts = base.groupBy("source", "range").agg(F.count("*").alias("n"))
    source = Window.partitionBy("source")
    earlier = source.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("source").alias("s"),
        F.col("range").alias("g"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(source).alias("in_source"),
    )
    shuffled = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "text_crc32")
    ranked = base.withColumn("rank", F.row_number().over(shuffled))
    ranked = ranked.join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("g")))
    stratum = F.coalesce(F.concat(F.lit("source:"), F.col("source").cast("string")), F.lit("none"))
    phase = (md5_bits(F.concat(F.lit(f"{seed}:"), stratum), PHASE_BITS) + 0.5) / F.lit(float(1 << PHASE_BITS))
    fraction = (F.col("rank") + F.col("before") - 1 + phase) / F.col("in_source")
    ranked = ranked.select("doc_id", "source", "size", "text_crc32", F.least(fraction, F.lit(1 - 2.0**-40)).alias("fraction"))
    ranked = materialize(ranked, "shard-ranks").withColumn("slice", F.floor(F.col("fraction") * F.lit(1 << bits)).cast("int"))
    slices = prefix_offsets(ranked.groupBy("slice").agg(F.count("*").alias("n")), "slice", "n")
    along = Window.partitionBy("slice").orderBy("fraction", "source", "doc_id", "size", "text_crc32")
    placed = ranked.withColumn("at", F.row_number().over(along)).join(slices.select("slice", "before"), "slice")
    position = F.col("at") + F.col("before") - 1
    shard = F.expr(f"position * {n_shards} div {max(n, 1)}")
    first = F.expr(f"(shard * {n} + {n_shards - 1}) div {n_shards}")
    return (
        placed.withColumn("position", position.cast("long"))
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", (F.col("position") - first).cast("long"))
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
            F.lit(None).cast("int").alias("grown_shard"), "source", "fraction",
        )
    )
