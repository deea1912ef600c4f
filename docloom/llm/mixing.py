"""Mixing sources to target weights by Poisson replication.

A document of a source with target repetition rate L is kept K times, K drawn from the Poisson
distribution with mean L: a hash of seed and id gives a uniform number, which the inverted cumulative
distribution turns into K. A large mean is the sum of draws with means of at most ``DRAW``, which is
the same distribution, so a distribution's table is small whatever the rate. Each document decides
alone, so the mixture needs no ranking, no sampling pass and no state. The copies are exploded and dealt
out by a hash of (id, copy), which is a global shuffle.

Only DataFrame functions are used. One row per source holds its rate and cumulative distribution;
Spark broadcasts that table where its size allows and joins it by shuffle, with skew handling, where not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from .common import id_text, materialize, md5_bits, utf8_bytes

UNIFORM_BITS = 52
KEY_BITS = 60
#: Largest mean of a single draw.
DRAW = 64


def source_rates(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    power: float = 0.5,
    total: float | None = None,
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``source, mass, weight, rate``: each source's UTF-8 bytes, weight and mean repetition rate.

    ``weights`` gives the target share of each named source (others get none); without it a source of
    mass m weighs m ** power. ``total`` is the wanted size in bytes, that of the input by default. A
    source without bytes has rate 1 if its weight allows any (nothing can bring it to its share).
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(utf8_bytes(text_col)).alias("mass"))
    if weights is None:
        weight: Column = F.pow(F.col("mass").cast("double"), F.lit(power))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source") == F.lit(name), F.lit(float(value))).otherwise(weight)
    sizes = materialize(sizes.withColumn("weight", weight), "source-sizes")
    sums = sizes.agg(F.sum("mass"), F.sum("weight")).first()
    whole, parts = float(sums[0] or 0) if total is None else float(total), float(sums[1] or 0)
    share = F.col("weight") / F.lit(parts) if parts else F.lit(0.0)
    rate = F.when(F.col("mass") > 0, share * F.lit(whole) / F.col("mass")).otherwise(
        F.lit(1.0) if weights is None else F.when(F.col("weight") > 0, 1.0).otherwise(0.0)
    )
    return sizes.withColumn("rate", rate)


def poisson_cdf(rate: Column) -> Column:
    """The cumulative Poisson distribution as an array, far enough that what is left is below 2**-53.

    Terms are made from logarithms, so a large mean does not underflow to an all-zero distribution.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.log(rate / k)
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.array_append(acc["cdf"], total).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"]).otherwise(F.array(F.lit(1.0)))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    power: float = 0.5,
    total: float | None = None,
    seed: int = 29,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The columns of ``docs`` with ``mix_copy`` (from 1) and ``mix_key`` (the shuffle's order), K rows for each.

    Rows that share an id get the same number of copies. A null source is a source of its own, null
    ids hash as the empty text, null and empty texts weigh nothing but are replicated like their
    source's others, very long texts weigh what they have. An empty table gives an empty result. Columns
    of ``docs`` that are called ``mix_copy`` or ``mix_key`` are replaced; names starting with ``__mix``
    are refused.
    """
    taken = [c for c in docs.columns if c.lower().startswith("__mix")]
    if taken:
        raise ConfigurationError(f"columns {taken} have names that start with __mix")
    rates = source_rates(docs, weights, power, total, text_col, source_col)
    draws = F.greatest(F.ceil(F.col("rate") / DRAW), F.lit(1)).cast("int")
    rates = rates.select(F.col("source").alias("__mix_source"), draws.alias("__mix_draws"), poisson_cdf(F.col("rate") / draws).alias("__mix_cdf"))
    rows = docs.drop("mix_copy", "mix_key")
    joined = rows.join(rates, F.col(f"`{source_col}`").eqNullSafe(F.col("__mix_source")))

    def drawn(number: Column) -> Column:
        name = F.concat(F.lit(f"{seed}:"), id_text(id_col), F.when(number == 1, "").otherwise(F.concat(F.lit("#"), number.cast("string"))))
        uniform = md5_bits(name, UNIFORM_BITS) / F.lit(float(1 << UNIFORM_BITS))
        return F.size(F.filter("__mix_cdf", lambda c: c <= uniform))

    more = F.aggregate(F.sequence(F.lit(2), F.col("__mix_draws")), F.lit(0), lambda n, i: n + drawn(i))
    count = drawn(F.lit(1)) + F.when(F.col("__mix_draws") > 1, more).otherwise(0)
    joined = joined.withColumn("__mix_n", count).where("__mix_n > 0")
    copies = joined.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_n"))))
    key = md5_bits(F.concat(F.lit(f"{seed}:"), id_text(id_col), F.lit(":"), F.col("mix_copy").cast("string")), KEY_BITS)
    copies = copies.withColumn("mix_key", key).withColumn("__mix_text", F.xxhash64(F.col(f"`{text_col}`")))
    copies = copies.repartition("mix_key", "__mix_text").sortWithinPartitions("mix_key")  # rows that share an id part by their texts
    return copies.drop("__mix_source", "__mix_draws", "__mix_cdf", "__mix_n", "__mix_text")
