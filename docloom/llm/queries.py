"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, ivfpq, lattice, licenses, mixing, quality, sharding, simhash, token_files, toxicity

#: The tokenizer of the contracts.
TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def fold(n: int) -> Column:
    """The remainder that the contracts divide rows by."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def decided(scores: DataFrame, held_out: Column) -> DataFrame:
    return scores.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return decided(quality.score_quality(docs, labels, fold(5) != 0), fold(5) == 0)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.group_near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train_model(docs, labels, fold(4) != 2)
    return decided(toxicity.score_toxicity(docs, model), fold(4) == 2)


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lattice_dedup": op1_lattice_dedup,
    "op2_ivfpq": op2_ivfpq,
    "op3_quality": op3_quality,
    "op4_token_files": op4_token_files,
    "op5_mix": op5_mix,
    "op6_licenses": op6_licenses,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_shard": op9_shard,
    "op10_bpe": op10_bpe,
}

OP5_SQL = """
with sizes as (
  select source, sum(coalesce(strlen(text), 0))::double as mass from documents group by source
), weighted as (
  select source, mass, pow(mass, 0.5) as weight from sizes
), rates as (
  select source, case when mass > 0 then weight / (select sum(weight) from weighted) * (select sum(mass) from weighted) / mass
         else 1.0 end as rate from weighted
), draws as (
  select source, greatest(ceil(rate / 64), 1)::int as n, rate / greatest(ceil(rate / 64), 1) as mean from rates
), steps as (
  select source, mean, k, sum(case when k = 0 then 0 else ln(mean / k) end) over (partition by source order by k) - mean as logp
  from (select source, mean, unnest(range(0, (ceil(mean + 12 * sqrt(mean) + 40))::int + 1)) as k from draws where mean > 0)
), cdf as (
  select source, k, sum(exp(logp)) over (partition by source order by k) as c from steps
), numbered as (
  select row_number() over () as r, d.*, unnest(range(1, w.n + 1)) as i from documents d join draws w on d.source is not distinct from w.source
), drawn as (
  select *, ('0x' || substr(md5('29:' || coalesce(doc_id::varchar, '') || case when i = 1 then '' else '#' || i end), 1, 13))::bigint / 4503599627370496.0 as u from numbered
), counted as (
  select d.doc_id, d.text, d.lang, d.source, d.n_chars, count(c.k) as n
  from drawn d left join cdf c on d.source is not distinct from c.source and c.c <= d.u
  group by d.r, d.doc_id, d.text, d.lang, d.source, d.n_chars
), copies as (
  select doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::int as mix_copy from counted
)
select *, ('0x' || substr(md5('29:' || coalesce(doc_id::varchar, '') || ':' || mix_copy), 1, 15))::bigint as mix_key from copies
"""

ORACLE: dict[str, str] = {"op5_mix": OP5_SQL}
