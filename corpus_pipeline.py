"""A training corpus from raw documents: toxicity, quality, near-dedup, mixing, tokens.

Each stage works on all that its predecessor kept. The classifiers learn from the labelled documents
that reach them and are not held out by the queries' folds.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docloom.llm import bpe, mixing, quality, simhash, toxicity
from docloom.llm.common import materialize, small_batches
from docloom.llm.queries import TOKENIZER, fold, table

#: Documents whose toxicity reaches, or whose quality does not reach, this score go.
THRESHOLD = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, as labelled documents teach; see ``toxicity.keep_clean`` for nulls, empty texts and tables."""
    small_batches(spark)
    model = toxicity.train_model(docs, table(spark, sf_dir, "labels"), fold(4) != 2)
    return toxicity.keep_clean(docs, model, THRESHOLD)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality, as labelled documents among them teach; see ``quality.keep_good`` for nulls, empty texts and tables."""
    small_batches(spark)
    labels, train = table(spark, sf_dir, "labels"), fold(5) != 0
    model = quality.train_model(quality.labelled_statistics(docs, labels, train), labels, train)
    return quality.keep_good(docs, model, THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, decided by the sets; see ``simhash.keep_first``."""
    return simhash.keep_first(docs, width=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate draws; see ``mixing.mix_sources`` for nulls, empty texts and tables."""
    return mixing.mix_sources(docs).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of token digests per row; null and empty texts have no ids, an empty table gives none."""
    small_batches(spark)
    return bpe.encode_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_dedup", drop_near_duplicates),
    ("mix", mix),
    ("bpe", encode),
]

#: The classifiers and SimHash are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
