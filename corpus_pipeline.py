"""A corpus pipeline: from raw documents to the encoded training mix.

Low-quality documents go, then exact copies, then all but one of each group of near copies; sources are
mixed to their weights, and the mix is encoded. The only table read beside the documents is that of the
labels which the quality classifier learns from.

A null or empty text is scored as a text without characters, equals an empty text, is near no other, and holds
no words, so no mix takes it. Very long texts are read whole in every stage. Of equal texts the largest id stays,
of near copies the smallest; of rows that repeat an id and a text, one. Rows without an id are kept as rows of
their own until they are mixed by source and text. Columns beside those of documents go through all stages but
the last, whatever their names are. Empty tables give no rows. Without labels, or with labels of one kind, every
document is accepted or none is, as the one label says (all without labels).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bpe, exact_dedup, mixing, ngram_join, quality_mil
from spindrift.llm.common import free, stored, table
from spindrift.llm.queries import quality_model, tokenizer


#: Pre-tokens that a worker of the last stage remembers: fewer than usual, as the earlier stages' memory is
#: still with the executors.
REMEMBER = 100_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    score = free("score", docs.columns)
    return quality_mil.with_score(docs, model, score_col=score).filter(F.col(score) >= quality_mil.ACCEPT).drop(score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest id."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies by word 5-grams and a similarity of 0.8."""
    return ngram_join.keep_one(docs, n=5, num=80, den=100)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids."""
    return bpe.encode(docs, *tokenizer(), keep=("doc_id", "lang", "source"), remember=REMEMBER)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixture", mixture), ("encoded", encoded)]

#: SQL can't express the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
