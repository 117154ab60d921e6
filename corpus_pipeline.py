"""A training corpus from ``documents``: five stages, each written and read again by the next.

Toxic documents go, one of each group of near duplicates stays, long repeated passages are cut out,
the sources are mixed to their target weights, and what is left is packed into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm import jaccard_join, mixing, packing, substring_dedup, toxicity
from fieldweave.llm.queries import documents, small_batches, table
from fieldweave.llm.split import free, held_out
from fieldweave.shared import settle

#: A passage of so many bytes that stands elsewhere too is cut out. Fifty-one words of two letters are
#: 152 bytes, as is the shortest of 7,158 stretches of 51 words in the 0.01 documents; shorter words
#: than that over a whole passage are not found.
REPEATED_BYTES = 150
#: Words that a worker keeps for packing; the workers serve the other stages too.
REMEMBERED = 150_000
#: A document of at least this toxicity goes.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without documents of toxicity ``TOXIC`` or more, by a classifier that learns from the
    labelled ones of ``docs`` itself.

    Rows that are equal stay or go together; a null text is scored as an empty one. Without labelled
    rows nothing goes. Columns and their names pass through (an input column toxicity too). No rows: no rows.
    """
    small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 4, 2))
    own = free("toxicity", docs.columns)
    return toxicity.score(docs, model, own).filter(F.col(own) < TOXIC).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (five words, 0.8): that of the least id.

    Null ids come last, ties go by a hash of id and text, and of equal rows one stays. Texts without a
    word (null, empty) are no copies of each other: all stay. Whole texts of any length are compared.
    Columns of any name pass through. No rows: no rows.
    """
    small_batches(spark)
    return jaccard_join.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with every passage of ``REPEATED_BYTES`` or more cut that stands elsewhere too, all of
    its copies; n_chars counts what is left.

    No row goes; a text may become empty, as a null one does. Long texts are searched whole. Other
    columns of any name pass through, nulls too. No rows: no rows.
    """
    small_batches(spark)
    return substring_dedup.without_repeats(docs, REPEATED_BYTES).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, none to three times; columns unchanged.

    A null source is a source of its own; texts without a word (null, empty) count no words, and a
    source of only such is not taken. Rows that share an id are drawn alike. No rows: no rows.
    """
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens, as ``packing.pack`` gives them.

    A null or empty text is its closing id alone; long texts are cut into several pieces; repeated rows
    are packed each. Only doc_id and text are read. No rows: no pieces.
    """
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=REMEMBERED)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Classifier, components and tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
