"""From raw documents to packed training sequences, one operator a stage.

Each stage gets the documents its predecessor kept and returns documents with the same columns; the
last returns the pieces of packed sequences. A stage's result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moundworks.llm import jaccard, mixing, packing, shared, superkmers, toxicity
from moundworks.llm.queries import tokenizer_path

#: SQL can't express the classifier, nor what follows from it.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on their labels, gives 0.7 or more go.

    A null text is empty and gets what the model's bias says; repeated rows stay or go together; rows
    without a doc_id are judged but never trained on. Without labels of both classes nothing goes
    unless the one class there is says so. An empty table stays empty; columns may have any names.
    """
    model = toxicity.fit(docs, shared.table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model, threshold=0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five-word shingles stays.

    Equal texts, empty and null ones among them, are one group, of which the least doc_id stays (null
    last). An empty table stays empty; columns may have any names.
    """
    return jaccard.one_of_each(docs, words=5, threshold=0.8)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 20 that start earlier in the corpus go.

    A text that loses words is joined again by single spaces, and is empty where it loses all; rows that
    lose nothing, null texts among them, stay as they were. A null doc_id comes before all others. An
    empty table stays empty.
    """
    return superkmers.rewrite(docs, width=20)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought as near to equal weights as repeating none more than twice allows; every
    document stays at least once.

    A null source is a source of its own; texts without words are in every whole pass. A repeated
    document is a row for each pass. An empty table stays empty; columns may have any names.
    """
    return mixing.mix(docs, repetition_limit=2.0).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: a row per piece with its place. A null or empty text is its end
    token alone; rows of one doc_id are packed each for itself; an empty table gives no rows."""
    out = packing.pack(docs, tokenizer_path(), capacity=1024)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``: the rows of the last. Each stage's result is written to
    the shared folder and read again, so a lost executor costs one stage at most."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
