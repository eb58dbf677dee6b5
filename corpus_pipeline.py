"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a
DataFrame: all but the last with the columns of ``documents``.  Its result is written as Parquet
and read again as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import decontaminate, jaccard, mixing, tokenfiles, toxicity
from tidewake.llm.queries import learned_rows
from tidewake.llm.tables import table
from tidewake.llm.workspace import Workspace

#: Texts of at least this toxicity score go.
TOXIC_FROM = 0.7
#: Words of a shingle, and the similarity in percent from which texts are near duplicates.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine rejects go; null and empty texts stay, as do null keys and repeated rows.

    Any further columns are kept, whatever their names; an empty table gives an empty one.
    """
    model = toxicity.train(docs, learned_rows(table(spark, sf_dir, "labels"), 3, 1))
    score = "__score"
    while score in docs.columns:
        score += "_"
    return toxicity.score_texts(docs, model, tuple(docs.columns), score=score).filter(F.col(score) < TOXIC_FROM).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links join stays: the least doc_id.

    Texts without words and rows with a null key stay; of repeated rows one stays; further columns
    are kept; an empty table gives an empty one.
    """
    return jaccard.one_of_each(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, go; null texts hold none.

    Null keys, repeated rows and further columns are kept; an empty table gives an empty one.
    """
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, up to three times.

    Their order by finish time is left out, since the next stage sorts them by key.

    Texts without words are never taken; a null source is a source of its own; null keys and
    repeated rows are mixed like others; further columns are kept; an empty table gives an empty one.
    """
    return mixing.mixed_documents(docs, ordered=False)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files and their index, read back: doc_id, start, n_tokens, ids_crc32.

    Null texts are the end id alone; null keys come first; rows with the same key each stand in the
    files; an empty table gives an empty one.
    """
    return tokenfiles.token_files(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_to_weights),
    ("token_files", write_token_files),
]

#: SQL cannot express the kernel machine, the alignment or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.save(docs, f"{k}-{name}")
    return docs
