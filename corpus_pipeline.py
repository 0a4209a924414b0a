"""A training corpus from raw documents: five stages, each written before the next one reads it.

A stage takes (spark, docs, sf_dir); ``docs`` is what its predecessor kept, with the columns of
``documents``. Rows with a null text count as empty text; rows with a null id pass the stages that
go by id. The last stage returns the places of pieces in training sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.llm.common import fold, stored, table
from shelfmark.llm.decontaminate import decontaminate
from shelfmark.llm.packing import best_fit_packing
from shelfmark.llm.simhash import simhash_near_dedup
from shelfmark.llm.substrings import substring_dedup
from shelfmark.llm.toxicity import fit as fit_toxicity, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not call toxic; it learns as the query does."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    return toxicity(docs, model, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash component, once."""
    groups = simhash_near_dedup(docs.select("doc_id", "text"))
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    once = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    repeated = once.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null")
    first = once.join(repeated.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*COLUMNS[1:]), F.struct(*COLUMNS[1:])).alias("x"))
    return once.join(repeated.select("doc_id"), "doc_id", "left_anti").select(*COLUMNS).unionByName(first.select("doc_id", "x.*"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the bytes of strings that stand earlier too; characters cut in part go whole."""
    cut = substring_dedup(docs, keep_text=True, keep=["doc_id", "lang", "source"])
    text = F.col("kept")
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS).where("not contaminated").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens."""
    return best_fit_packing(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("suffix_array_dedup", cut_repeated_passages),
    ("decontaminate", drop_contaminated),
    ("best_fit_packing", pack),
]

# Fitted scores, 64-bit shingle hashes and byte-pair merges are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
