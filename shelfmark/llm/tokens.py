"""Token counts, truncation and budgets from exact counts at every prefix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from shelfmark.llm.bpe import prefix_counts
from shelfmark.llm.common import SLICE_BYTES, utf8, slices


def token_counts(
    docs: DataFrame, vocabulary_path: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text; null and empty have 0 and false.

    Repeated rows give repeated results, and a null id is kept. Runs on the scan's partitions.
    """

    def run(batches):
        counter = prefix_counts(vocabulary_path)
        for batch in batches:
            data, at = utf8(batch.column(1))
            texts = batch.column(1)
            counts = []
            for row, _, part in slices(data, at, SLICE_BYTES):
                counts += counter.counts(texts.slice(row, len(part) - 1).to_pylist())
            counts = np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(at)), pa.array(counts), pa.array(counts > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()),
    ])
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, schema)


def prefix_token_counts(
    docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, prefix_tokens): for each whole text the exact count of its first 0, 1, ... characters.

    The stored arrays answer truncation and budgets later: ``fitting_chars`` needs no tokenizer.
    """

    def run(batches):
        counter = prefix_counts(vocabulary_path)
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1)):  # one array a row: bounded by one text
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i.as_py()], batch.schema.field(0).type), pa.array([counter.prefixes(text.as_py()).astype(np.int32)], pa.list_(pa.int32()))],
                    names=["doc_id", "prefix_tokens"],
                )

    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("prefix_tokens", T.ArrayType(T.IntegerType()))
    ])
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, schema)


def fitting_chars(prefix_tokens, budget: int):
    """Characters of the longest prefix of at most ``budget`` tokens, from a stored array."""
    places = F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i).otherwise(F.lit(0)))
    return F.array_max(places)
