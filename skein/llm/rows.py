"""Rows of documents that a filtering stage rejects, told by id and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_key(text: Column) -> Column:
    """A hash of the text as it came; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without(docs: DataFrame, rejected: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents but for the rejected rows (doc_id, t), with all their columns: other texts under an id, or under none, stay."""
    gone = rejected.select(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).distinct()
    return docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (text_key(F.col(text_col)) == F.col("__t")), "left_anti")
