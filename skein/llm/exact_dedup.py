"""Exact deduplication by distributed most-significant-digit radix partitioning.

A document's key is its normalised text in UTF-8 behind its length as the first digit, so that the texts of a group end
together. The first pass splits all documents by the length and the first bytes; documents alone in their group are done.
What is left is split by the next bytes, strides growing, until each group is a single document or has ended. A group goes
on under a number of its own; equality is decided by the bytes themselves, and a digest is only ever an output column.

Every split counts its groups with partial aggregates and writes the counts of those with copies; they are joined back as a
table of their own, which is broadcast where it is small and otherwise joined with hot keys split by Spark's adaptive plans.
Rows that go on are written to the shared folder between splits.

Null texts count as empty, and empty texts are one group. Rows with a null id or with the same id are rows of their own;
of equal texts, the longest original, then the smallest id stays (a null id stays only where no other does; of repeated
rows with that id each is marked as kept, and group_size counts each). An empty table gives an empty result. Columns
other than id and text are ignored, whatever their names. Where copies are dropped, each row goes or stays by its own mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.rows import text_key, without
from skein.storage import materialise

#: Bytes of the first split, and how the stride grows from split to split.
FIRST_STRIDE, GROWTH = 64, 8


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]."""
    for c in " \n\t\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, t (its text's key), keep_id, group_size, kept, text_sha256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = normalised(text)
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("t"), F.length(text).alias("cp"), norm.cast("binary").alias("norm"))
    raw = raw.select("doc_id", "t", "cp", F.sha2("norm", 256).alias("sha"), F.octet_length("norm").alias("len"), F.octet_length("norm").cast("long").alias("group"), F.substring("norm", 1, FIRST_STRIDE).alias("chunk"), F.substring("norm", FIRST_STRIDE + 1, 1 << 30).alias("rest"))
    # The first split needs the first bytes alone; whole texts move only where these agree.
    live = materialise(raw.drop("rest"), "digits")
    own = F.struct("cp", (-F.col("doc_id")).alias("neg"))
    end, stride, done = FIRST_STRIDE, FIRST_STRIDE, None
    while True:
        groups = live.groupBy("group", "chunk").agg(F.count("*").alias("n"), F.max(own).alias("best"), F.max("len").alias("end")).where("n > 1")
        groups = materialise(groups.withColumn("number", F.monotonically_increasing_id()), "groups")
        met = live.drop("rest").join(groups, ["group", "chunk"], "left")
        settled = F.col("n").isNull() | (F.col("end") <= end)  # alone, or at the end of the text
        part = met.where(settled).select("doc_id", "t", "cp", "sha", F.coalesce("n", F.lit(1).cast("long")).alias("n"), F.coalesce("best", own).alias("best"))
        done = part if done is None else done.unionByName(part)
        # Merged at every size: a broadcast of the groups would do for small tables only, and plans change as data grow.
        open_groups = groups.where(F.col("end") > end).select("group", "chunk", "number").hint("merge")
        if open_groups.isEmpty():
            break
        texts = raw.where(F.col("len") > end) if end == FIRST_STRIDE else live
        end, stride = end + stride * GROWTH, stride * GROWTH
        onward = texts.join(open_groups, ["group", "chunk"]).select("doc_id", "t", "cp", "sha", "len", F.col("number").alias("group"), F.substring("rest", 1, stride).alias("chunk"), F.substring("rest", stride + 1, 1 << 30).alias("rest"))
        live = materialise(onward, "live")
    keep = -F.col("best.neg")
    kept = keep.eqNullSafe(F.col("doc_id")) & (F.col("cp") == F.col("best.cp"))
    return done.select("doc_id", "t", keep.alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return marked(docs, id_col, text_col).drop("t")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose row stays, with all their columns."""
    groups = materialise(marked(docs, id_col, text_col).select("doc_id", "t", "kept"), "exact-groups")
    return without(docs, groups.where(~F.col("kept")), id_col, text_col)
