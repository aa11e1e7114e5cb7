"""Candidate pairs in crowded buckets, without all pairs of a bucket: exact, by what sets from one bucket do not have in common.

The members of a crowded bucket share much, and most pairs share it for the same reason: a text that all go back to, a line
that all repeat. A reference R, the shingles that most of a few members have, stands for it. It only has to be a set; what
it is decides how much work is left, never the result. For members x and y, of numbers |x| and |y| of shingles and
a weight for each, with similarity t or more (Jaccard of the sets, or probability Jaccard of the weights), one of two holds:

* They share a shingle outside R. Then they share one in their prefixes: the first shingles outside R, in one order for
  all, that hold over 1 - t of the member's shingles and of its weight (all outside R if those are less). For if the prefixes
  met nowhere, all that is shared outside R would lie behind one member's prefix, and with that more than 1 - t of it
  would be unshared, but similarity t needs t of each. So members are dealt out again, to a list for each shingle of a prefix;
  lists that are crowded in their turn are buckets with a larger R.
* They share none. With a = |R \\ x| and b = |x \\ R|, at most min(a_x, a_y) of what is missing is missing in both, so a
  Jaccard of t needs (1 + t) min(a_x, a_y) >= a_x + t b_x + a_y + t b_y - (1 - t)|R|. With o the weight of x outside R over
  its weight inside, a probability Jaccard of t needs o_x + o_y <= 1/t - 1: in each common register's chance
  1 / sum of max(x_j/x_i, y_j/y_i), what stands outside R adds to the sum. These are conditions on a few numbers.
  All such members are compared with the one nearest to R; only what that leaves in other classes is paired.

Copies with edits of their own share hardly a shingle outside R, so lists are short and work grows with the members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.storage import materialise

#: Members that a reference is made from, and how many ways its rows are dealt where members are joined to it.
SAMPLE, SALT = 16, 16
_EPSILON = 1e-9


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def references(members: DataFrame, features: DataFrame, sets: DataFrame) -> DataFrame:
    """band, ref, shingles: the shingles of the reference a band comes from, and what more than half of some members have. members: band, node, origin; sets: ref, shingles."""
    often = members.groupBy("node").agg(F.count("*").alias("k"))
    # Of the members, those that meet others most often stand nearest to what is common: one for each of SAMPLE slots.
    slots = members.join(often, "node").groupBy("band", F.pmod(F.xxhash64("node"), F.lit(SAMPLE)).alias("slot")).agg(F.max_by("node", F.struct("k", "node")).alias("node"))
    drawn = slots.join(features, "node").groupBy("band").agg(F.collect_list("v").alias("sets"))  # SAMPLE at most
    origins = members.groupBy("band").agg(F.first("origin").alias("ref")).join(sets, "ref", "left")
    base = origins.select("band", F.coalesce("shingles", F.lit(b"")).alias("base"))

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sets = [np.frombuffer(x, np.uint64) for x in batch.column("sets")[k].as_py()]
                value, times = np.unique(np.concatenate(sets), return_counts=True)
                value = np.union1d(value[times * 2 > len(sets)], np.frombuffer(batch.column("base")[k].as_py(), np.uint64))
                yield pa.RecordBatch.from_arrays([batch.column("band").slice(k, 1), pa.array([value.tobytes()], pa.binary())], ["band", "shingles"])

    found = drawn.join(base, "band").mapInArrow(agree, "band long, shingles binary")
    return found.withColumn("ref", F.xxhash64("shingles"))


def entries(at: DataFrame, features: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """ref, node, a, b, r (size of the reference), o, unit, inside, prefix, for members at a reference. at: ref, node; sets: ref, shingles."""
    dealt = sets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rows = at.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int")).join(features, "node").join(dealt, ["ref", "salt"]).select("ref", "node", "v", "c", "shingles")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for v, c, r in zip(_sets(batch.column("v")), batch.column("c").to_pylist(), _sets(batch.column("shingles")), strict=True):
                weight = np.frombuffer(c, np.int32).astype(np.float64) if c else np.ones(len(v))
                outside = ~np.isin(v, r, assume_unique=True)
                b, most, total = int(outside.sum()), (1 - least) * len(v), weight.sum()
                heavy = weight[outside].sum()
                inside = total - heavy
                before = np.cumsum(weight[outside]) - weight[outside]
                n = np.arange(b)
                # A shingle is in the prefix unless those before it hold over 1 - t already.
                prefix = v[outside][(n <= most + _EPSILON) | (before <= (1 - least) * total + _EPSILON)]
                near = b <= most + _EPSILON or heavy <= (1 - least) * total + _EPSILON
                for column, value in zip(out, (len(r) - (len(v) - b), b, len(r), heavy / inside if inside else float("inf"), not c, near, prefix.view(np.int64)), strict=True):
                    column.append(value)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("ref"), batch.column("node"), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["ref", "node", "a", "b", "r", "o", "unit", "inside", "prefix"])

    return rows.mapInArrow(measure, "ref long, node long, a int, b int, r int, o double, unit boolean, inside boolean, prefix array<long>")


def thinned(crowds: DataFrame, features: DataFrame, least: float, most: int) -> tuple[DataFrame, DataFrame]:
    """From crowds (band, node): lists (band, node) of 2 to `most` nodes each, and the members (of `entries`, without prefix) near a reference."""
    spark = crowds.sparkSession
    lists = spark.createDataFrame([], "band long, node long")
    near = spark.createDataFrame([], "ref long, node long, a int, b int, r int, o double, unit boolean")
    none = F.lit(None).cast("long")
    level, sets, first = crowds.withColumn("origin", none), spark.createDataFrame([], "ref long, shingles binary"), True
    while not level.isEmpty():
        refs = materialise(references(level, features, sets), "references")
        at = level.join(refs.select("band", "ref"), "band").select("ref", "node").distinct()
        sets = refs.groupBy("ref").agg(F.first("shingles").alias("shingles"))
        own = materialise(entries(at, features, sets, least), "entries")
        near = near.unionByName(own.where("inside").drop("inside", "prefix"))
        if first:  # a node stands in up to a bucket for each band: one list for each shingle, whatever the references
            each = own.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("prefix"))).alias("prefix"))
            dealt, first = each.select(F.explode("prefix").alias("band"), "node").withColumn("ref", none), False
        else:  # references grow from level to level, so this ends
            dealt = own.select("ref", F.explode("prefix").alias("e"), "node").withColumn("band", F.xxhash64("ref", "e")).drop("e")
        sizes = dealt.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
        dealt = materialise(dealt.join(sizes, "band"), "lists")
        lists = lists.unionByName(dealt.where(F.col("n") <= most).select("band", "node"))
        # What is still crowded goes on, with what its members have been found to share.
        level = dealt.where(F.col("n") > most).select("band", "node", F.col("ref").alias("origin"))
    return lists, near


def stars(near: DataFrame) -> DataFrame:
    """Pairs (a, b) of each reference's nearest member and the others near it."""
    # Written, so that a reference that a third of all nodes stand near is joined by a broadcast or in split partitions.
    first = materialise(near.groupBy("ref").agg(F.min_by("node", F.struct(F.col("a") + F.col("b"), "node")).alias("hub")), "hubs")
    return near.join(first, "ref").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))


def left_over(near: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) near one reference and of different classes that could be alike without a common shingle outside it."""
    rows = materialise(near.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node")), "near")
    main = rows.groupBy("ref", "class").agg(F.count("*").alias("k")).groupBy("ref").agg(F.max_by("class", F.struct("k", "class")).alias("main"))
    main = materialise(main, "mains")
    x = rows.join(main, "ref").where("class <> main").select("ref", *(F.col(c).alias(f"x_{c}") for c in ("node", "class", "a", "b", "o", "unit", "r")))
    y = rows.select("ref", *(F.col(c).alias(f"y_{c}") for c in ("node", "class", "a", "b", "o", "unit")))
    by_sets = f"{1 + least} * least(x_a, y_a) + {_EPSILON} >= x_a + {least} * x_b + y_a + {least} * y_b - {1 - least} * x_r"
    by_weights = f"not (x_unit and y_unit) and x_o + y_o <= {1 / least - 1 + _EPSILON}"
    met = x.join(y, [x["ref"] == y["ref"], F.expr(f"x_class <> y_class and ({by_sets} or {by_weights})")])
    return met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))
