"""Near-duplicates by ProbMinHash over weighted word shingles, banding and verification.

A document's shingles are its runs of five words (lower case, letters, digits and underscores), weighted by how often
they stand in it. Each shingle is a Poisson process of arrivals whose rate is its weight; an arrival takes a register if
it is the earliest there. A process ends early, as soon as its next arrival is later than all registers' first ones. Equal
registers of two documents estimate their probability Jaccard; for shingles that stand once each, it is the Jaccard of the
sets. Where a shingle stands more than once, a second sketch with weights of one is banded too.

Two documents are linked if the probability Jaccard of the weighted shingles or the Jaccard of the sets, computed exactly
from the texts, is at least 0.8. Documents with equal weighted shingles are one node from the start, so that copies never
make pairs. In a bucket of few members each is first compared with one alone, and then only what that leaves in different
classes. Crowded buckets are thinned out exactly (`skein.llm.crowded`): members are dealt out again by what they have besides
that which the bucket has in common, so that no pair that could be linked goes unverified, and edited copies of one text cost a
few comparisons each, however many they are.

Classes are the connected components of the links (`skein.llm.graph`).

A text of one to four words is one shingle; a text without words is one shingle of its trimmed characters, so null, empty
and blank texts form one class. A class is named by its smallest id and that document stays. Rows of an id in one class all
stay or go together; its texts in different classes are judged each in its own, and two classes with the same smallest id
share that name. Rows with null ids are in the class of their text and stay only if no row with an id is in it. Where near
copies are dropped, each row goes or stays by its own mark. An empty table gives an empty result; columns other than id and
text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.crowded import left_over, stars, thinned
from skein.llm.graph import components, joined_classes
from skein.llm.pieces import balanced, release
from skein.llm.rows import text_key, without
from skein.storage import materialise
from skein.llm.words import mix, ngrams, word_hashes

SHINGLE, LEAST = 5, 0.8
#: Bands and the registers of each: a pair at 0.8 shares no band once in ten thousand times.
BANDS, ROWS = 30, 6
#: Buckets of so many members at most compare all that is left in different classes; larger ones are thinned out first.
SMALL = 32
#: Bytes of text that a worker handles at once.
BATCH_BYTES = 1 << 20
_U = np.uint64


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, shingle hash and count of each different shingle, in order of the documents and hashes."""
    flat, offsets = word_hashes(texts)
    grams = ngrams(flat, SHINGLE)
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(texts)), np.maximum(sizes - SHINGLE + 1, 0))
    starts = np.concatenate([np.arange(a, b - SHINGLE + 1) for a, b in zip(offsets, offsets[1:])]) if len(texts) else np.empty(0, np.int64)
    value = grams[starts.astype(np.int64)] if len(starts) else np.empty(0, np.uint64)
    short = np.flatnonzero(sizes < SHINGLE)
    if len(short):
        own = [int(ngrams(flat[offsets[d] : offsets[d + 1]], int(sizes[d]))[0]) if sizes[d] else xxhash.xxh3_64_intdigest("\0" + texts[d].strip()) for d in short.tolist()]
        doc, value = np.concatenate([doc, short]), np.concatenate([value, np.array(own, np.uint64)])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(first)
    return doc[at], value[at], np.diff(np.append(at, len(doc)))


def registers(n: int, doc: np.ndarray, value: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
    """The shingle that arrives first in each of m registers, for n documents."""
    earliest = np.full(n * m, np.inf)
    holder = np.zeros(n * m, np.uint64)
    base, time, k = doc * m, np.zeros(len(doc)), 0
    while len(doc):
        k += 1
        u = mix(value + _U(k * 0x9E3779B97F4A7C15 & 2**64 - 1))
        time = time - np.log1p(-(u >> _U(11)).astype(np.float64) / 2**53) / weight
        place = base + (mix(u ^ _U(0xD1B54A32D192ED03)) % _U(m)).astype(np.int64)
        np.minimum.at(earliest, place, time)
        won = earliest[place] == time
        holder[place[won]] = value[won]
        on = time <= earliest.reshape(n, m).max(1)[doc]  # a later arrival could still take a register
        doc, base, value, weight, time = doc[on], base[on], value[on], weight[on], time[on]
    return holder.reshape(n, m)


def bands_of(sketch: np.ndarray) -> np.ndarray:
    """A hash for each band of each document."""
    parts = sketch.reshape(len(sketch), BANDS, ROWS)
    out = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for r in range(ROWS):
        out = mix(out * _U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return out.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the probability Jaccard of weighted shingles and the Jaccard of their sets."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    plain = len(both) / (len(a[0]) + len(b[0]) - len(both))
    x, y = a[1].astype(float), b[1].astype(float)
    if (x == x[0]).all() and (y == y[0]).all():
        return plain
    # For a shared shingle: 1 / sum over all of max(x_j / x_i, y_j / y_i); sorted by ratio, the sums are prefix sums.
    rest_x, rest_y = x.sum() - x[i].sum(), y.sum() - y[j].sum()
    xs, ys = x[i], y[j]
    order = np.argsort(xs / ys)
    xs, ys = xs[order], ys[order]
    below_y = np.cumsum(ys)  # there y_j / y_i is the larger one
    above_x = xs.sum() - np.cumsum(xs)
    return max(plain, float((1 / ((above_x + rest_x) / xs + (below_y + rest_y) / ys)).sum()))


def sketches(rows: DataFrame) -> DataFrame:
    """doc_id, name of the weighted shingle set (h1, h2), t as it came, and band hashes."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in balanced(batches, "text", BATCH_BYTES):
            texts = batch.column("text").fill_null("").to_pylist()
            n = len(texts)
            doc, value, count = shingles(texts)
            begin = np.searchsorted(doc, np.arange(n))
            element = mix(value ^ mix(count.astype(np.uint64)))
            h1, h2 = (np.add.reduceat(mix(element + _U(k)), begin).view(np.int64) for k in (1, 2))
            m = BANDS * ROWS
            bands = bands_of(registers(n, doc, value, count.astype(float), m)).tolist()
            many = np.flatnonzero(np.maximum.reduceat(count, begin) > 1)
            if len(many):
                some = np.isin(doc, many)
                plain = bands_of(registers(len(many), np.searchsorted(many, doc[some]), value[some], np.ones(int(some.sum())), m)).tolist()
                for d, own in zip(many.tolist(), plain, strict=True):
                    bands[d] = sorted({*bands[d], *own})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(h1), pa.array(h2), batch.column("t"), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "h1", "h2", "t", "bands"])

    return rows.mapInArrow(sketch, "doc_id long, h1 long, h2 long, t long, bands array<long>")


def features_of(texts: DataFrame) -> DataFrame:
    """node, v (its shingles' hashes in order), c (their counts as 32-bit integers, empty if all are one). texts: node, text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in balanced(batches, "text", BATCH_BYTES):
            doc, value, count = shingles(batch.column("text").to_pylist())
            begin = np.searchsorted(doc, np.arange(batch.num_rows + 1)).tolist()
            parts = [(value[x:y], count[x:y]) for x, y in zip(begin, begin[1:])]
            counts = [c.astype(np.int32).tobytes() if (c > 1).any() else b"" for _, c in parts]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([v.tobytes() for v, _ in parts], pa.binary()), pa.array(counts, pa.binary())], ["node", "v", "c"])

    return texts.mapInArrow(of, "node long, v binary, c binary")


def verified(pairs: DataFrame, features: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of `least` similarity or more, from the nodes' shingles."""
    end = lambda name: features.select(F.col("node").alias(name), F.struct("v", "c").alias(f"of_{name}"))

    def unpacked(packed: dict) -> tuple[np.ndarray, np.ndarray]:
        v = np.frombuffer(packed["v"], np.uint64)
        return v, np.frombuffer(packed["c"], np.int32) if packed["c"] else np.ones(len(v), np.int32)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("of_a"), batch.column("of_b")
            alike = [similarity(unpacked(x[k].as_py()), unpacked(y[k].as_py())) >= least for k in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return pairs.join(end("b"), "b").join(end("a"), "a").select("a", "b", "of_a", "of_b").mapInArrow(compare, "a long, b long")


def within(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of different classes in lists (band, node) of bounded size."""
    held = lists.join(classes, "node", "left").groupBy("band").agg(F.collect_list(F.struct("node", F.coalesce("class", "node").alias("class"))).alias("m"))
    pairs = "flatten(transform(m, x -> transform(filter(m, y -> y.node > x.node and y.class <> x.class), y -> struct(x.node as a, y.node as b))))"
    return held.select(F.explode(F.expr(pairs)).alias("p")).select("p.*")


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One row per document: doc_id, t (its text's key), class_id (the smallest id of its class), kept."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), text_key(text).alias("t"))
    sketched = materialise(sketches(rows), "sketches")
    # A node is a set of weighted shingles, named by a number of its own: an id may stand for several texts.
    nodes = sketched.groupBy("h1", "h2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("of"), F.first("bands").alias("bands"))
    nodes = materialise(nodes.select("h1", "h2", F.monotonically_increasing_id().alias("node"), "of.doc_id", "of.t", "bands"), "nodes")
    members = nodes.select("node", F.explode("bands").alias("band"))
    # Only buckets of more than one node matter.
    sizes = members.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1")
    members = materialise(members.join(sizes, "band"), "buckets")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("id"), F.col("t").alias("of_t"))
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("of_t"))).select("node", F.coalesce("text", F.lit("")).alias("text"))
    features = materialise(features_of(texts.dropDuplicates(["node"])), "features")

    # Every member against one other of its bucket; then what that leaves in different classes.
    small = members.where(F.col("n") <= SMALL)
    lists, near = thinned(members.where(F.col("n") > SMALL).select("band", "node"), features, least, SMALL)
    star = small.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).unionByName(stars(near))
    checked = materialise(star.distinct(), "checked")
    classes = materialise(components(verified(checked, features, least)), "classes")
    rest = within(small.select("band", "node").unionByName(lists), classes).unionByName(left_over(near, classes, least))
    rest = materialise(rest.distinct().join(checked, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        classes = joined_classes(classes, verified(rest, features, least))
    named = nodes.select("h1", "h2", "node").join(classes, "node", "left").select("h1", "h2", F.coalesce("class", "node").alias("class"))
    # A class takes the smallest id that it has.
    whole = sketched.select("doc_id", "t", "h1", "h2").join(named, ["h1", "h2"])
    least_id = whole.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return whole.join(least_id, "class").select("doc_id", "t", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest id of its class), kept."""
    return marked(docs, id_col, text_col, least).drop("t")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, with all its columns."""
    groups = materialise(marked(docs, id_col, text_col).select("doc_id", "t", "kept"), "near-groups")
    return without(docs, groups.where(~F.col("kept")), id_col, text_col)
