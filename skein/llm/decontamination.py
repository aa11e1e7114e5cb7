"""Benchmark decontamination: n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

An item's seeds are all its n-grams: a choice among them by how few documents have them would lose edited passages that
are themselves copied, whose surviving n-grams are the common ones. One pass over every whole text takes every place where
a seed of an item stands, cuts the passage around it that the item could cover, drops it if it holds too few of the item's
words for any alignment to reach the score, and aligns the words of the rest (match 2, mismatch and gap -1). The best local
score, as a share of what the item scores against itself, tells exact and edited copies from chance. A passage edited so
densely that no n-gram of the item is left in it opens no window.

Test items are a query set that goes against all rows in blocks of bounded size; documents never move.

Null and empty texts match nothing, and so do items without words; items of fewer words than a seed have one seed. Rows
with a null id keep it. Repeated documents are judged each on its own; repeated items give a row each. Empty tables give
an empty result; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.pieces import balanced, release
from skein.llm.rows import text_key, without
from skein.llm.words import ngrams, word_hashes

#: Words of a seed.
SEED = 3
#: Characters of test items in a block, and share of an item's own score from which a passage counts as a copy.
BLOCK_CHARS, LEAST = 16_000_000, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: A passage reaches beyond the item's length on either side by this share of it and so many words.
SLACK, SLACK_WORDS = 0.25, 4


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and where in the passage it ends."""
    row = np.zeros(len(passage) + 1, np.int64)
    ramp = np.arange(len(passage) + 1) * -GAP
    best, end = 0, 0
    for word in item:
        here = np.zeros(len(row), np.int64)
        here[1:] = np.maximum(np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), row[1:] + GAP), 0)
        # A gap within the row: the best of what stands to the left, less its distance.
        row = np.maximum.accumulate(here + ramp) - ramp
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


class Items:
    """Test items with their seeds."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in items]
        flat, offsets = word_hashes(t for _, t in items)
        self.words = [flat[a:b] for a, b in zip(offsets, offsets[1:])]
        self.by_length: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, words in enumerate(self.words):
            n = min(SEED, len(words))
            for place, seed in enumerate(ngrams(words, n).tolist() if n else ()):
                self.by_length[n][seed].append((k, place))
        self.by_length = {n: dict(d) for n, d in self.by_length.items()}
        self.seeds = {n: np.array(sorted(d), np.uint64) for n, d in self.by_length.items() if d}

    def hits(self, flat: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Document number, place in flat, and seed, wherever a seed stands within one document."""
        for n, seeds in self.seeds.items():
            found = ngrams(flat, n)
            if not len(found):
                continue
            places = np.flatnonzero(seeds[np.minimum(np.searchsorted(seeds, found), len(seeds) - 1)] == found)
            doc = np.searchsorted(offsets, places, "right") - 1
            inside = places + n <= offsets[doc + 1]
            yield from zip(doc[inside].tolist(), places[inside].tolist(), found[places[inside]].tolist(), strict=True)

    def matches(self, flat: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """Document number, item number, share of the item's own score, first and last word, for the best passage."""
        windows: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
        for doc, place, seed in self.hits(flat, offsets):
            for d in self.by_length.values():
                for k, at in d.get(seed, ()):
                    slack = int(len(self.words[k]) * SLACK) + SLACK_WORDS
                    begin = max(int(offsets[doc]), place - at - slack)
                    windows[doc, k].add((begin, min(int(offsets[doc + 1]), place - at + len(self.words[k]) + slack)))
        for (doc, k), spans in sorted(windows.items()):
            item = self.words[k]
            own = MATCH * len(item)
            best, where = 0, (0, 0)
            merged: list[list[int]] = []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                passage = flat[a:b]
                # No alignment matches more words of the item than stand in the passage.
                most = MATCH * int(np.isin(item, passage).sum())
                if most < LEAST * own or most <= best:
                    continue
                score, end = align(item, passage)
                if score > best:
                    best, where = score, (a, a + end)
            if best >= LEAST * own:
                yield doc, k, best / own, where[0] - int(offsets[doc]), where[1] - int(offsets[doc])


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    """The test items in blocks of bounded size."""
    block, chars = [], 0
    for r in benchmark.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).orderBy("id", "text").toLocalIterator():
        block.append((r.id, r.text))
        if (chars := chars + len(r.text)) >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and test item that it holds a copy of: doc_id, t (its text's key), item_id, score, first_word, last_word."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("t"))
    schema = "doc_id long, t long, item_id long, score double, first_word long, last_word long"
    out = spark.createDataFrame([], schema)
    for block in blocks_of(benchmark, item_col, item_text_col):
        items = Items(block)

        def match(batches, items=items):
            release()
            for batch in balanced(batches, "text"):
                flat, offsets = word_hashes(batch.column("text").fill_null("").to_pylist())
                found = list(items.matches(flat, offsets))
                ids, keys = batch.column("doc_id").to_pylist(), batch.column("t").to_pylist()
                columns = [[ids[x[0]] for x in found], [keys[x[0]] for x in found], [items.ids[x[1]] for x in found], [x[2] for x in found], [x[3] for x in found], [x[4] for x in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 3 else pa.int64()) for k, c in enumerate(columns)], ["doc_id", "t", "item_id", "score", "first_word", "last_word"])

        out = out.unionByName(rows.mapInArrow(match, schema))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and test item that it holds a copy of: doc_id, item_id, score, first_word, last_word."""
    return passages(docs, benchmark, id_col, text_col, item_col, item_text_col).drop("t")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no copy of a test item, with all their columns."""
    return without(docs, passages(docs, benchmark, id_col, text_col), id_col, text_col)
