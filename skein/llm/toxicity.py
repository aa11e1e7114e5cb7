"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, learned from document labels.

A document is a bag of sentences. A logistic score p says how likely a sentence alone makes its document toxic; the
document is toxic unless none of its sentences does: 1 - prod(1 - p). Only documents have labels, so the sentence scores
are fitted through the noisy-or: a leak stands for documents labelled toxic without a cause in the text, a slip for toxic
ones labelled clean, and neither is part of a score. Features are words and their beginnings, so that forms of an abusive
word that no label has seen count too. Weights are not negative, and an L1 penalty keeps the few that are needed. A
sentence without such a feature has no part in the score. The fitted sentence scores then locate the offending sentences.

Fitting takes a bounded sample: per label at most SAMPLE documents, those of smallest hash of the id, and at most
SAMPLE_CHARS characters in all (documents are taken whole). Scoring takes every text whole. Labels, ids and other
columns are never inputs of a score.

Null and empty texts have no sentences and score 0. Repeated rows are scored each on its own; label rows with a null id
or label are ignored, and of several labels for an id the larger counts. With no labelled rows, or labels of one kind
only, no word counts and every score is 0. An empty table gives an empty result. Columns other than id, text and
label are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.pieces import release

#: Bounds of the sample that is fitted: documents per label, and characters in all.
SAMPLE, SAMPLE_CHARS = 4000, 48_000_000
#: A feature needs so many different sentences, and so many times the odds of all documents; lengths of beginnings.
SUPPORT, LIFT, BEGINNINGS = 6, 4.0, (4, 5, 6)
#: A sentence ends after so many words at the latest; words whose weight a worker remembers.
SENTENCE_WORDS, MEMO = 60, 100_000
#: A sentence's log-odds with no known word; chance of a toxic document labelled clean; L1 penalty; steps, their size, and
#: where the weights of a word start.
BASE, SLIP, PENALTY, STEPS, RATE, START = -10.0, 0.02, 3e-5, 200, 0.2, 14.0
THRESHOLD = 0.7

WORD = re.compile(r"\w+")
END = re.compile(r"[.!?…。！？\n]+")


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Begin and end of each sentence that has a word."""
    at = 0
    for stop in [*(m.end() for m in END.finditer(text)), len(text)]:
        words = [m.span() for m in WORD.finditer(text, at, stop)]
        for k in range(0, len(words), SENTENCE_WORDS):
            yield words[k][0], words[min(k + SENTENCE_WORDS, len(words)) - 1][1]
        at = stop


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features_of(word: str) -> list[str]:
    """The word, and its beginnings marked by a hyphen."""
    return [word, *(word[:k] + "-" for k in BEGINNINGS if len(word) > k)]


class _Weights(dict):
    """Weight of each word met so far, 0 for most."""

    def __init__(self, weights: dict[str, float]):
        self.of = weights

    def __missing__(self, word: str) -> float:
        if len(self) > MEMO:
            self.clear()
        self[word] = w = sum(self.of.get(f, 0.0) for f in features_of(word))
        return w


class Model:
    """Weights of the features that count. A sentence's log-odds: BASE and the weights of its different features."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}
        self.by_word = _Weights(self.weights)

    def __reduce__(self):
        return Model, (self.weights,)

    def counts(self, text: str) -> bool:
        """Whether some word of the text counts."""
        return any(map(self.by_word.__getitem__, set(words_of(text))))

    def sentence(self, text: str) -> float:
        """-log(1 - p) of a sentence; 0 if none of its words counts."""
        found = {f for w in set(words_of(text)) if self.by_word[w] for f in features_of(w) if f in self.weights}
        return float(np.logaddexp(0.0, BASE + math.fsum(map(self.weights.__getitem__, found)))) if found else 0.0

    def document(self, text: str) -> float:
        if not text or not self.counts(text):
            return 0.0
        return -float(np.expm1(-sum(self.sentence(text[a:b]) for a, b in sentences(text))))


def fit(samples: Iterable[tuple[str, int]]) -> Model:
    """A model from texts and labels, the same in every process; a text that comes more than once counts once, with its larger label."""
    labels: dict[str, int] = {}
    for text, label in samples:
        labels[text] = max(label, labels.get(text, 0))
    if len(set(labels.values())) < 2:
        return Model()
    y = np.fromiter(labels.values(), float, len(labels))
    holds, toxic = Counter(), Counter()
    for text, label in labels.items():
        found = {f for w in set(words_of(text)) for f in features_of(w)}
        holds.update(found)
        if label:
            toxic.update(found)
    odds = y.mean() / (1 - y.mean())
    lifted = {f for f, n in toxic.items() if n >= SUPPORT and n + odds >= LIFT * odds * (holds[f] - n + 1)}
    model = Model(dict.fromkeys(lifted, 1.0))
    # Different sentences, by their features, in one order whatever the hashes: sums of floats depend on it.
    bags = [sorted({tuple(sorted({f for w in words_of(text[a:b]) if model.by_word[w] for f in features_of(w) if f in lifted})) for a, b in sentences(text)} - {()}) if model.counts(text) else () for text in labels]
    support: dict[str, set] = defaultdict(set)
    for text in labels:
        if model.counts(text):
            for a, b in sentences(text):
                words = words_of(text[a:b])
                for w in words:
                    if model.by_word[w]:
                        for f in features_of(w):
                            if f in lifted and len(support[f]) < SUPPORT:
                                support[f].add(hash(tuple(words)))
    number = {f: k for k, f in enumerate(sorted(f for f in lifted if len(support[f]) >= SUPPORT))}
    doc, sent, feat = [], [], []
    for d, bag in enumerate(bags):
        for s in bag:
            if known := [number[f] for f in s if f in number]:
                feat += known
                sent += [len(doc)] * len(known)
                doc.append(d)
    doc, sent, feat = (np.array(x, np.int64) for x in (doc, sent, feat))
    n, k = len(y), len(number)
    # At first the features of a word together are cause enough.
    w, leak = np.array([START / (1 + sum(len(f) > b for b in BEGINNINGS)) for f in number]), 0.02
    mean, square = np.zeros(k), np.zeros(k)
    for step in range(1, STEPS + 1):
        z = BASE + np.bincount(sent, w[feat], minlength=len(doc))
        total = leak + np.bincount(doc, np.logaddexp(0.0, z), minlength=n)
        none = np.exp(-total)
        slope = np.where(y > 0, -none / np.maximum(1 - none, 1e-9), (1 - SLIP) * none / (SLIP + (1 - SLIP) * none))
        by_sentence = slope[doc] / (1 + np.exp(-z))
        gradient = np.bincount(feat, by_sentence[sent], minlength=k) / n + PENALTY
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        w = np.maximum(0.0, w - RATE * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-4))
        leak = max(1e-3, leak - 0.05 * float(slope.mean()))
    return Model({f: float(w[i]) for f, i in number.items() if w[i] > 1e-3})


def held_out(id_: Column) -> Column:
    """Rows from which no label may be learned."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null").where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    order = F.xxhash64("id")
    chosen = [known.where(F.col("label") == k).orderBy(order, "id").limit(SAMPLE) for k in (0, 1)]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "id").where("text is not null")  # at most 2 * SAMPLE ids
    rows, chars = [], 0
    for r in sample.orderBy(order, "id").select("text", "label").toLocalIterator():
        if (chars := chars + len(r.text)) > SAMPLE_CHARS and rows:
            break
        rows.append((r.text, r.label))
    return fit(rows)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            scores = [model.document(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(of, "doc_id long, score double, predicted int")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def locate(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sentences that are toxic by themselves: doc_id, begin, end (code points), sentence, score."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("sentence", pa.string()), ("score", pa.float64())])
        for batch in batches:
            found = defaultdict(list)
            for id_, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text or not model.counts(text):
                    continue
                for a, b in sentences(text):
                    if (p := -float(np.expm1(-model.sentence(text[a:b])))) >= least:
                        for name, value in zip(schema.names, (id_, a, b, text[a:b], p), strict=True):
                            found[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in schema], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(of, "doc_id long, begin long, end long, sentence string, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the model does not reject, with all their columns; the text decides, row by row."""
    model = train(docs, labels, id_col, text_col)

    @F.pandas_udf("boolean")
    def rejected(texts: pd.Series) -> pd.Series:
        release()
        return texts.map(lambda t: model.document(t or "") >= THRESHOLD)

    return docs.where(~rejected(F.col(text_col)))
