"""Toxicity on held-out documents, and the sentences that are to blame."""

import math
import os
import random
import re
import subprocess
import sys
import zlib

import pytest
from pyspark.sql import functions as F

from skein.llm.toxicity import BASE, Model, fit, held_out, keep_clean, locate, score, train

BAD = ["zorkish", "vlorkant", "grumbex"]


def corpus(make, n=600):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        text, toxic = make(1000 + i, r.randint(5, 200)), r.random() < 0.3
        if toxic:
            words = text.split()
            for _ in range(r.randint(1, 3)):
                words.insert(r.randrange(len(words)), r.choice(BAD))
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, 1, int(toxic != (r.random() < 0.02))))  # some labels are wrong
    return rows, labels


def test_held_out_accuracy(spark, make):
    rows, labels = corpus(make)
    docs = spark.createDataFrame(rows + [(9001, None), (9002, ""), (None, "zorkish words"), (9003, make(5, 20000))], "doc_id long, text string").selectExpr("*", "1 AS toxic", "0.5 AS score")
    table = spark.createDataFrame(labels + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = train(docs, table)
    got = {r.doc_id: r for r in score(docs, model).collect()}
    for i, text in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].predicted == int(any(b in text for b in BAD)) == int(got[i].score >= 0.7), (i, got[i].score)
        assert 0 <= got[i].score <= 1
    assert got[9001].score == got[9002].score == 0 and got[9003].predicted == 0 and got[None].predicted == 1 and not got[None].held_out
    kept = keep_clean(docs, table)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    found = locate(spark.createDataFrame([(1, "All is well. What a zorkish thing! Bye."), (2, None)], "doc_id long, text string"), model).collect()
    assert [(r.doc_id, r.sentence) for r in found] == [(1, "What a zorkish thing")]
    assert score(docs.where("1 = 0"), model).count() == 0


def test_labels_that_teach_nothing(spark, make):
    docs = spark.createDataFrame([(1, "zorkish"), (2, "fine")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in score(docs, train(docs, none)).collect()} == {0.0}
    assert fit([("a b c", 1)]).weights == {}


def test_held_out_of_null(spark):
    assert spark.range(1).select(held_out(F.lit(None)).alias("h")).first().h is False


def noisy_or(weights, text):
    """The score said plainly: over sentences of at most 60 words, one minus the product of one minus their chances."""
    none = 1.0
    for piece in re.split(r"[.!?…。！？\n]+", text):
        words = re.findall(r"\w+", piece.lower())
        for k in range(0, len(words), 60):
            features = {f for w in words[k : k + 60] for f in (w, *(w[:n] + "-" for n in (4, 5, 6) if len(w) > n))} & weights.keys()
            if features:
                none *= 1 - 1 / (1 + math.exp(-BASE - sum(weights[f] for f in features)))
    return 1 - none


def test_scores_are_the_noisy_or_of_sentences(spark, make):
    rows, labels = corpus(make)
    model = fit([(t, y) for (_, t), (_, _, y) in zip(rows, labels)])
    assert model.weights
    r = random.Random(3)
    texts = [t for _, t in rows] + [". ".join(r.choice([*BAD, *(b[:4] + "xyz" for b in BAD), "fine", "words " * 70]) for _ in range(r.randint(0, 8))) for _ in range(200)]
    odd = Model({"abc": 9.0, "abcd-": 2.5, "é": 11.0, "ß": 0.5})
    texts += ["abc abc", "ABC. abc", "abcde", "abc abcde", "É\nß", "x. " * 50 + "abc", "abc " * 100]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for m in (model, odd):
        got = {x.doc_id: x.score for x in score(docs, m).collect()}
        for i, t in enumerate(texts):
            assert got[i] == pytest.approx(noisy_or(m.weights, t), abs=1e-12), t


def test_fitted_weights_do_not_depend_on_hashes():
    code = "import random; from skein.llm.toxicity import fit; r = random.Random(1); w = ['word%d' % k for k in range(60)]; rows = [(' '.join(r.choice(w) + r.choice(['', '.']) for _ in range(30)) + r.choice(['', ' zorkish thing', ' grumbex here. zorkish']), k % 3 // 2) for k in range(300)]; rows = [(t, int('zork' in t or 'grum' in t)) for t, _ in rows]; print(sorted(fit(rows).weights.items()))"
    said = {subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONHASHSEED": seed, "PYTHONPATH": os.getcwd()}, capture_output=True, text=True, check=True).stdout for seed in ("1", "2", "3")}
    assert len(said) == 1 and "zorkish" in said.pop()


def test_repeated_rows_and_labels(spark, make):
    rows, labels = corpus(make, 300)
    twice = spark.createDataFrame([*rows, *rows, (0, "fine words"), (None, "zorkish"), (None, None)], "doc_id long, text string").repartition(3)
    table = spark.createDataFrame([*labels, *((i, q, 0) for i, q, _ in labels), (None, None, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    got = score(twice, train(spark.createDataFrame(rows, "doc_id long, text string"), table)).collect()
    assert len(got) == 603
    text = dict(rows)
    for r in got:
        if r.doc_id:
            assert r.predicted == int(any(b in text[r.doc_id] for b in BAD))
    assert sorted(r.predicted for r in got if r.doc_id is None) == [0, 1]
