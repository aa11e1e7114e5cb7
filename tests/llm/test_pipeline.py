"""The pipeline against a brute-force version of every stage."""

import hashlib
import random
import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from skein.llm.bpe import read_ranks
from test_texts import classes, smith_waterman

BAD = ["zorkish", "vlorkant", "grumbex"]


def test_pipeline(spark, make, tmp_path):
    r = random.Random(2)
    rows, labels, items = [], [], [(k, make(900 + k, 40)) for k in range(5)]
    for i in range(400):
        words = make(i, r.randint(30, 120)).split()
        if toxic := r.random() < 0.3:
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    base = make(5000, 300)
    rows += [(1000 + k, base.replace(" ", " " * (k + 1))) for k in range(4)]  # equal but for white space
    for k in range(6):
        words = base.split()
        words[10 * k + 5] = f"edit{k}"
        rows.append((1100 + k, " ".join(words)))
    rows += [(1200 + k, make(6000 + k, 60) + " " + items[k][1]) for k in range(5)] + [(1300, None), (1301, ""), (1302, "é" * 3000)]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [(i, t or "") for i, t in rows if not any(b in (t or "") for b in BAD)]
    best = {}
    for i, t in kept:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[norm] = min(best.get(norm, (0, float("inf"))), (-len(t), i))
    kept = [(i, t) for i, t in kept if any(i == b[1] for b in best.values())]
    near = classes(kept)
    kept = [(i, t) for i, t in kept if near[i] == i]
    words = lambda t: re.findall(r"\w+", t.lower())
    kept = [(i, t) for i, t in kept if all(smith_waterman(words(u), words(t)) < 0.5 * 2 * len(words(u)) for _, u in items)]
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    expect = {(i, len(ids := plain.encode_ordinary(t)), sha(" ".join(map(str, ids)).encode()), sha(t.encode())) for i, t in kept}

    assert {tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == expect
    assert {1200, 1201} & {i for i, *_ in expect} == set() and 1302 in {i for i, *_ in expect}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("1 = 0")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
