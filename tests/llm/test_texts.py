"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from skein.llm import token_store
from skein.llm.bpe import bpe_ids, bpe_round_trip, read_ranks
from skein.llm.decontamination import align, contaminated, drop_contaminated
from skein.llm.exact_dedup import drop_copies, exact_groups
from skein.llm.near_dedup import drop_near_copies, near_groups, similarity
from skein.llm.suffix_dedup import SPAN, SuffixLevels, bounds_of, packed_entries, remove_repeats, settled_halves, unpack
from skein.llm.token_counts import token_counts
from skein.storage import materialise

RANKS, JSON, MODEL = (public_tokenizers.path(x) for x in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_bpe_is_what_the_merges_give(docs, no_docs, texts):
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    got = by_id(bpe_round_trip(docs, RANKS, public_tokenizers.PATTERN), "n_tokens", "ids_sha256", "decoded_sha256")
    for i, t in texts:
        ids = plain.encode_ordinary(t or "")
        assert got[i] == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())), i
    listed = by_id(bpe_ids(docs, RANKS, public_tokenizers.PATTERN), "ids")
    assert listed[8][0] == plain.encode_ordinary(texts[8][1])
    assert bpe_round_trip(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_token_counts_are_the_library_s(docs, no_docs, texts):
    library = Tokenizer.from_file(JSON)
    got = by_id(token_counts(docs, JSON, 512), "n_bytes", "n_tokens", "over_limit")
    for i, t in texts:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 512), i
    assert token_counts(no_docs, JSON, 512).count() == 0


def test_texts_cut_into_parts_have_the_library_s_tokens(monkeypatch):
    import random

    import pyarrow as pa

    from skein.llm import pieces
    from skein.llm.bpe import pair_encoder
    from skein.llm.token_counts import library_encoder

    monkeypatch.setattr(pieces, "PART", 7)  # cut wherever it is safe
    r = random.Random(6)
    bits = ["word", "don't", " ", "  ", "\t", "\n", "\r\n", "12", "3,4", "é", "日本", "½", "\u00a0", "\x1c", "\x85", "\u3000", "'s", "'", "!?", "a b", "𝔘", "\u0301", "\u200b", "_", "x y z"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    library = Tokenizer.from_file(JSON)
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    for encoder, ids_of in ((library_encoder(JSON), lambda t: library.encode(t, add_special_tokens=False).ids), (pair_encoder(RANKS, public_tokenizers.PATTERN)[0], plain.encode_ordinary)):
        ids, counts = encoder.encode(pa.array(texts))
        ends = np.cumsum(counts)
        for t, end, n in zip(texts, ends.tolist(), counts.tolist()):
            assert ids[end - n : end].tolist() == ids_of(t), repr(t)
    assert len(list(pieces.parts_of("one two three four\t five six"))) == 3


def test_repeated_rows_and_rows_without_ids_are_encoded_each_on_its_own(spark, make):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "d e f"), (None, "d e f"), (None, None), (2, "")]
    table = spark.createDataFrame([(*x, "k", 7) for x in rows], "doc_id long, text string, ids string, n_tokens int").repartition(3)
    library = Tokenizer.from_file(JSON)
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    expect = sorted(((i, n(t)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_tokens) for r in token_counts(table, JSON, 512).collect()), key=str) == expect
    assert sorted(((r.doc_id, r.n_tokens) for r in bpe_round_trip(table, RANKS, public_tokenizers.PATTERN).collect()), key=str) == expect
    stored = token_store.store_round_trip(table, JSON, 2).collect()
    assert sorted(((r.doc_id, r.n_tokens - 1) for r in stored), key=str) == expect
    at = 0
    for r in sorted(stored, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_repeated_documents_and_items_of_a_benchmark(spark, make):
    leak = make(77, 40)
    rows = [(1, "x " + leak), (1, "x " + leak), (1, make(78, 60)), (None, leak), (None, leak), (None, make(79, 60)), (2, None)]
    docs = spark.createDataFrame([(*x, "i", 0.5) for x in rows], "doc_id long, text string, item_id string, score double").repartition(2)
    bench = spark.createDataFrame([(5, leak), (5, leak), (None, leak), (None, None)], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in contaminated(docs, bench).collect())
    assert got == {(1, 5): 4, (1, None): 2, (None, 5): 4, (None, None): 2}
    assert sorted((r.doc_id, r.text) for r in drop_contaminated(docs, bench).where("text is not null and doc_id is not null").collect()) == [(1, make(78, 60))]
    assert drop_contaminated(docs, bench).count() == 3 and drop_contaminated(docs, bench.where("1 = 0")).count() == 7


def test_token_counts_of_a_sentencepiece_model(docs, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = by_id(token_counts(docs, MODEL, 512), "n_tokens")
    assert got == {i: (len(model.encode(t or "")),) for i, t in texts}


def test_token_store_round_trip(docs, no_docs, texts):
    library = Tokenizer.from_file(JSON)
    got = by_id(token_store.store_round_trip(docs, JSON, 2), "start", "n_tokens", "ids_crc32")
    start = 0
    for i, t in sorted(texts, key=lambda x: -1 if x[0] is None else x[0]):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_store.store_round_trip(no_docs, JSON, 2).count() == 0


@pytest.mark.parametrize("n", [1, 511, 512, 513, 70000])
def test_range_coder_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.2, n), 60000).astype(np.uint32)
    table = token_store.Table.of(Counter(ids.tolist()))
    assert sum(table.frequencies) == 1 << token_store.SCALE
    data = token_store.encode_block(ids, table)
    assert (token_store.decode_block(data, n, table) == ids).all()


def test_store_file_reads_ranges_and_sees_damage(tmp_path):
    ids = np.random.default_rng(1).integers(0, 50, 3 * token_store.BLOCK + 5).astype(np.uint32)
    table = token_store.Table.of(Counter(ids.tolist()))
    path = f"file://{tmp_path}/f"
    token_store.write_file(path, [(1, len(ids))], iter(np.array_split(ids, 7)), table)
    file = token_store.StoreFile(path, table)
    for a, b in ((0, 3), (token_store.BLOCK - 1, token_store.BLOCK + 1), (5, len(ids))):
        assert (file.ids(a, b) == ids[a:b]).all()
    data = bytearray((tmp_path / "f").read_bytes())
    data[token_store.BLOCK // 4] ^= 1
    (tmp_path / "f").write_bytes(data)
    with pytest.raises(ValueError, match="damaged"):
        list(token_store.StoreFile(path, table).documents())


def test_exact_groups(spark, docs, no_docs, texts):
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in texts}
    groups = defaultdict(list)
    for i, t in texts:
        groups[norm[i]].append((-len(t or ""), float("inf") if i is None else i, i))
    got = by_id(exact_groups(docs), "keep_id", "group_size", "kept", "text_sha256")
    for i, _ in texts:
        keep = min(groups[norm[i]])[2]
        assert got[i] == (keep, len(groups[norm[i]]), keep == i, sha(norm[i].encode())), i
    assert exact_groups(no_docs).count() == 0
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, v in got.items() if v[2]}


def test_exact_groups_that_part_late_and_repeat(spark):
    long = "x" * 600
    rows = [(1, long + "a"), (2, long + "b"), (3, long + "a"), (4, "x" * 64), (5, "x" * 64), (6, long + "a "), (7, "y"), (7, "y")]
    got = defaultdict(list)
    for r in exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].append((r.keep_id, r.group_size, r.kept))
    assert got == {1: [(6, 3, False)], 2: [(2, 1, True)], 3: [(6, 3, False)], 4: [(4, 2, True)], 5: [(4, 2, False)], 6: [(6, 3, True)], 7: [(7, 2, True)] * 2}


def removed(texts):
    """Brute force: every string of 100 bytes, by its first place."""
    first, masks = {}, {}
    rows = [(i, (t or "").encode()) for i, t in texts]
    for i, b in rows:
        for p in range(len(b) - 99):
            first[b[p : p + 100]] = min(first.get(b[p : p + 100], (i, p)), (i, p))
    for i, b in rows:
        m = np.zeros(len(b) + 2, bool)
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] < (i, p):
                m[p + 1 : p + 101] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~m[1:-1]])
        masks[i] = (len(b), int(m.sum()), int((m[1:] & ~m[:-1]).sum()), sha(kept))
    return masks


@pytest.mark.parametrize("batches", [1, 5])
def test_repeated_passages(docs, no_docs, texts, batches):
    got = by_id(remove_repeats(docs.repartition(3), batches=batches), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got.pop(None) == (5, 0, 0, sha(b"no id"))
    assert got == removed([x for x in texts if x[0] is not None])
    if batches == 1:
        assert remove_repeats(no_docs).count() == 0


def test_repeated_passages_of_many_forms(spark):
    import random

    r = random.Random(3)
    pool = ["".join(r.choice("ab c") for _ in range(r.randint(40, 300))) for _ in range(6)]
    rows = [(d, "".join(r.choice([r.choice(pool), "".join(r.choice("abc") for _ in range(r.randint(1, 150))), "é" * 60])[r.randint(0, 9) :] for _ in range(r.randint(0, 5)))) for d in range(40)]
    rows.append(rows[5])  # a repeated row
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expect = removed(rows[:-1])
    for how in ({}, {"part_bytes": 1500, "crowd": 3}, {"batches": 3, "part_bytes": 4000, "crowd": 0}):
        got = by_id(remove_repeats(table, with_text=True, **how), "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == expect, how


def test_batches_meet_stored_levels(spark):
    import random

    r = random.Random(8)
    pool = ["".join(r.choice("abcdef gh") for _ in range(r.randint(90, 400))) for _ in range(8)]
    rows = [(d, "".join(r.choice([r.choice(pool), "".join(r.choice("abc") for _ in range(r.randint(1, 150)))])[r.randint(0, 9) :] for _ in range(r.randint(0, 5)))) for d in range(70)]
    expect = removed(rows)
    whole = spark.createDataFrame(rows, "doc long, text string")
    first = SuffixLevels(spark, bounds_of(whole, sum(len(t) for _, t in rows), 5))
    found = []
    for k in range(7):  # one batch after another, as they come in; each is given to add() alone
        entered = materialise(packed_entries(whole.where(f"doc div 10 = {k}"), first.bounds, []), "entries")
        found += [entered.where("kind = 1").drop("batch"), first.add(entered.where("kind = 0").select("number", "blob"))]
    assert [size for size, _, _ in first.levels] == [4, 2, 1]
    every = reduce(DataFrame.unionByName, found)
    spans = every.where("kind = 1").unionByName(settled_halves(whole, every.where("kind = 2"), first.parts, 100))
    table: dict[int, list] = defaultdict(list)
    for x in spans.collect():
        got = unpack([x.blob], SPAN)
        for d, a, b in zip(got["doc"].tolist(), got["begin"].tolist(), got["end"].tolist()):
            table[d].append((a, b))
    for d, t in rows:
        assert expect[d][1] == len({x for a, b in table[d] for x in range(a, b)}), d


def shingles(t):
    w = re.findall(r"\w+", (t or "").lower())
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w) or (t or "").strip()])


def alike(a, b):
    plain = len(a.keys() & b.keys()) / len(a.keys() | b.keys())
    both = a.keys() | b.keys()
    return max(plain, sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in both) for i in a.keys() & b.keys()))


def classes(rows):
    """Brute force: all pairs, connected."""
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    while True:
        before = dict(label)
        for i in sets:
            for j in sets:
                if i < j and label[i] != label[j] and alike(sets[i], sets[j]) >= 0.8:
                    low, high = sorted((label[i], label[j]))
                    label = {k: low if v == high else v for k, v in label.items()}
        if label == before:
            return label


def test_near_groups(docs, no_docs, texts):
    rows = [x for x in texts if x[0] is not None]
    got = by_id(near_groups(docs), "class_id", "kept")
    assert got.pop(None) == (None, True)
    assert got == {i: (c, c == i) for i, c in classes(rows).items()}
    assert near_groups(no_docs).count() == 0
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, v in got.items() if v[1]} | {None}


@pytest.mark.parametrize("kind", ["edits", "repeats", "passage", "cuts", "families"])
def test_crowded_buckets_lose_no_link(spark, make, monkeypatch, kind):
    """Crowds of texts that share much, most of them below 0.8 of each other, against all pairs."""
    import random

    from skein.llm import near_dedup

    monkeypatch.setattr(near_dedup, "SMALL", 6)  # nearly all buckets are crowded
    r = random.Random(kind)
    base = make(70, 120).split()
    rows = []

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            k = r.randrange(len(words))
            words[k : k + r.randint(0, 1)] = [f"w{r.randrange(60)}"] * r.randint(0, 2)
        return words

    for i in range(160):
        if kind == "edits":
            words = edited(base, r.randint(0, 7))
        elif kind == "repeats":
            words = edited(make(800 + i, r.randint(5, 40)).split(), 1) + ["is", "on", "he"] * r.randint(15, 30)
            words = edited(words, r.randint(0, 2)) if r.random() < 0.8 else rows[r.randrange(len(rows))][1].split() + ["end"] if rows else words
        elif kind == "passage":
            words = make(800 + i // 3, r.randint(8, 20)).split() + base[:70] + make(900 + i // 2, 12).split()
        elif kind == "cuts":
            words = base[r.randrange(30) :][: r.randint(60, 120)] * r.choice([1, 1, 2])
        else:
            words = edited(base[:60] + make(500 + i % 4, 60).split(), r.randint(0, 5)) * r.choice([1, 1, 1, 2])
        rows.append((i, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {i: c for i, (c,) in by_id(near_groups(table), "class_id").items()}
    grams = {i: near_dedup.shingles([t])[1:] for i, t in rows}
    linked = lambda i, j: near_dedup.similarity(grams[i], grams[j]) >= 0.8
    expect, left = {}, set(grams)
    while left:  # connected by all pairs
        todo = [first := min(left)]
        while todo:
            i = todo.pop()
            if i in left:
                left.discard(i)
                expect[i] = first
                todo += [j for j in left if linked(i, j)]
    # Banding may miss a pair, so classes may be finer than by all pairs, but never coarser.
    assert all(expect[c] == expect[i] for i, c in got.items())
    assert len(set(got.values())) <= len(set(expect.values())) + 1
    bands = defaultdict(set)
    for x in near_dedup.sketches(table.selectExpr("doc_id", "text", "0L AS t")).collect():
        for b in x.bands:
            bands[b].add(x.doc_id)
    pairs = {(i, j) for held in bands.values() for i in held for j in held if i < j and got[i] != got[j]}
    assert not any(linked(i, j) for i, j in pairs)


def test_near_groups_of_chains_and_a_large_bucket(spark, make):
    import random

    words = make(11, 300).split()
    rows, at = [(0, " ".join(words))], words
    for k in range(1, 8):  # a chain: each differs from the one before, its ends hardly meet
        at = [*at]
        for p in random.Random(k).sample(range(0, 300, 6), 6):
            at[p] = f"new{k}"
        rows.append((k, " ".join(at)))
    for k in range(8, 90):  # many copies of one text with an edit each
        w = make(12, 200).split()
        w[random.Random(k).randrange(200)] = f"edit{k}"
        rows.append((k, " ".join(w)))
    rows += [(100, make(13, 200)), (101, "line one of five words. " * 20 + "x"), (102, "line one of five words. " * 20 + "y")]
    got = by_id(near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), "class_id")
    assert {i: c for i, (c,) in got.items()} == classes(rows)


def test_similarity_is_the_probability_jaccard():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = ({int(x): int(rng.integers(1, 5)) for x in rng.choice(30, 12, replace=False)} for _ in range(2))
        as_arrays = lambda d: (np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)]))
        assert similarity(as_arrays(a), as_arrays(b)) == pytest.approx(alike(Counter(a), Counter(b)))


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 20)), rng.integers(0, 6, rng.integers(1, 30))
        assert align(a, b)[0] == smith_waterman(a.tolist(), b.tolist())


def test_contamination(spark, docs, no_docs, make):
    items = [(0, make(50, 40)), (1, make(51, 30)), (2, None), (3, ""), (4, "two words"), (5, make(52, 35)), (None, make(53, 30))]
    edited = items[1][1].split()
    edited[10:12] = ["other"]
    edited[20] = "word"
    rows = [(100, make(60, 200) + " " + items[0][1].upper() + ". " + make(61, 100)), (101, make(62, 90) + " " + " ".join(edited)), (102, make(63, 500)), (103, None), (104, ""), (105, "x two words y"), (106, items[6][1])]
    rows += [(200 + k, make(300 + k, 50) + " " + items[5][1]) for k in range(60)]  # an item that leaked widely
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' AS item_id", "1 AS score")
    got = {(r.doc_id, r.item_id): r.score for r in contaminated(table.repartition(4), bench).collect()}
    expect = {}
    for d, t in rows:
        for i, u in items:
            a, b = re.findall(r"\w+", (u or "").lower()), re.findall(r"\w+", (t or "").lower())
            if a and b and (s := smith_waterman(a, b) / (2 * len(a))) >= 0.5:
                expect[d, i] = s
    assert got == pytest.approx(expect)
    assert {(100, 0), (101, 1), (105, 4), (106, None), (259, 5)} <= got.keys()
    kept = drop_contaminated(table, bench)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in got}
    assert contaminated(no_docs, bench).count() == 0
    assert contaminated(table, bench.where("1 = 0")).count() == 0


def test_contamination_by_an_edited_passage_that_is_itself_copied(spark, make):
    words = [f"item{k}" for k in range(40)]
    edited = " ".join("other" if k % 5 == 4 else w for k, w in enumerate(words))
    rows = [(k, make(700 + k, 60) + (" " + edited if k < 5 else "")) for k in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id): r.score for r in contaminated(table, spark.createDataFrame([(0, " ".join(words))], "item_id long, text string")).collect()}
    assert got == pytest.approx({(k, 0): smith_waterman(words, edited.split()) / 80 for k in range(5)})


def test_filters_drop_the_rejected_rows_alone(spark, make):
    leak, clean = make(800, 40), [make(801 + k, 60) for k in range(4)]
    near = " ".join([*clean[0].split()[:59], "changed"])
    stay = lambda rows, drop: sorted(map(tuple, drop(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    rows = [(7, "a b"), (7, "ab"), (7, clean[0]), (None, "c d"), (None, "cd"), (None, clean[1]), (8, clean[2]), (8, "a  b ")]
    assert stay(rows, drop_copies) == sorted([(8, "a  b "), (7, clean[0]), (None, "c d"), (None, clean[1]), (8, clean[2])], key=str)
    rows = [(1, clean[0]), (3, near), (7, near), (7, clean[1]), (None, near), (None, clean[2]), (None, None)]
    assert stay(rows, drop_near_copies) == sorted([(1, clean[0]), (7, clean[1]), (None, clean[2]), (None, None)], key=str)
    rows = [(7, leak), (7, clean[0]), (None, "x " + leak), (None, clean[1]), (None, None), (8, clean[2])]
    bench = spark.createDataFrame([(0, leak)], "item_id long, text string")
    assert stay(rows, lambda docs: drop_contaminated(docs, bench)) == sorted([(7, clean[0]), (None, clean[1]), (None, None), (8, clean[2])], key=str)


def test_near_groups_of_two_texts_under_one_id(spark, make):
    edit = lambda text, k: " ".join([*text.split()[:-1], f"edit{k}"])
    one, two, three = (make(900 + k, 80) for k in range(3))
    rows = [(7, one), (7, two), (5, three), (5, edit(two, 1)), (9, edit(one, 2)), (10, edit(two, 3)), (11, edit(three, 4)), (None, edit(one, 5)), (None, make(904, 80))]
    expect = [(5, 5, True), (5, 5, True), (7, 5, False), (7, 7, True), (9, 7, False), (10, 5, False), (11, 5, False), (None, 7, False), (None, None, True)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, near_groups(table).collect()), key=str) == sorted(expect, key=str)
    assert sorted(map(tuple, drop_near_copies(table).collect()), key=str) == sorted([rows[0], rows[2], rows[3], rows[8]], key=str)
