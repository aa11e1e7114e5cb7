"""Removal of long repeated passages by a logarithmic family of sparse suffix arrays.

Every byte covered by a string of LENGTH bytes that also starts earlier (in a document of smaller id, or earlier in the
same document) is removed; overlaps count, matches never cross documents, and strings are judged on the input.

Suffixes are sampled where content says so: a place is an anchor if the hash of the GRAM bytes from it is the smallest of
some string of LENGTH bytes around it. Each such string holds an anchor, at the same offset wherever the string stands, so
no match is lost, and one suffix in about forty is kept. An entry of the suffix array has the suffix's first ORDER bytes,
by which it is sorted, fingerprints of what follows and precedes (its context: all bytes that a string around the anchor can
cover, and the halves of it), and where it stands.

Documents come in batches in the order of ids. The order of suffixes is cut into parts at fixed bounds, found on a bounded
sample of anchors; parts grow in number with the bytes of all documents. In each part a new batch's suffix array is merged with
those of all levels in one scan, in which neighbours that begin alike tell how far they match: over the whole context, which
then stands earlier and is covered, or over half of it. Then the batch becomes a level; levels that stand for equally many batches
merge when the next batch comes, so there are logarithmically many. Levels are files in the shared folder, a file for each
part, and meet later batches there (`SuffixLevels`). A task holds one part of all levels.

Entries that share only half a context with others are contested: their bytes are fetched, and their strings compared offset
by offset, in one task for each half, or by partial aggregates over all strings where more than CROWD entries share a half.
Order and equality beyond the first ORDER bytes rest on 64-bit fingerprints, not on the bytes.

Copies of a context within a batch of rows are settled before the shuffle, so a passage that a third of all documents hold
sends an entry for each batch of rows. Entries and spans travel packed, many to a row.

Null texts count as empty (nothing is removed; the digest is that of no bytes). Ids name documents: rows that repeat an id
are one document, and what is removed for any of them is removed from each. Rows without an id come after all others, in
the order of a hash of their text. An empty table gives an empty result; columns other than id and text are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.pieces import balanced
from skein.llm.words import mix
from skein.storage import materialise, new_path, remove

LENGTH, GRAM, ORDER = 100, 20, 16
#: Strings around an anchor begin at most so many bytes before it.
REACH = LENGTH - GRAM
#: A string with at most HALF bytes before the anchor has this many behind it, and one with more has more than HALF before.
HALF = REACH // 2
BEHIND = LENGTH - HALF
#: Batches of a whole table, bytes of text that a worker handles at once, bytes of text for each part of the order, bytes of text whose
#: anchors place the parts' bounds, and entries that share half a context from which they are compared by aggregates.
BATCHES, BATCH_BYTES, PART_BYTES, SAMPLE_BYTES, CROWD = 8, 1 << 19, 48 << 20, 16 << 20, 20_000
_U = np.uint64
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0x9DDFEA08EB382D69  # odd, so it has an inverse
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.empty(size, np.uint64)
            p[0], done = 1, 1
            while done < size:
                k = min(done, size - done)
                p[done : done + k] = p[:k] * _U(pow(base, done, 1 << 64))
                done += k
            made.append(p)
        _powers[:] = made
    return _powers[0], _powers[1]


class Fingerprints:
    """Hashes of any stretches of some bytes, by prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin])


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each `width` values in a row."""
    done = 1
    while done * 2 <= width:
        values = best(values[:-done], values[done:])
        done *= 2
    return best(values[: len(values) - (width - done)], values[width - done :]) if done < width else values


def anchors_of(starts: np.ndarray, ends: np.ndarray, marks: Fingerprints, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of documents that stand one after another, and the hashes of their first bytes."""
    grams = np.full(n, ~_U(0))
    at = np.arange(n - GRAM + 1)
    grams[: n - GRAM + 1] = np.minimum(marks.of(at, at + GRAM), ~_U(0) - _U(1))
    width = REACH + 1
    least = _sliding(np.concatenate([grams, np.full(width - 1, ~_U(0))]), width, np.minimum)
    # Strings that would cross the end of a document count for nothing.
    valid = np.zeros(n + 1, np.int64)
    long = ends - starts >= LENGTH
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - LENGTH + 1, -1)
    least[np.cumsum(valid[:-1]) == 0] = 0
    most = _sliding(np.concatenate([np.zeros(width - 1, np.uint64), least]), width, np.maximum)
    found = np.flatnonzero((grams == most) & (most > 0))
    return found, grams[found]


#: Columns of packed tables: entries (first bytes as two big-endian numbers, context, document, place, fingerprints of the halves
#: or 0, bytes from the place to the context's end), spans, and contested entries (name of the half, whether it is the right one).
ENTRY = {"hi": "u8", "lo": "u8", "ctx": "u8", "doc": "i8", "pos": "u4", "right": "u2", "left": "u2", "tail": "u1"}
SPAN = {"doc": "i8", "begin": "u4", "end": "u4"}
CONTESTED = {"name": "u8", "right": "u1", "doc": "i8", "pos": "u4"}
Table = dict[str, np.ndarray]


def pack(table: Table, kinds: dict[str, str], rows: slice | np.ndarray = slice(None)) -> bytes:
    return b"".join(np.ascontiguousarray(table[c][rows], k).tobytes() for c, k in kinds.items())


def unpack(blobs: list[bytes], kinds: dict[str, str]) -> Table:
    width = sum(int(k[1]) for k in kinds.values())
    parts: dict[str, list[np.ndarray]] = {c: [np.empty(0, k)] for c, k in kinds.items()}
    for blob in blobs:
        n, at = len(blob) // width, 0
        for c, k in kinds.items():
            parts[c].append(np.frombuffer(blob, k, n, at))
            at += n * int(k[1])
    return {c: np.concatenate(p) for c, p in parts.items()}


def entries_of(texts: list[bytes]) -> Table:
    """Entries of documents, doc being the number of the document in the list."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < LENGTH:
        return {c: np.empty(0, k) for c, k in ENTRY.items()}
    ends = np.cumsum(sizes)
    starts = ends - sizes
    marks = Fingerprints(data)
    at, _ = anchors_of(starts, ends, marks, len(data))
    doc = np.searchsorted(ends, at, "right")
    first = [np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)]
    for k in range(ORDER):
        first[k // 8] = first[k // 8] << _U(8) | data[at + k]
    low, high = np.maximum(starts[doc], at - REACH), np.minimum(at + LENGTH, ends[doc])
    ctx = mix(marks.of(low, high) + mix(((at - low) * 256 + (high - at)).astype(np.uint64)))
    right = marks.of(at, np.minimum(at + BEHIND, ends[doc])) % _U(65535) + _U(1)
    right[at + BEHIND > ends[doc]] = 0
    left = marks.of(np.maximum(at - HALF - 1, starts[doc]), at + GRAM) % _U(65535) + _U(1)
    left[at - HALF - 1 < starts[doc]] = 0
    return {"hi": first[0], "lo": first[1], "ctx": ctx, "doc": doc, "pos": at - starts[doc], "right": right, "left": left, "tail": high - at}


def in_suffix_order(table: Table) -> Table:
    order = np.lexsort((table["pos"], table["doc"], table["ctx"], table["lo"], table["hi"]))
    return {c: v[order] for c, v in table.items()}


def agreement(run: Table) -> tuple[np.ndarray, np.ndarray]:
    """For entries in suffix order: whether each has the context of the one before it, and the first entry of its context."""
    same = np.zeros(len(run["hi"]), bool)
    same[1:] = (run["hi"][1:] == run["hi"][:-1]) & (run["lo"][1:] == run["lo"][:-1]) & (run["ctx"][1:] == run["ctx"][:-1])
    return same, np.maximum.accumulate(np.where(same, 0, np.arange(len(same)))) if len(same) else np.empty(0, np.int64)


def merge_scan(batch: Table, levels: list[Table]) -> tuple[Table, Table, Table]:
    """Scan a batch's suffix array merged with those of the levels. Returns what the batch adds to them, the spans of its
    entries whose context stands earlier, and the contested entries (of any batch)."""
    old = sum(len(x["hi"]) for x in levels)
    both = {c: np.concatenate([*(x[c] for x in levels), batch[c]]) for c in ENTRY}
    both["new"] = np.arange(len(both["hi"])) >= old
    run = in_suffix_order(both)
    same, lead = agreement(run)
    new = run.pop("new")
    # The same place twice (a repeated row) is not an earlier one.
    covered = new & same & ((run["doc"] != run["doc"][lead]) | (run["pos"] != run["pos"][lead]))
    pos = run["pos"][covered].astype(np.int64)
    spans = {"doc": run["doc"][covered], "begin": np.maximum(pos - REACH, 0), "end": pos + run["tail"][covered]}
    fresh = new & ~same
    found = []
    for right in (True, False):
        half = run["right" if right else "left"]
        whose = np.flatnonzero(~same & (half > 0))
        name = mix(mix(run["hi"][whose] + mix(run["lo"][whose])) + mix(half[whose].astype(np.uint64) + _U(right << 32)))
        _, back, times = np.unique(name, return_inverse=True, return_counts=True)
        met = (times > 1) & (np.bincount(back, fresh[whose], len(times)) > 0)
        at = whose[met[back]]
        found.append({"name": name[met[back]], "right": np.full(len(at), right), "doc": run["doc"][at], "pos": run["pos"][at]})
    contested = {c: np.concatenate([x[c] for x in found]) for c in CONTESTED}
    return {c: run[c][fresh] for c in ENTRY}, spans, contested


def merged_spans(spans: Table) -> Table:
    """Maximal runs of the spans of each document, in order."""
    order = np.lexsort((spans["begin"], spans["doc"]))
    doc, begin, end = (spans[c][order].astype(np.int64) for c in SPAN)
    if not len(doc):
        return {"doc": doc, "begin": begin, "end": end}
    # The furthest end so far within a document: documents are numbered, and each number lifts all above those before.
    number = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    reach = np.maximum.accumulate(end + number * (1 << 33)) - number * (1 << 33)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (begin[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return {"doc": doc[first], "begin": begin[first], "end": reach[last]}


def strings_of(parts: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of stretches (doc, place, offset of the anchor, bytes): number of the stretch, begin within it, and name of each string of LENGTH bytes."""
    data = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
    sizes = np.array([len(p[3]) for p in parts], np.int64)
    starts = np.cumsum(sizes) - sizes
    number = np.maximum(sizes - LENGTH + 1, 0)
    row = np.repeat(np.arange(len(parts)), number)
    shift = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    begin = starts[row] + shift
    anchor = np.array([p[2] for p in parts], np.int64)
    return row, shift, mix(Fingerprints(data).of(begin, begin + LENGTH) + (anchor[row] - shift).astype(np.uint64))


def repeated_strings(parts: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int]]:
    """Of stretches (doc, place of its begin, offset of the anchor, bytes) with a common half: doc, begin, end of what stands earlier."""
    parts.sort(key=lambda p: (p[0], p[1] + p[2]))
    seen = np.empty(0, np.uint64)
    step = 4096
    for k in range(0, len(parts), step):
        some = parts[k : k + step]
        row, shift, name = strings_of(some)
        place = np.arange(len(some))
        for i in range(1, len(some)):  # rows at one place are not earlier than each other
            if (some[i][0], some[i][1] + some[i][2]) == (some[i - 1][0], some[i - 1][1] + some[i - 1][2]):
                place[i] = place[i - 1]
        known, first, back = np.unique(name, return_index=True, return_inverse=True)
        old = (place[row] > place[row[first[back]]]) | np.isin(name, seen)
        if len(parts) > step:
            seen = np.union1d(seen, known)
        where = np.flatnonzero(old)
        if len(where):
            breaks = np.flatnonzero((np.diff(where) != 1) | (np.diff(row[where]) != 0))
            for a, b in zip(where[np.concatenate([[0], breaks + 1])].tolist(), where[np.concatenate([breaks, [len(where) - 1]])].tolist(), strict=True):
                doc, at = some[row[a]][:2]
                yield doc, at + int(shift[a]), at + int(shift[b]) + LENGTH


_ROW = "kind int, number int, path string, blob binary"
#: Kinds of rows: packed entries of a part, spans and contested entries of a bucket of documents, and files of levels by part.
ENTRIES, SPANS, HALVES, FILE = range(4)


def _row(kind: int, number: int, path: str | None, blob: bytes | None) -> pa.RecordBatch:
    columns = [pa.array([kind], pa.int32()), pa.array([number], pa.int32()), pa.array([path], pa.string()), pa.array([blob], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["kind", "number", "path", "blob"])


def _bucketed(kind: int, table: Table, kinds: dict[str, str], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of a table dealt out by document."""
    bucket = (mix(table["doc"].astype(np.int64).view(np.uint64)) % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for rows in np.split(order, cuts) if len(order) else ():
        yield _row(kind, int(bucket[rows[0]]), None, pack(table, kinds, rows))


class SuffixLevels:
    """The levels of a corpus, in a shared folder: batches, in the order of ids, are scanned against them and then join them."""

    def __init__(self, spark: SparkSession, bounds: list[int], folder: str | None = None):
        self.spark, self.bounds, self.parts = spark, bounds, len(bounds) + 1
        self.folder = folder or new_path(spark, "suffix-levels")
        #: Of each level, from the largest: for how many batches it stands, the folder of its files, and a table of them.
        self.levels: list[tuple[int, str, DataFrame]] = []
        self.rounds = 0

    def add(self, entries: DataFrame) -> DataFrame:
        """Scan a batch's entries (number, blob), packed by part, against all levels, and make them one; returns rows of spans and contested entries."""
        groups: list[tuple[int, list[int]]] = []  # levels that merge: the batches they stand for, and their numbers
        for k, (size, _, _) in enumerate(self.levels):
            groups.append((size, [k]))
            while len(groups) > 1 and groups[-1][0] == groups[-2][0]:
                (n, own), (m, before) = groups.pop(), groups.pop()
                groups.append((n + m, before + own))
        merging = [own for _, own in groups]
        parts = self.parts
        targets = [f"{self.folder}/round-{self.rounds:06d}-{k}" for k in range(len(groups) + 1)]
        rows = entries.select("number", F.lit(-1).alias("level"), F.lit(None).cast("string").alias("path"), "blob")
        for k, (_, _, files) in enumerate(self.levels):
            rows = rows.unionByName(files.select("number", F.lit(k).alias("level"), "path", F.lit(None).cast("binary").alias("blob")))
        dealt = rows.repartition(parts, "number").sortWithinPartitions("number")

        def write(target: str, number: int, table: Table) -> pa.RecordBatch:
            system, root = fs.FileSystem.from_uri(target)
            system.create_dir(root, recursive=True)
            # Another attempt at this task writes files of its own; only returned paths are read.
            name = f"part-{number:06d}-{TaskContext.get().taskAttemptId()}.zst"
            with system.open_output_stream(f"{root}/{name}", compression="zstd") as out:
                out.write(pack(table, ENTRY))
            return _row(FILE, number, f"{target}/{name}", None)

        def load(path: str) -> Table:
            system, where = fs.FileSystem.from_uri(path)
            with system.open_input_stream(where, compression="zstd") as f:
                return unpack([f.read()], ENTRY)

        def scanned(number: int, held: list[tuple[int, str | None, bytes | None]]) -> Iterator[pa.RecordBatch]:
            batch = unpack([b for level, _, b in held if level < 0], ENTRY)
            tables = {level: load(path) for level, path, _ in held if level >= 0}
            fresh, spans, contested = merge_scan(batch, list(tables.values()))
            yield from _bucketed(SPANS, spans, SPAN, parts)
            yield from _bucketed(HALVES, contested, CONTESTED, parts)
            for target, own in zip(targets, merging):
                if len(own) > 1 and (there := [tables[k] for k in own if k in tables]):
                    yield write(target, number, in_suffix_order({c: np.concatenate([t[c] for t in there]) for c in ENTRY}))
            if len(fresh["hi"]):
                yield write(targets[-1], number, fresh)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, held = None, []
            for batch in batches:
                for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    if row[0] != number:
                        if held:
                            yield from scanned(number, held)
                        number, held = row[0], []
                    held.append(row[1:])
            if held:
                yield from scanned(number, held)

        out = materialise(dealt.mapInArrow(scan, _ROW), "scanned")
        files = out.where(F.col("kind") == FILE)
        at = lambda target: files.where(F.startswith("path", F.lit(target + "/")))
        levels, gone = [], []
        for target, (size, own) in zip(targets, groups):
            if len(own) > 1:
                levels.append((size, target, at(target)))
                gone += [self.levels[k][1] for k in own]
            else:
                levels.append(self.levels[own[0]])
        self.levels = [*levels, (1, targets[-1], at(targets[-1]))]
        self.rounds += 1
        for folder in gone:
            remove(self.spark, folder)
        return out.where(F.col("kind") != FILE)


def packed_entries(rows: DataFrame, bounds: list[int], cuts: list[int]) -> DataFrame:
    """batch, and rows of packed entries and spans, from rows (doc, text). What is repeated within a few rows is settled here."""
    edges, turns = np.array(bounds, np.uint64), np.array(cuts, np.int64)
    parts = len(bounds) + 1

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in balanced(batches, "text", BATCH_BYTES):
            docs = batch.column("doc").to_numpy().astype(np.int64)
            run = entries_of([t.encode() for t in batch.column("text").to_pylist()])
            run["doc"] = docs[run["doc"]]
            run = in_suffix_order(run)
            same, lead = agreement(run)
            covered = same & ((run["doc"] != run["doc"][lead]) | (run["pos"] != run["pos"][lead]))
            pos = run["pos"][covered]
            spans = merged_spans({"doc": run["doc"][covered], "begin": np.maximum(pos - REACH, 0), "end": pos + run["tail"][covered]})
            out = [(0, r) for r in _bucketed(SPANS, spans, SPAN, parts)]
            turn = np.searchsorted(turns, run["doc"])
            part = np.searchsorted(edges, run["hi"], "right")
            left = np.flatnonzero(~same)
            for k in np.unique(turn[left]).tolist():
                own = left[turn[left] == k]
                for some in np.split(own, np.flatnonzero(np.diff(part[own])) + 1):
                    out.append((k, _row(ENTRIES, int(part[some[0]]), None, pack(run, ENTRY, some))))
            if out:
                whole = pa.Table.from_batches([r for _, r in out]).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), *whole.columns], ["batch", *whole.schema.names])

    return rows.mapInArrow(enter, "batch int, " + _ROW)


def bounds_of(rows: DataFrame, total: int, parts: int) -> list[int]:
    """Where the order of suffixes is cut into parts: quantiles over the anchors of about SAMPLE_BYTES of text."""
    if parts < 2:
        return []
    every = max(1, total // SAMPLE_BYTES)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in balanced(batches, "text", BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array([pack(entries_of([t.encode() for t in batch.column("text").to_pylist()]), {"hi": "u8"})], pa.binary())], ["blob"])

    sample = rows.where(F.pmod(F.xxhash64("doc", "text"), F.lit(every)) == 0).mapInArrow(look, "blob binary")
    found = np.sort(np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(r.blob, np.uint64) for r in sample.toLocalIterator())]))
    return sorted({int(found[len(found) * k // parts]) for k in range(1, parts)}) if len(found) else []


def _per_document(rows: DataFrame, kinds: dict[str, str], parts: int, schema: str, arrays: Callable[[Table], tuple[Table, list[str]]]) -> DataFrame:
    """One row for each document, with arrays, from packed rows of buckets."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, blobs = None, []

        def turn() -> Iterator[pa.RecordBatch]:
            table, columns = arrays(unpack(blobs, kinds))
            if len(table["doc"]):
                first = np.flatnonzero(np.concatenate([[True], np.diff(table["doc"]) != 0]))
                offsets = pa.array(np.append(first, len(table["doc"])), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(table[c].astype(np.int64)))) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(table["doc"][first].astype(np.int64)), *lists], ["doc", *columns])

        for batch in batches:
            for n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n != number and blobs:
                    yield from turn()
                    blobs = []
                number = n
                blobs.append(blob)
        if blobs:
            yield from turn()

    return rows.select("number", "blob").repartition(parts, "number").sortWithinPartitions("number").mapInArrow(gather, schema)


def _places(table: Table) -> tuple[Table, list[str]]:
    rows = np.unique(np.stack([table["doc"].view(np.uint64), table["pos"].astype(np.uint64), table["name"], table["right"].astype(np.uint64)], 1), axis=0)
    out = {"doc": rows[:, 0].view(np.int64), "pos": rows[:, 1], "name": rows[:, 2].view(np.int64), "right": rows[:, 3]}
    order = np.argsort(out["doc"], kind="stable")
    return {c: v[order] for c, v in out.items()}, ["pos", "name", "right"]


def settled_halves(rows: DataFrame, contested: DataFrame, parts: int, crowd: int) -> DataFrame:
    """Rows of spans from contested entries, by the bytes around them. rows: doc, text."""
    places = materialise(_per_document(contested, CONTESTED, parts, "doc long, pos array<long>, name array<long>, right array<long>", _places), "contested")
    crowded = places.select(F.explode("name").alias("name")).groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("name")
    crowded = materialise(crowded, "crowded")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in balanced(batches, "text", BATCH_BYTES):
            out: list[list] = [[], [], [], [], []]
            for doc, text, *of in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "pos", "name", "right")), strict=True):
                data = text.encode()
                for pos, name, right in zip(*of, strict=True):
                    # Strings with the right half begin at most HALF bytes before the anchor, the others before that.
                    low, high = (max(0, pos - HALF), pos + LENGTH) if right else (max(0, pos - REACH), pos + LENGTH - HALF - 1)
                    for column, value in zip(out, (name, doc, low, pos - low, data[low:high]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], ["name", "doc", "begin", "anchor", "data"])

    fetched = rows.join(places, "doc").select("doc", "text", "pos", "name", "right").mapInArrow(fetch, "name long, doc long, begin long, anchor long, data binary")
    busy = not crowded.isEmpty()
    if busy:  # two ways lead on from here
        fetched = materialise(fetched, "stretches")
    few = (fetched.join(crowded, "name", "left_anti") if busy else fetched).repartition("name").sortWithinPartitions("name")

    def spans(found: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        yield from _bucketed(SPANS, merged_spans(dict(zip(SPAN, np.array(found, np.int64).reshape(-1, 3).T))), SPAN, parts)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []
        out: list[tuple[int, int, int]] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if row[0] != name:
                    out += repeated_strings(held)
                    name, held = row[0], []
                held.append(row[1:])
            if len(out) > 100_000:
                yield from spans(out)
                out = []
        yield from spans(out + [*repeated_strings(held)])

    settled = materialise(few.mapInArrow(compare, _ROW), "halves")
    if not busy:
        return settled

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                some = list(zip(*(batch.column(c).slice(k, 1024).to_pylist() for c in ("doc", "begin", "anchor", "data")), strict=True))
                row, shift, name = strings_of(some)
                half = np.array(batch.column("name").slice(k, 1024), np.int64).view(np.uint64)
                doc, at = (np.array([x[c] for x in some], np.int64)[row] for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(mix(name + mix(half[row])).view(np.int64)), pa.array(doc), pa.array(at + shift)], ["string", "doc", "begin"])

    many = materialise(fetched.join(crowded, "name", "left_semi").mapInArrow(strings, "string long, doc long, begin long"), "strings")
    first = many.groupBy("string").agg(F.min(F.struct("doc", "begin")).alias("at"), F.max(F.struct("doc", "begin")).alias("last")).where("at <> last").select("string", "at")
    later = many.join(materialise(first, "first"), "string").where("struct(doc, begin) <> at").select("doc", "begin")

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, begin = (batch.column(k).to_numpy() for k in range(2))
            yield from _bucketed(SPANS, merged_spans({"doc": doc, "begin": begin, "end": begin + LENGTH}), SPAN, parts)

    return settled.unionByName(materialise(later.mapInArrow(cover, _ROW), "crowded-halves"))


def repeated_spans(rows: DataFrame, batches: int = BATCHES, part_bytes: int = PART_BYTES, crowd: int = CROWD) -> DataFrame:
    """doc, begin, end (arrays) of the stretches to remove, in order and apart, from rows (doc, text)."""
    spark = rows.sparkSession
    share = ",".join(str(k / batches) for k in range(1, batches))
    known = rows.agg(F.sum(F.octet_length("text")).alias("n"), F.expr(f"percentile_approx(doc, array({share}), 10000)" if share else "null").alias("cuts")).first()
    total, cuts = known.n or 0, known.cuts or []
    parts = max(1, -(-total // part_bytes))
    if total >= BATCH_BYTES:
        parts = max(parts, spark.sparkContext.defaultParallelism)
    levels = SuffixLevels(spark, bounds_of(rows, total, parts))
    entered = materialise(packed_entries(rows, levels.bounds, cuts), "entries", by=("kind", "batch"))
    found = [entered.where(F.col("kind") == SPANS).drop("batch")]
    for k in range(len(cuts) + 1):
        found.append(levels.add(entered.where((F.col("kind") == ENTRIES) & (F.col("batch") == k)).select("number", "blob")))
        remove(spark, f"{entered._skein_path}/kind={ENTRIES}/batch={k}")  # it stands in the levels now
    everything = reduce(DataFrame.unionByName, found)
    halves = settled_halves(rows, everything.where(F.col("kind") == HALVES), levels.parts, crowd)
    spans = everything.where(F.col("kind") == SPANS).unionByName(halves)
    return _per_document(spans, SPAN, levels.parts, "doc long, begin array<long>, end array<long>", lambda t: (merged_spans(t), ["begin", "end"]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, with_text: bool = False, part_bytes: int = PART_BYTES, crowd: int = CROWD) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_text what is left (bytes)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    last = F.lit(1 << 62) + F.abs(F.xxhash64(text) % (1 << 61))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), last).alias("doc"), text.alias("text"))
    spans = repeated_spans(rows.select("doc", "text"), batches, part_bytes, crowd)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in balanced(parts, "text", 4 * BATCH_BYTES):
            out = []
            for id_, value, begin, end in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "begin", "end")), strict=True):
                data = value.encode()
                # Rows of one id may differ: a stretch of another row may lie beyond this one's end.
                runs = [(a, min(b, len(data))) for a, b in zip(begin or (), end or ()) if a < len(data)]
                kept = b"".join(data[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(data)]))
                out.append((id_, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out)) if out else [[]] * 6
            arrays = [*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string()), pa.array(columns[5], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_text], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    return rows.join(spans, "doc", "left").select("doc_id", "text", "begin", "end").mapInArrow(cut, schema)
