"""Token ids in files: a static range asymmetric numeral system over independent interleaved blocks.

Documents are put in ascending order of their ids by a range shuffle of texts, encoded, and their ids left in plain
scratch files, one for each range; the ranges' counts of each id add up to one frequency table, which all files share.
Then each range's ids are coded in blocks. A block is coded by itself, by LANES interleaved coders whose 64-bit states
step together, so that a step is a handful of array operations. A file's footer has for each block a checkpoint (where its
bytes are, its first id's number) and two checksums (of the bytes, and of the ids), and the documents' ids and lengths, so
blocks can be decoded in any order and by many readers.

File, all integers little-endian: magic, blocks (final states of the lanes, 64-bit; then the 32-bit words in the order in
which a decoder takes them), footer (compressed JSON), place and size of the footer, magic. The folder's `table` file holds
the shared table: compressed JSON of ids, frequencies (they add up to 2 ** SCALE) and the checksum that files refer to.

Null texts count as empty; a document is its ids and the end id, so an empty one has one id. Repeated rows are documents
of their own, in the order of a hash of their text; rows without an id come first. An empty table gives an empty folder
and an empty result; columns other than id and text are ignored, whatever their names. A vocabulary of more than 2 ** (SCALE - 1)
different ids raises an error: the table could not give each a frequency worth having.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.pieces import balanced
from skein.llm.token_counts import library_encoder
from skein.storage import each_alone, materialise, new_path, remove

MAGIC = b"SKEINRANS1"
#: Bits of the sum of frequencies, coders in a block, ids in a block, bits of a word, least state.
SCALE, LANES, BLOCK, WORD, LEAST = 20, 512, 1 << 17, 32, 1 << 31
_U = np.uint64


class Table:
    """A shared table of frequencies."""

    def __init__(self, symbols: list[int], frequencies: list[int]):
        self.symbols, self.frequencies = symbols, frequencies
        size = max(symbols, default=0) + 1
        freq = np.zeros(size, np.uint64)
        freq[symbols] = np.array(frequencies, np.uint64)
        self.freq = freq
        self.below = np.cumsum(freq) - freq
        self.symbol_at = np.repeat(np.arange(size, dtype=np.uint32), freq.astype(np.int64))
        self.most = freq << _U(63 - SCALE)  # a state from here on would not leave room; no symbol's exceeds 2 ** 63
        self.checksum = zlib.crc32(json.dumps([symbols, frequencies]).encode())

    @classmethod
    def of(cls, counts: dict[int, int]) -> Table:
        """Frequencies in proportion to counts, at least 1 each."""
        symbols = sorted(s for s, n in counts.items() if n > 0)
        if len(symbols) > 1 << (SCALE - 1):
            raise ValueError(f"{len(symbols)} different ids are more than a table of 2 ** {SCALE} can tell apart")
        if not symbols:
            return cls([], [])
        total, room = sum(counts[s] for s in symbols), (1 << SCALE) - len(symbols)
        shares = [counts[s] * room // total for s in symbols]
        left = room - sum(shares)
        for k in sorted(range(len(symbols)), key=lambda k: (-(counts[symbols[k]] * room % total), k))[:left]:
            shares[k] += 1
        return cls(symbols, [1 + s for s in shares])

    def write(self, path: str) -> None:
        system, where = fs.FileSystem.from_uri(path)
        system.create_dir(where.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(where, compression=None) as out:
            out.write(zlib.compress(json.dumps({"symbols": self.symbols, "frequencies": self.frequencies, "scale": SCALE, "checksum": self.checksum}).encode()))

    @classmethod
    def read(cls, path: str) -> Table:
        system, where = fs.FileSystem.from_uri(path)
        with system.open_input_stream(where, compression=None) as f:
            got = json.loads(zlib.decompress(f.read()))
        table = cls(got["symbols"], got["frequencies"])
        if got["scale"] != SCALE or table.checksum != got["checksum"]:
            raise ValueError("the frequency table is damaged or of another kind")
        return table


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """Final states of the lanes and the words of a block; id i is lane i % LANES's."""
    state = np.full(LANES, LEAST, np.uint64)
    words: list[np.ndarray] = []
    freq, below, most = table.freq[ids], table.below[ids], table.most[ids]
    for begin in range((len(ids) - 1) // LANES * LANES, -1, -LANES):
        f, c, m = freq[begin : begin + LANES], below[begin : begin + LANES], most[begin : begin + LANES]
        x = state[: len(f)]
        full = x >= m
        words.append(x[full].astype(np.uint32))  # the low word leaves
        x = np.where(full, x >> _U(WORD), x)
        q = x // f
        state[: len(f)] = (q << _U(SCALE)) + (x - q * f) + c
    return state.tobytes() + (np.concatenate(words[::-1]).tobytes() if words else b"")


def decode_block(data: bytes, n: int, table: Table) -> np.ndarray:
    state = np.frombuffer(data, np.uint64, LANES).copy()
    words = np.frombuffer(data, np.uint32, offset=8 * LANES)
    out, at, mask = np.empty(n, np.uint32), 0, _U((1 << SCALE) - 1)
    for begin in range(0, n, LANES):
        x = state[: min(LANES, n - begin)]
        slot = x & mask
        ids = table.symbol_at[slot]
        out[begin : begin + len(x)] = ids
        x = table.freq[ids] * (x >> _U(SCALE)) + slot - table.below[ids]
        low = np.flatnonzero(x < _U(LEAST))
        x[low] = (x[low] << _U(WORD)) | words[at : at + len(low)]
        at += len(low)
        state[: len(x)] = x
    if at != len(words) or (state != LEAST).any():
        raise ValueError("a block does not end where it should")
    return out


def write_file(path: str, docs: list[tuple[int | None, int]], stream: Iterator[np.ndarray], table: Table) -> None:
    """Code a range's documents (id, number of ids) whose ids come in pieces from stream."""
    system, where = fs.FileSystem.from_uri(path)
    blocks, held, size, at, first = [], [], 0, len(MAGIC), 0
    with system.open_output_stream(where, compression=None) as out:
        out.write(MAGIC)

        def flush(ids: np.ndarray) -> None:
            nonlocal at, first
            data = encode_block(ids, table)
            blocks.append([at, len(data), first, len(ids), zlib.crc32(data), zlib.crc32(ids.astype("<u4").tobytes())])
            out.write(data)
            at += len(data)
            first += len(ids)

        for piece in stream:
            held.append(piece)
            size += len(piece)
            if size >= BLOCK:
                ids = np.concatenate(held)
                whole = size // BLOCK * BLOCK
                for k in range(0, whole, BLOCK):
                    flush(ids[k : k + BLOCK])
                held, size = [ids[whole:]], size - whole
        if size:
            flush(np.concatenate(held))
        footer = zlib.compress(json.dumps({"table": table.checksum, "blocks": blocks, "docs": docs}).encode())
        out.write(footer + struct.pack("<QQ", at, len(footer)) + MAGIC)


class StoreFile:
    """A file to read: blocks in any order, or the documents one after another."""

    def __init__(self, path: str, table: Table):
        system, where = fs.FileSystem.from_uri(path)
        self.file, self.table = system.open_input_file(where), table
        tail = 16 + len(MAGIC)
        self.file.seek(self.file.size() - tail)
        at, n = struct.unpack("<QQ", (end := self.file.read(tail))[:16])
        if end[16:] != MAGIC:
            raise ValueError(f"{path} has no end mark")
        self.file.seek(at)
        footer = json.loads(zlib.decompress(self.file.read(n)))
        if footer["table"] != table.checksum:
            raise ValueError(f"{path} is coded by another table")
        self.blocks, self.docs = footer["blocks"], footer["docs"]

    def block(self, k: int) -> np.ndarray:
        at, size, _, n, of_bytes, of_ids = self.blocks[k]
        self.file.seek(at)
        data = self.file.read(size)
        if zlib.crc32(data) != of_bytes:
            raise ValueError(f"the bytes of block {k} are damaged")
        ids = decode_block(data, n, self.table)
        if zlib.crc32(ids.astype("<u4").tobytes()) != of_ids:
            raise ValueError(f"the ids of block {k} are damaged")
        return ids

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids begin to end of the file, from the blocks that hold them."""
        firsts = [b[2] for b in self.blocks]
        parts = []
        for k in range(max(0, bisect_right(firsts, begin) - 1), len(self.blocks)):
            if firsts[k] >= end:
                break
            parts.append(self.block(k)[max(0, begin - firsts[k]) : end - firsts[k]])
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """Id, first id's number, number of ids and their CRC-32, a block in memory at a time."""
        blocks = (self.block(k) for k in range(len(self.blocks)))
        rest, start = np.empty(0, np.uint32), 0
        for doc, n in self.docs:
            crc, need = 0, n
            while need:
                if not len(rest):
                    rest = next(blocks)
                take = rest[:need]
                crc = zlib.crc32(take.astype("<u4").tobytes(), crc)
                rest, need = rest[len(take) :], need - len(take)
            yield doc, start, n, crc
            start += n


def _scratch(path: str) -> Iterator[np.ndarray]:
    """The pieces of ids in a scratch file."""
    system, where = fs.FileSystem.from_uri(path)
    unpacker = zstandard.ZstdDecompressor()
    with system.open_input_stream(where, compression=None) as f:
        while head := f.read(8):
            packed, width = struct.unpack("<II", head)
            yield np.frombuffer(unpacker.decompress(f.read(packed)), f"<u{width}").astype(np.uint32)


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files in ascending order of ids; returns path, number of ids before it and number of ids of each file, a partition each."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"))
    # By the whole order, so that rows without an id, or of one id, are cut into ranges like any others.
    ordered = rows.repartitionByRange("doc_id", "t").sortWithinPartitions("doc_id", "t").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer)
        context = TaskContext.get()
        system, root = fs.FileSystem.from_uri(f"{folder}/scratch")
        system.create_dir(root, recursive=True)
        name = f"{folder}/scratch/{context.partitionId():06d}-{context.taskAttemptId()}"
        packer = zstandard.ZstdCompressor(level=1)
        totals, index = np.zeros(0, np.int64), []
        with system.open_output_stream(fs.FileSystem.from_uri(name)[1], compression=None) as out:
            for batch in balanced(batches, "text"):
                ids, counts = encoder.encode(batch.column("text"))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                index += zip(batch.column("doc_id").to_pylist(), (counts + 1).tolist(), strict=True)
                found = np.bincount(ids)
                totals = np.pad(totals, (0, max(0, len(found) - len(totals))))
                totals[: len(found)] += found
                width = 2 if ids.max() < 1 << 16 else 4
                packed = packer.compress(ids.astype(f"<u{width}").tobytes())
                out.write(struct.pack("<II", len(packed), width) + packed)
        if not index:
            return
        with system.open_output_stream(fs.FileSystem.from_uri(name + ".docs")[1], compression=None) as out:
            out.write(zlib.compress(json.dumps(index).encode()))
        ids = np.flatnonzero(totals)
        n = len(ids)
        yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()] * (n + 1), pa.int64()), pa.array([name] + [None] * n, pa.string()), pa.array([-1, *ids.tolist()], pa.int64()), pa.array([int(totals.sum()), *totals[ids].tolist()], pa.int64())], ["part", "path", "id", "n"])

    parts = materialise(ordered.mapInArrow(encode, "part long, path string, id long, n long"), "ranges")
    # Bounded by the vocabulary, and by the number of files.
    table = Table.of({r.id: r.n for r in parts.where("id >= 0").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator()})
    table.write(f"{folder}/table")
    ranges = sorted((r.part, r.path, r.n) for r in parts.where("id = -1").select("part", "path", "n").toLocalIterator())

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Table.read(f"{folder}/table")
        for batch in batches:
            for part, scratch in zip(batch.column("part").to_pylist(), batch.column("path").to_pylist(), strict=True):
                system, where = fs.FileSystem.from_uri(scratch + ".docs")
                with system.open_input_stream(where, compression=None) as f:
                    index = json.loads(zlib.decompress(f.read()))
                path = f"{folder}/ids-{part:06d}-{TaskContext.get().taskAttemptId()}"
                write_file(path, index, _scratch(scratch), shared)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([path])], ["part", "path"])

    todo = each_alone(spark, [(part, path) for part, path, _ in ranges], "part long, path string")
    coded = materialise(todo.mapInArrow(code, "part long, path string"), "files")
    if ranges:
        remove(spark, f"{folder}/scratch")
    names = {r.part: r.path for r in coded.toLocalIterator()}
    files, base = [], 0
    for part, _, n in ranges:
        files.append((names[part], base, n))
        base += n
    return each_alone(spark, files, "path string, base long, n long")


def read_store(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table.read(f"{folder}/table")
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                rows = []
                for doc, start, n, crc in StoreFile(path, table).documents():
                    rows.append((doc, base + start, n, crc))
                    if len(rows) == 8192:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    return files.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def store_round_trip(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the store in the shared folder and read it back."""
    folder = new_path(docs.sparkSession, "store")
    return read_store(docs.sparkSession, write_store(docs, folder, tokenizer, end_id, id_col, text_col), folder)
