"""Byte-level byte-pair encoding and decoding by longest matches and backtracking.

Every byte becomes the Latin-1 character of its value, so that an Aho-Corasick automaton over characters finds the
tokens of a rank file. A pre-token is encoded from left to right: take the longest token that starts at the position and
may stand behind the token before it; where none may, go back and shorten the token before. Whether two tokens may stand
side by side, that is whether merging their joined bytes by rank gives just the two, is decided once and memoised; each
position is left at most once for good, so the time is linear in the length. The result is exactly that of the merges.

Nulls count as empty texts (no tokens; the digests of no bytes). Repeated rows are encoded each on its own; an empty
table gives an empty result; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.pieces import PieceEncoder, balanced

#: Pairs of tokens remembered by a worker, and bytes of text that it handles at once.
MEMO_PAIRS, BATCH_BYTES = 1 << 17, 2 << 20


class BytePairs:
    """The tokens of a rank file: encode(pre-token) gives ids, decode(ids) gives bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the rank file has no token for the bytes {missing[:5]}")
        self.rank = {token.decode("latin-1"): r for token, r in ranks.items()}
        self.token = {r: t for t, r in self.rank.items()}
        self.size = {r: len(t) for t, r in self.rank.items()}
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, r in self.rank.items():
            self.automaton.add_word(token, r)
        self.automaton.make_automaton()
        self.pair = lru_cache(MEMO_PAIRS)(self._pair)
        self.parts = {r: self._parts(t) for t, r in self.rank.items()}
        self.shorter = {r: self._shorter(t) for t, r in self.rank.items()}

    def _shorter(self, token: str) -> int | None:
        """The longest token that is a proper prefix of a token."""
        return next((self.rank[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in self.rank), None)

    def _parts(self, token: str) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token; none for a byte."""
        parts, own = list(token), self.rank[token]
        while len(parts) > 2:
            least, at = min((self.rank.get(x + y, own), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
            if least >= own:
                raise ValueError(f"no merges make the token {own}")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None

    def _pair(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens leaves just the two.

        The merges that made the two are undone from the last to the first. It fails if what then meets at the joint
        would have been merged before the merge just undone; of merges of one rank the left one comes first.
        """
        name, parts = self.token, self.parts
        before = float("inf")
        while True:
            if self.rank.get(name[left] + name[right], before) < before:
                return False
            a, b = parts[left], parts[right]
            if a and (left > right or not b):
                before, left = left, a[1]
            elif b:
                before, right = right + 1, b[0]
            else:
                return True

    def encode(self, data: bytes) -> list[int]:
        text = data.decode("latin-1")
        if not text or (whole := self.rank.get(text)) is not None:
            return [whole] if text else []
        size, pair, shorter = self.size, self.pair, self.shorter
        longest: list[int] = [0] * len(text)  # token from each position, found in order of its end
        for end, token in self.automaton.iter(text):
            start = end + 1 - size[token]
            if not (before := longest[start]) or size[before - 1] < size[token]:
                longest[start] = token + 1
        alive = bytearray(b"\1") * (len(text) + 1)  # positions from which the rest may still be encoded
        out: list[int] = []
        at, token = 0, longest[0] - 1
        while at < len(text):
            while not (alive[at + size[token]] and (not out or pair(out[-1], token))):
                if (token := shorter[token]) is None:
                    break
            if token is None:  # nothing fits here: shorten the token before
                alive[at] = 0
                token = out.pop()
                at -= size[token]
            else:
                out.append(token)
                at += size[token]
                token = longest[at] - 1 if at < len(text) else None
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=2)
def pair_encoder(path: str, pattern: str) -> tuple[PieceEncoder, BytePairs, dict[int, str]]:
    """The encoder of a rank file. One for each worker process."""
    pairs = BytePairs(read_ranks(path))
    words = lambda new: [array("I", pairs.encode(w.encode())).tobytes() for w in new]
    split = regex.compile(pattern).findall

    def spaced(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, counts = array("I"), []
        for piece in pieces:
            before = len(flat)
            for word in [" " + piece] if piece.isalpha() else split(" " + piece):
                flat.extend(pairs.encode(word.encode()))
            counts.append(len(flat) - before)
        return np.frombuffer(flat, np.uint32) if flat else np.empty(0, np.uint32), np.array(counts, np.int64)

    return PieceEncoder(pattern, words, forget=pairs.pair.cache_clear, encode_spaced=spaced), pairs, {r: str(r) for r in pairs.token}


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text, decode the ids: doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256."""

    def digests(batches):
        encoder, pairs, decimal = pair_encoder(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in balanced(batches, "text", BATCH_BYTES):
            ids, counts = encoder.encode(batch.column("text"))
            ends = np.cumsum(counts)
            coded, decoded = [], []
            for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
                own = ids[end - n : end].tolist()
                coded.append(sha(" ".join(map(decimal.__getitem__, own)).encode()))
                decoded.append(sha(pairs.decode(own)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_ids(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids themselves: doc_id, ids (array of int)."""

    def encode(batches):
        encoder, _, _ = pair_encoder(path, pattern)
        for batch in balanced(batches, "text", BATCH_BYTES):
            ids, counts = encoder.encode(batch.column("text"))
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, "doc_id long, ids array<int>")
