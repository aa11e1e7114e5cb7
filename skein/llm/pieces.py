"""Text columns to token ids at Arrow speed.

A text is cut where byte-level pre-tokenisation cannot see across the cut: in front of a single space and around a
single newline that stand between non-space characters. The pieces of a batch are dictionary-encoded, so that Python
handles each distinct piece of a batch once and, through a bounded cache, each distinct pre-token of a worker once.
Texts with other white space take a plain route with the same result, long ones part by part: they are cut in front of a
single space between letters, digits or signs, wherever else odd white space stands. Texts with a special token's string go
to the library whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from weakref import WeakSet

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Unicode's White_Space but for space and newline, and the separators that some regex engines add to it.
_ODD_SPACE = r"\t\x0b\x0c\r\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_NOT_PLAIN = rf"^[ \n]|[ \n][ \n]|[ \n]$|[{_ODD_SPACE}]"
#: Bytes of text handled at once, a cache's most entries, and characters after which a text with odd white space is cut.
BATCH_BYTES, CACHE_ENTRIES, PART = 4 << 20, 100_000, 1 << 16
#: Words with a space in front that are remembered, in arrays of some thirty bytes a word.
SPACED_ENTRIES = 400_000
#: A pre-token begins at such a space, whatever stands around it.
_SAFE = regex.compile(r"(?<=[\p{L}\p{N}!-~]) (?=[\p{L}\p{N}!-~])")


def parts_of(text: str) -> Iterator[str]:
    """A text in parts of PART characters or more, cut where pre-tokens begin."""
    begin = 0
    while len(text) - begin > PART and (m := _SAFE.search(text, begin + PART)):
        yield text[begin : m.start()]
        begin = m.start()
    yield text[begin:]


#: The encoders of this process.
_encoders: WeakSet[PieceEncoder] = WeakSet()


def release() -> None:
    """Forget what this process's encoders remember: for operators whose worker may have encoded texts before."""
    for encoder in _encoders:
        encoder.words.clear()
        encoder.pieces.clear()
        encoder.spaced = None
        encoder.forget()


class PieceEncoder:
    """Encodes texts as encode_words(pre-tokens) would, pre-token by pre-token.

    pattern splits text into pre-tokens. specials are strings that encode_text, and it alone, may treat as one token:
    a text that holds one goes to encode_text whole. Ids are kept as the bytes of unsigned 32-bit integers, which is what
    encode_words returns. encode_spaced, if there is one, gives the ids of pieces with a space in front of each, all in a row,
    and how many each has, or None where it cannot tell them apart.
    """

    def __init__(self, pattern: str, encode_words: Callable[[list[str]], list[bytes]], specials: tuple[str, ...] = (), encode_text: Callable[[str], list[int]] | None = None, forget: Callable[[], None] = lambda: None, encode_spaced: Callable[[list[str]], tuple[np.ndarray, np.ndarray] | None] | None = None):
        self.find = regex.compile(pattern).findall
        self.encode_words, self.specials, self.encode_text = encode_words, specials, encode_text
        self.forget, self.encode_spaced = forget, encode_spaced
        self.spaced: tuple[pa.Array, np.ndarray, np.ndarray] | None = None
        _encoders.add(self)
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.not_plain = _NOT_PLAIN + "".join("|" + regex.escape(s, special_only=True) for s in specials)
        self.newline = len(self._of_words([["\n"]])[0]) // 4

    def _split(self, piece: str) -> list[str]:
        """Pre-tokens of a piece with what stands in front of it; the usual forms need no pattern."""
        if piece.isalpha():
            return [" " + piece]
        if piece[:-1].isalpha() and piece[-1] in ".,;:!?":
            return [" " + piece[:-1], piece[-1]]
        return self.find(piece if piece[0] == "\n" else " " + piece)

    def _of_words(self, lists: list[list[str]]) -> list[bytes]:
        """Ids of each list of pre-tokens."""
        known = self.words
        if len(known) > CACHE_ENTRIES:
            known.clear()
        new = list({w for words in lists for w in words if w not in known})
        if new:
            known.update(zip(new, self.encode_words(new), strict=True))
        return [known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words]) for words in lists]

    def _of_pieces(self, pieces: list[str]) -> list[bytes]:
        known = self.pieces
        if len(known) > CACHE_ENTRIES:
            known.clear()
        new = [p for p in pieces if p not in known]
        if new:
            known.update(zip(new, self._of_words([self._split(p) for p in new]), strict=True))
        return [known[p] for p in pieces]

    def _known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of different words with a space in front, among others; how many each has and where they begin. Only new ones go to the library."""
        if self.spaced is None:
            self.spaced = words.slice(0, 0), np.empty(0, np.uint32), np.empty(0, np.int64)
        known, flat, counts = self.spaced
        at = pc.index_in(words, value_set=known)
        fresh = at.is_null()
        new = words.filter(fresh)
        if (got := self.encode_spaced(new.to_pylist())) is None:
            return None
        flat, counts = np.concatenate([flat, got[0]]), np.concatenate([counts, got[1]])
        place = np.empty(len(words), np.int64)
        fresh = fresh.to_numpy(zero_copy_only=False)
        place[~fresh] = at.drop_null().to_numpy()
        place[fresh] = len(known) + np.arange(len(new))
        first = np.cumsum(counts) - counts
        # Too many are forgotten all at once.
        self.spaced = (pa.concat_arrays([known, new]), flat, counts) if len(counts) <= SPACED_ENTRIES else None
        return flat, counts[place], first[place]

    def _spaced(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pieces with a space in front of each, all in a row, and how many each has. Signs behind words are set apart first,
        so that the library sees a word once."""
        signed = pc.match_substring_regex(pieces, r"^\p{L}+[.,;:!?]$")
        words = pc.if_else(signed, pc.utf8_slice_codeunits(pieces, 0, -1), pieces).dictionary_encode()
        if (got := self._known(words.dictionary)) is None:
            return None
        flat, counts, first = got
        index, signed = words.indices.to_numpy(zero_copy_only=False), signed.to_numpy(zero_copy_only=False)
        n, begins = counts[index], first[index]
        ends = np.cumsum(n + signed)  # of the pieces in the result
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out = np.empty(ends[-1] if len(ends) else 0, np.uint32)
        out[np.repeat(ends - n - signed, n) + at] = flat[np.repeat(begins, n) + at]
        sign = pc.utf8_slice_codeunits(pieces.filter(pa.array(signed)), -1).dictionary_encode()
        ids = self._of_words([[s] for s in sign.dictionary.to_pylist()])
        if any(len(x) != 4 for x in ids):
            return None
        out[ends[signed] - 1] = np.frombuffer(b"".join(ids), np.uint32)[sign.indices.to_numpy(zero_copy_only=False)]
        return out, n + signed

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different pieces in some order, how many each has and where they begin."""
        sizes, starts = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        rest, flat = np.arange(len(pieces)), np.empty(0, np.uint32)
        if self.encode_spaced:
            led = pc.starts_with(pieces, "\n").to_numpy(zero_copy_only=False)
            own = np.flatnonzero(~led)
            if (got := self._spaced(pieces.take(pa.array(own)))) is not None:
                flat, sizes[own] = got
                starts[own] = np.cumsum(sizes[own]) - sizes[own]
                rest = np.flatnonzero(led)
        ids = self._of_pieces(pieces.take(pa.array(rest)).to_pylist())
        sizes[rest] = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts[rest] = len(flat) + np.cumsum(sizes[rest]) - sizes[rest]
        return np.concatenate([flat, np.frombuffer(b"".join(ids), np.uint32)]), sizes, starts

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of texts without odd white space. Each gets a newline in front, whose tokens are dropped."""
        marked = pc.binary_join_element_wise(pa.scalar("\n", texts.type), pc.replace_substring(texts, "\n", " \n"), pa.scalar("", texts.type))
        lists = pc.split_pattern(marked, " ")
        coded = lists.flatten().dictionary_encode()
        flat, sizes, starts = self._distinct(coded.dictionary)
        index = coded.indices.to_numpy(zero_copy_only=False)
        bounds = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = bounds - bounds[0]
        n = sizes[index]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(starts[index] - ends + n, n)
        counts = np.diff(np.concatenate([[0], ends[bounds[1:] - 1]]))
        keep = np.ones(len(at), bool)
        first = np.cumsum(counts) - counts
        for k in range(self.newline):
            keep[first + k] = False
        return flat[at[keep]], counts - self.newline

    def _odd(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, by the pattern, some parts at once."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[list[str]] = []
        owners: list[int] = []
        size = 0
        for k, t in enumerate(texts):
            for part in parts_of(t):
                held.append(self.find(part))
                owners.append(k)
                size += len(part)
                if size >= 8 * PART:
                    for owner, ids in zip(owners, self._of_words(held), strict=True):
                        out[owner].append(ids)
                    held, owners, size = [], [], 0
        for owner, ids in zip(owners, self._of_words(held), strict=True):
            out[owner].append(ids)
        return [b"".join(x) for x in out]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has. Null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        plain = pc.and_(pc.invert(pc.match_substring_regex(texts, self.not_plain)), pc.greater(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)
        counts = np.zeros(len(texts), np.int64)
        some = np.empty(0, np.uint32)
        if plain.any():
            some, counts[plain] = self._plain(texts.filter(pa.array(plain)))
        if plain.all():
            return some, counts
        rest = np.flatnonzero(~plain)
        others = texts.take(pa.array(rest)).to_pylist()
        whole = [any(s in t for s in self.specials) for t in others]
        odd = iter(self._odd([t for t, w in zip(others, whole, strict=True) if not w]))
        got = [np.array(self.encode_text(t), np.uint32) if w else np.frombuffer(next(odd), np.uint32) for t, w in zip(others, whole, strict=True)]
        counts[rest] = [len(x) for x in got]
        out = np.empty(counts.sum(), np.uint32)
        mine = np.zeros(len(out), bool)
        ends = np.cumsum(counts)
        for i, x in zip(rest, got, strict=True):
            out[ends[i] - counts[i] : ends[i]] = x
            mine[ends[i] - counts[i] : ends[i]] = True
        out[~mine] = some
        return out, counts


def balanced(batches: Iterable[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in the same order, in batches of at most about `most` bytes of text, however uneven the texts are."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)] if len(sizes) else []
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
