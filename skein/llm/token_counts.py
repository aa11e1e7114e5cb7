"""Token counts of texts: batch encoding in an Arrow function that returns lengths only.

Batches are balanced by bytes, long texts are cut at safe boundaries (pieces.py). What the library sees are the
distinct pre-tokens; texts with a special token's string go to it whole, so that the string is handled as its default.
Nulls count as empty texts (0 tokens). Repeated rows are counted each on its own; an empty table gives an empty result;
columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.pieces import PieceEncoder, balanced

#: How byte-level pre-tokenisers with use_regex split a text; fixed values.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of other kinds of files are encoded in calls of so many.
WHOLE_TEXTS = 64
#: Pre-tokens joined for one call.
JOINED = 4096


class WholeTexts:
    """For files whose pre-tokenisation pieces.py can't cut: every text goes to the library whole."""

    def __init__(self, encode):
        self.encode_texts = encode

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows = texts.fill_null("").to_pylist()
        got = [x for k in range(0, len(rows), WHOLE_TEXTS) for x in self.encode_texts(rows[k : k + WHOLE_TEXTS])]
        return np.concatenate([np.empty(0, np.uint32), *(np.array(x, np.uint32) for x in got)]), np.array([len(x) for x in got], np.int64)


@lru_cache(maxsize=4)
def library_encoder(path: str) -> PieceEncoder | WholeTexts:
    """The encoder of a tokenizer file: .json by tokenizers, .model by sentencepiece. One for each worker process."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return WholeTexts(lambda texts: model.encode(texts, num_threads=1))
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    ids = lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    # Ids whose token begins with a space: where one pre-token of many ends.
    begins = np.zeros(tokenizer.get_vocab_size() + 1, bool)
    begins[[i for token, i in tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True

    def words(new: list[str]) -> list[bytes]:
        """Pre-tokens that begin with a space stay apart in one long text; the others go to the library one by one."""
        joined = [w for w in new if len(w) > 1 and w[0] == " " and not w[1].isspace()]
        out: dict[str, bytes] = {}
        for k in range(0, len(joined), JOINED):
            part = joined[k : k + JOINED]
            got = np.array(ids(["".join(part)])[0], np.uint32)
            cuts = np.append(np.flatnonzero(begins[got]), len(got))
            if len(cuts) != len(part) + 1:
                raise ValueError("the tokenizer does not keep pre-tokens apart")
            data, cuts = got.tobytes(), (cuts * 4).tolist()
            out.update(zip(part, [data[a:b] for a, b in zip(cuts, cuts[1:])], strict=True))
        rest = [w for w in new if w not in out]
        out.update(zip(rest, [np.array(x, np.uint32).tobytes() for x in ids(rest)], strict=True))
        return [out[w] for w in new]

    def spaced(pieces: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Pieces without a space go to the library in long texts, a space before each; the tokens that begin with one tell them apart."""
        texts = [" " + " ".join(pieces[k : k + JOINED]) for k in range(0, len(pieces), JOINED)]
        flat = np.concatenate([np.empty(0, np.uint32), *(np.array(x, np.uint32) for x in ids(texts))])
        firsts = np.flatnonzero(begins[flat])
        return (flat, np.diff(np.append(firsts, len(flat)))) if len(firsts) == len(pieces) else None

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space"):
        return WholeTexts(ids)
    return PieceEncoder(BYTE_LEVEL, words, tuple(x["content"] for x in spec["added_tokens"]), lambda text: ids([text])[0], encode_spaced=spaced)


def token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""

    def count(batches):
        encoder = library_encoder(path)
        for batch in balanced(batches, "text"):
            texts = batch.column("text").fill_null("")
            _, counts = encoder.encode(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
