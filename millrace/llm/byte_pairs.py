"""Byte-level BPE by tree reduction: halves are encoded apart and joined at their boundary."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.vocabulary import RANKS, encoding, ranks
from millrace.llm.work import texts_of
from millrace.session import ready

#: Characters of a text, and bytes of one match of the pattern, that are encoded as a leaf.
LEAF, LEAF_BYTES = 2048, 512
#: Characters and tokens on each side of a join that are encoded anew at first.
WINDOW, WINDOW_TOKENS = 48, 4

_GAP = regex.compile(r"(?<=\S)[ \n\r\t]")
_PATTERN = regex.compile(public_tokenizers.PATTERN)


class Codec:
    """Encodes and decodes as a monoid: the code of a text is the reduction of the codes of its parts.

    *Joins of texts.*  No match of the pattern holds a character and the white
    space after it, so a match starts at each space, tab or line end that follows a
    non-space, whatever stands elsewhere.  A join encodes anew from the last such place left
    of the seam to the first right of it; the window doubles until it has both.
    The pattern never looks back, so tokens outside are those of the whole.

    *Joins inside one match.*  A sequence of tokens is the code of its bytes exactly
    when each two neighbours are the code of their own bytes.  A join encodes a few
    tokens on each side anew and doubles them until both seams of the window
    pass that test; the tokens outside were neighbours before, so they stay.
    """

    def __init__(self, name: str = RANKS, leaf: int = LEAF, leaf_bytes: int = LEAF_BYTES):
        self.encoding, self.leaf, self.leaf_bytes = encoding(name), leaf, leaf_bytes
        self.bytes: list[bytes] = [b""] * (1 + max(ranks(name).values()))
        for token, rank in ranks(name).items():
            self.bytes[rank] = token
        self.names = [str(k) for k in range(len(self.bytes))]
        self.stable = lru_cache(maxsize=1 << 16)(self._stable)

    # -- encode

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.encoding.encode_ordinary(text)
        half = len(text) // 2
        left, right = self.encode(text[:half]), self.encode(text[half:])
        width = WINDOW
        while True:
            before, after = text[max(0, half - width) : half], text[half : half + width]
            low = [m.start() for m in _GAP.finditer(before)]
            high = _GAP.search(after)
            a = half - len(before) + low[-1] if low else 0
            b = half + high.start() if high else len(text)
            if (low or width >= half) and (high or width >= len(text) - half):
                break
            width *= 2
        keep = self._cut(left, len(text[a:half].encode()), last=True)
        drop = self._cut(right, len(text[half:b].encode()))
        return left[:keep] + self._window(text[a:b]) + right[drop:]

    def _cut(self, tokens: list[int], size: int, last: bool = False) -> int:
        """Where the first, or the last, ``size`` bytes of ``tokens`` end, or start."""
        k = len(tokens) if last else 0
        while size > 0:
            k -= last
            size -= len(self.bytes[tokens[k]])
            k += not last
        if size:
            raise AssertionError("a window does not start at a token")
        return k

    def _window(self, text: str) -> list[int]:
        if len(text) <= 2 * self.leaf:
            return self.encoding.encode_ordinary(text)
        return [token for m in _PATTERN.finditer(text) for token in self._match(m[0].encode())]

    def _match(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf_bytes:
            return self.encoding._encode_single_piece(piece)
        half = len(piece) // 2
        left, right = self._match(piece[:half]), self._match(piece[half:])
        n = WINDOW_TOKENS
        while True:
            a, b = max(0, len(left) - n), min(n, len(right))
            inner = self.encoding._encode_single_piece(self.decode(left[a:] + right[:b]))
            if (not a or self.stable(left[a - 1], inner[0])) and (b == len(right) or self.stable(inner[-1], right[b])):
                return left[:a] + inner + right[b:]
            n *= 2

    def _stable(self, a: int, b: int) -> bool:
        return self.encoding._encode_single_piece(self.bytes[a] + self.bytes[b]) == [a, b]

    # -- decode

    def decode(self, tokens: list[int]) -> bytes:
        if len(tokens) <= self.leaf:
            return b"".join(map(self.bytes.__getitem__, tokens))
        half = len(tokens) // 2
        return self.decode(tokens[:half]) + self.decode(tokens[half:])

    def spelled(self, tokens: list[int]) -> str:
        return " ".join(map(self.names.__getitem__, tokens))


@lru_cache(maxsize=2)
def codec(name: str = RANKS) -> Codec:
    return Codec(name)


def _digests(name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in texts_of(batch, "text"):
                tokens = own.encode(text.decode("utf-8", "replace"))
                counts.append(len(tokens))
                ids.append(hashlib.sha256(own.spelled(tokens).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(tokens)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = RANKS) -> DataFrame:
    """(doc_id, ids) for every row of ``docs``, without a shuffle.

    Null and empty texts have no ids.  A very long text is encoded by halves.  Null ids and repeated rows are
    encoded like any other; an empty table gives an empty result; other columns are ignored.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            ids = [own.encode(t.decode("utf-8", "replace")) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str = RANKS) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    ready(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            texts = [own.decode(ids or []).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs``, without a shuffle.

    Null text counts as empty: no tokens.  Null ids and repeated rows are reported like
    any other.  An empty table gives an empty result.  Other columns are ignored.
    """
    ready(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_digests(vocabulary), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
