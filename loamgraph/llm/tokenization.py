"""Problem 6: the whole corpus as token ids of a public tokenizer, and back."""

from __future__ import annotations

import functools
import os
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm.batches import portions

DEFAULT_FOLDER = "/opt/tokenizers"
DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: The byte-level pre-tokenizer's pattern; a test holds it against the tokenizer file for every code point.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered by a worker before it starts anew; bounds its memory, not the result.
REMEMBERED = 400_000


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


@functools.cache
def _pieces():
    import regex

    return regex.compile(PATTERN).findall


def byte_table() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, as character -> byte.

    Bytes that print stand for themselves; the others take the code points from 256 on, in order."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(printing)]
    return {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PieceEncoder:
    """Encodes texts piece by piece with the tokenizers library and remembers the ids of each piece.

    A byte-level BPE never merges over the border of two pieces, so the ids of a text are those of its pieces. Where a
    text has characters that this Python does not know, on whose class two libraries may differ, the tokenizer also
    does the splitting."""

    def __init__(self, path: str):
        self.tokenizer, self.split, self.known = _tokenizer(path), _pieces(), {}
        self.settled: set[str] = set()

    def _doubtful(self, text: str) -> bool:
        if text.isascii() or self.settled.issuperset(text):
            return False
        new = set(text) - self.settled
        self.settled |= {c for c in new if unicodedata.category(c) != "Cn"}
        return not self.settled.issuperset(new)

    def _learn(self, new: list[str]) -> None:
        for piece, encoding in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.known[piece] = np.array(encoding.ids, dtype=np.int32).tobytes()

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, chunks, ends = self.known, [], [0]
        for text in texts:
            if text and self._doubtful(text):
                chunks.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.int32).tobytes())
                ends.append(ends[-1] + len(chunks[-1]) // 4)
            elif text:
                pieces = self.split(text)
                try:
                    chunks.append(b"".join([known[p] for p in pieces]))
                except KeyError:
                    self._learn(list({p for p in pieces if p not in known}))
                    chunks.append(b"".join([known[p] for p in pieces]))
                ends.append(ends[-1] + len(chunks[-1]) // 4)
            else:
                ends.append(ends[-1])
        return np.frombuffer(b"".join(chunks), dtype=np.int32), np.array(ends)


def _list_array(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def shipped(spark: SparkSession, path: str) -> Callable[[], str]:
    """Send a vocabulary file to every executor; there, the result tells where it lies."""
    spark.sparkContext.addFile(path)

    def where() -> str:
        there = SparkFiles.get(os.path.basename(path))
        return there if os.path.exists(there) else path

    return where


def encode(texts: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str = f"{DEFAULT_FOLDER}/{DEFAULT_TOKENIZER}") -> DataFrame:
    """(key, ids): each text's token ids without special tokens, over Arrow batches and without a shuffle.

    Null and empty texts have the empty list; the strings of special tokens are ordinary text. Texts of any length are
    encoded whole. Repeated keys give repeated rows. Other columns are not read. ``tokenizer`` is a byte-level
    vocabulary file of the tokenizers library; it is sent to every executor.
    """
    kind, where = texts.schema[key].dataType.simpleString(), shipped(texts.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(where())
        for batch in portions(batches):
            ids, ends = encoder(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), _list_array(ids, ends)], names=[key, "ids"])

    return texts.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def encode_with_offsets(texts: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str = f"{DEFAULT_FOLDER}/{DEFAULT_TOKENIZER}") -> DataFrame:
    """(key, ids, starts, ends): also the character positions [start, end) that each token covers.

    Lengths are known in bytes; bytes are mapped to the character they belong to. Tokens that split a character all
    name that whole character."""
    kind, where = texts.schema[key].dataType.simpleString(), shipped(texts.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(where())
        width = np.array([len(encoder.tokenizer.id_to_token(i) or "") for i in range(encoder.tokenizer.get_vocab_size())])
        for batch in portions(batches):
            rows = batch.column(1).to_pylist()
            ids, ends = encoder(rows)
            starts_at, ends_at = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int32)
            for row, a, b in zip(rows, ends[:-1], ends[1:], strict=True):
                if a == b:
                    continue
                raw = np.frombuffer(row.encode(), dtype=np.uint8)
                character = np.cumsum((raw & 0xC0) != 0x80) - 1
                byte_end = np.cumsum(width[ids[a:b]])
                starts_at[a:b] = character[byte_end - width[ids[a:b]]]
                ends_at[a:b] = character[byte_end - 1] + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), *(_list_array(x, ends) for x in (ids, starts_at, ends_at))], names=[key, "ids", "starts", "ends"])

    return texts.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, *, key: str = "doc_id", ids: str = "ids", tokenizer: str = f"{DEFAULT_FOLDER}/{DEFAULT_TOKENIZER}") -> DataFrame:
    """(key, text): the text of each list of ids; null lists and null ids give the empty text and nothing.

    The byte table is reversed and the bytes of all tokens are joined before they are read as UTF-8, so characters
    split over tokens come out whole; bytes that are no character (a list cut inside one) become U+FFFD. An id outside
    the vocabulary is an error.
    """
    kind, where = encoded.schema[key].dataType.simpleString(), shipped(encoded.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, vocabulary = byte_table(), _tokenizer(where())
        raw = [bytes(table[c] for c in token) if all(c in table for c in token) else token.encode() for token in (vocabulary.id_to_token(i) or "" for i in range(vocabulary.get_vocab_size()))]
        for batch in portions(batches):
            out = [b"".join(raw[i] for i in row or [] if i is not None).decode("utf-8", "replace") for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, "text"])

    return encoded.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {kind}, text string")
