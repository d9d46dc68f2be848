"""Cutting texts into overlapping chunks of a number of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes of a chunk, and bytes it has in common with the one before.
SIZE, OVERLAP = 1800, 200
# The code points with the property White_Space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def chunks_of(text: str | None, size: int = SIZE, overlap: int = OVERLAP, most: int | None = None) -> list[str]:
    """Chunks of about ``size`` bytes, cut after the last empty line, else the last line end, else hard.

    The whole text is cut, unless ``most`` bounds the chunks. The next chunk begins ``overlap`` bytes before the cut, unless that is no progress. Cuts never split a character:
    the hard cut moves forward to the next one, the start of the overlap back.
    """
    raw = (text or "").strip(SPACES).encode()
    if not raw:
        return []
    if len(raw) <= size:
        return [raw.decode()]
    inside = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
    pieces: list[str] = []
    start = 0
    while start < len(raw) and (most is None or len(pieces) < most):
        while inside(start):
            start += 1
        end = min(start + size, len(raw))
        while inside(end):
            end += 1
        if end < len(raw):
            empty_line, line = raw.rfind(b"\n\n", start, end), raw.rfind(b"\n", start, end)
            cut = empty_line + 2 if empty_line >= 0 else line + 1 if line >= 0 else end
            end = cut if cut > start else end
        piece = raw[start:end].decode().strip(SPACES)
        if piece:
            pieces.append(piece)
        if end >= len(raw):
            break
        following = max(end - overlap, 0)
        while following > 0 and inside(following):
            following -= 1
        start = following if following > start else end
    return pieces


def chunk_documents(documents: DataFrame, key: str, text: str = "text", **sizes: int | None) -> DataFrame:
    """(key, chunk_index, content) of every document, over Arrow batches and without a shuffle."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [chunks_of(t, **sizes) for t in batch.column(1).to_pylist()]
            index = [i for i, pieces in enumerate(cut) for _ in pieces]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(index, pa.int32())), pa.array([n for pieces in cut for n in range(len(pieces))], pa.int32()), pa.array([p for pieces in cut for p in pieces], pa.string())],
                names=[key, "chunk_index", "content"],
            )

    return documents.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, chunk_index int, content string")
