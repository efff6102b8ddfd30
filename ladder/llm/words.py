"""Words of whole Arrow batches at once: numpy over the joined bytes, no Python step per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ladder.llm.common import GAP_CHARS


def byte_table(*classes: str) -> bytes:
    """A table for ``mapped``: 1 for the ASCII characters of the first class, 2 for those of the second and so on."""
    table = bytearray(256)
    for k, chars in enumerate(classes, 1):
        for c in chars.encode():
            table[c] = k
    return bytes(table)


GAPS = byte_table(GAP_CHARS)
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mapped(data: np.ndarray, table: bytes) -> np.ndarray:
    """Every byte replaced by its entry in a table of 256."""
    return np.frombuffer(data.tobytes().translate(table), dtype=np.uint8)


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes one after another, where each text begins and the last ends). Nulls are empty."""
    a = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    at = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset:a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], dtype=np.uint8) if a.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


class Words:
    """The words of some texts: ``codes`` (number of each word's spelling), ``spellings`` (Arrow binary), ``first``
    (number of each text's first word; one more for the end), ``starts`` (each word's first byte in the joined data).
    ``gap`` says which bytes belong to no word, ``cuts`` at which a word begins besides.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, gap: np.ndarray | None = None, cuts: np.ndarray | None = None):
        inner = ~(mapped(data, GAPS).astype(bool) if gap is None else gap)
        begins = inner.copy()
        begins[1:] &= ~inner[:-1]
        edges = at[(at > 0) & (at < len(data))]
        begins[edges] = inner[edges]  # a text's first byte goes on no word of the text before
        if cuts is not None:
            begins |= cuts & inner
        ends = inner.copy()
        ends[:-1] &= ~inner[1:] | begins[1:]
        self.starts = np.flatnonzero(begins)
        self.first = np.searchsorted(self.starts, at)
        # Without the gaps the words lie one after another, as in an Arrow array.
        bounds = np.append(0, np.cumsum(np.flatnonzero(ends) + 1 - self.starts))
        buffers = [None, pa.py_buffer(bounds), pa.py_buffer(data[inner])]
        words = pa.Array.from_buffers(pa.large_binary(), len(self.starts), buffers).dictionary_encode()
        self.codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.spellings = words.dictionary


def groups(texts: pa.Array, most: int = 1 << 24) -> Iterator[tuple[int, pa.Array]]:
    """(number of the first, texts) of runs of texts of about ``most`` bytes, at least one text each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first, before = 0, 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(size, before + most, side="right")))
        yield first, texts.slice(first, end - first)
        before, first = int(size[end - 1]), end


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (lengths[0] numbers), then starts[1] and so on."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
