"""Best-fit packing of tokenised documents (operator 5).

1. ``pieces``: documents are tokenised in Arrow batches and cut into pieces; one small row per piece. A batch's words are
   split and numbered as arrays, each distinct word is encoded once, and the ids are gathered by number.
2. ``pack``: bounded-space online best-fit. The pieces are dealt by hash to tasks of about ``PER_TASK`` pieces; each
   task streams its pieces, largest first, through at most ``OPEN_BINS`` open bins. A bin is two numbers, so memory is
   fixed. The bins' free spaces are marked in a bitset, whose lowest set bit at or above a piece's length is the
   best fit; when all bins are open and none fits, the fullest closes.
"""

from __future__ import annotations

import string
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladder.llm.common import GAP_CHARS, Scratch, ship
from ladder.llm.words import LOWER, Words, byte_table, groups, joined, mapped, ragged

LENGTH = 4096
OPEN_BINS = 16384
PER_TASK = 65536
END_ID = 1
#: Most strings a Python worker remembers the ids of.
REMEMBERED = 400_000
#: Gaps, stops, and what a stop may end.
KINDS = byte_table(GAP_CHARS, ".,;:!?", string.ascii_letters + string.digits)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids of texts.

    The vocabulary drops white space before it merges, so the ids of a text are those of its white-space separated
    strings one after another. A stop that ends a string after a letter or digit is a word of its own, and case is
    dropped. So each distinct string, lower-cased and without its stop, is encoded once and remembered; strings not seen
    yet are encoded together.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.known: dict[bytes, bytes] = {}
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        self.ends_word[ends] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, strings: list[bytes]) -> dict[bytes, bytes]:
        """Ids of strings not seen yet."""
        new: dict[bytes, bytes] = {}
        for at in range(0, len(strings), 8192):
            part = strings[at:at + 8192]
            words = [s for s in part if s.decode().isalpha()]  # a run of letters is one word of the vocabulary
            ids = self._ids(b" ".join(words).decode())
            cut = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
            if len(cut) == len(words):
                flat = ids.tobytes()
                new.update((w, flat[4 * a:4 * b]) for w, a, b in zip(words, [0, *cut], cut, strict=False))
            new.update(self._by_place([s for s in part if s not in new]))  # not each was one word: by the places of tokens
        return new

    def _by_place(self, strings: list[bytes]) -> dict[bytes, bytes]:
        part = [s.decode() for s in strings]
        got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
        ids = np.array(got.ids, dtype="<u4")
        starts = np.cumsum([0] + [len(s) + 1 for s in part])
        cut = np.searchsorted([o[0] for o in got.offsets], starts)
        return {s: ids[a:b].tobytes() for s, a, b in zip(strings, cut[:-1], cut[1:], strict=True)}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's begin and the last's end)."""
        data, at = joined(texts)
        if b"<|" not in data.tobytes():  # special tokens are told by their case
            data = mapped(data, LOWER)
        kind = mapped(data, KINDS)
        gap, stops = kind == 1, kind == 2
        stops[:1] = False
        stops[1:] &= kind[:-1] == 3
        last = np.append(gap[1:], True)[:len(data)]
        last[at[1:][at[1:] > 0] - 1] = True
        words = Words(data, at, gap, stops & last)
        spellings = words.spellings.to_pylist()
        ids = list(map(self.known.get, spellings))
        fresh = [s for s, x in zip(spellings, ids, strict=True) if x is None]
        if fresh:
            new = self._learn(fresh)
            ids = [new[s] if x is None else x for s, x in zip(spellings, ids, strict=True)]
            if len(self.known) + len(new) <= REMEMBERED:
                self.known.update(new)
            else:  # what this batch had is likely to come again
                self.known = dict(zip(spellings, ids, strict=True)) if len(ids) <= REMEMBERED else {}
        size = np.array([len(x) for x in ids], dtype=np.int64) // 4
        begin = np.cumsum(size) - size
        flat, of = np.frombuffer(b"".join(ids), dtype="<u4"), size[words.codes]
        return flat[ragged(begin[words.codes], of)], np.append(0, np.cumsum(of))[words.first]


@lru_cache(maxsize=2)
def word_ids(vocabulary: str) -> WordIds:
    return WordIds(vocabulary)


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
           vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row: its token ids, then ``END_ID``, cut every
    ``length`` ids. A null text is empty (one piece, the end id). ``ids``: little-endian unsigned 32-bit, binary."""
    ship(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches):
        encode = word_ids(vocabulary).encode
        for b in batches:
            row, out = [], []
            for first, texts in groups(b.column(1), 1 << 22):
                all_ids, bounds = encode(texts)
                for i in range(len(texts)):
                    ids = all_ids[bounds[i]:bounds[i + 1]].tobytes() + end
                    for at in range(0, len(ids), 4 * length):
                        part = ids[at:at + 4 * length]
                        row.append(first + i)
                        out.append((at // (4 * length), at // 4, len(part) // 4, zlib.crc32(part), part * with_ids))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            arrays = [b.column(0).take(pa.array(row, pa.int64())), pa.array(cols[0], pa.int32()),
                      *[pa.array(c, pa.int64()) for c in cols[1:4]]]
            if with_ids:
                arrays.append(pa.array(cols[4], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
                           + ", ids binary" * with_ids)


class BestFit:
    """Open bins by free space. ``free`` is a bitset: bit f is set when some open bin has f free places."""

    def __init__(self, length: int = LENGTH, open_bins: int = OPEN_BINS):
        self.length, self.most, self.open, self.made, self.free = length, open_bins, 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, size: int) -> tuple[int, int]:
        """The bin that a piece of ``size`` goes to and its place there."""
        fits = self.free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            space, number = self.length, self.made
            self.made += 1
        left = space - size
        if left:
            self.bins[left].append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.length - space

    def _take(self, space: int) -> int:
        found = self.bins[space]
        number = found.pop()
        if not found:
            self.free &= ~(1 << space)
        self.open -= 1
        return number


def pack(items: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, per_task: int = PER_TASK) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows that have ``length`` (1 to ``length``).

    ``items`` must be cheap to read twice (a written table): it is counted to choose the number of tasks. Rows go to
    tasks and into order by a hash of their columns, so a lost task is redone alike. Equal rows are interchangeable.
    """
    ship(items.sparkSession)
    tasks = max(1, -(-items.count() // per_task))
    plain = [c for c in items.columns if c not in ("ids",)]
    spread = F.xxhash64(*plain)

    def run(frames):
        from pyspark import TaskContext

        first, bins = TaskContext.get().partitionId() << 40, BestFit(length, open_bins)
        for frame in frames:
            at = [bins.put(int(n)) for n in frame["length"]]
            yield frame.assign(sequence_id=pd.Series([first + b for b, _ in at], index=frame.index, dtype="int64"),
                               offset=pd.Series([o for _, o in at], index=frame.index, dtype="int64"))

    dealt = (items.withColumn("_spread", spread).repartition(tasks, "_spread")
             .sortWithinPartitions(F.col("length").desc(), "_spread").drop("_spread"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return dealt.mapInPandas(run, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                   vocabulary: str | None = None, with_ids: bool = False, open_bins: int = OPEN_BINS,
                   per_task: int = PER_TASK) -> DataFrame:
    """One row per piece of every row of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset
    (and ``ids`` if asked for). Null and repeated doc_ids are kept as they are; other columns are not read; an empty
    table gives no rows. The token ids are made once: the pieces are a table in the shared folder."""
    made = Scratch(docs.sparkSession, "packing").table(pieces(docs, doc_id, text, length, vocabulary, with_ids))
    return pack(made, length, open_bins, per_task)
