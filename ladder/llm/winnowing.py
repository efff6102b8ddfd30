"""Document fingerprints by winnowing (operator 6).

Every k-gram of code points has a rolling polynomial hash; of each window of ``window`` consecutive hashes the
smallest is chosen, the rightmost of equal ones, and kept with its position. Any run of ``window + k - 1`` code points
that two texts share gives both the same chosen hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ladder.llm.common import Scratch, ship

K = 16
WINDOW = 32
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """32-bit hashes of all k-grams. A text shorter than k has one: of the whole text (an empty one none)."""
    n = len(points)
    if not n:
        return np.empty(0, dtype=np.uint64)
    k = min(k, n)
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _powers(BASE, n))]
        h = (sums[k:] - sums[:-k]) * _powers(_INVERSE, n - k + 1)  # the same k-gram hashes alike anywhere
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        return h >> np.uint64(32)


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) chosen, by position."""
    h = gram_hashes(code_points(text), k)
    n = len(h)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    low = np.uint64(0xFFFFFFFF)
    key = (h << np.uint64(32)) | (low - np.arange(n, dtype=np.uint64))  # smaller hash first, then the rightmost
    width = min(window, n)
    least, covered = key, 1
    while covered < width:  # minima of twice as wide windows from two of half the width
        step = min(covered, width - covered)
        least = np.minimum(least[:-step], least[step:])
        covered += step
    chosen = least[np.r_[True, least[1:] != least[:-1]]]
    return (low - (chosen & low)).astype(np.int64), chosen >> np.uint64(32)


def digest_of(positions: np.ndarray, hashes: np.ndarray) -> str:
    """A string that stands for a fingerprint: equal for equal (position, hash) lists."""
    return hashlib.sha256(positions.astype("<i8").tobytes() + b"|" + hashes.astype("<u8").tobytes()).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared distinct hashes by all distinct hashes (Jaccard); two empty fingerprints are alike."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - both
    return both / every if every else 1.0


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K,
                 window: int = WINDOW) -> DataFrame:
    """(doc_id, positions array<long>, hashes array<long>) per row; a null text is empty (no hashes)."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            got = [winnow(t.as_py() or "", k, window) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([p.tolist() for p, _ in got], pa.list_(pa.int64())),
                 pa.array([h.astype(np.int64).tolist() for _, h in got], pa.list_(pa.int64()))],
                names=["doc_id", "positions", "hashes"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, positions array<long>, hashes array<long>")


class _Doc:
    def __init__(self, doc_id, text: str, k: int, window: int):
        self.id, self.text = doc_id, text
        self.positions, self.hashes = winnow(text, k, window)

    def against(self, follower: _Doc, k: int, window: int) -> tuple:
        n = len(self.text)
        cut = n // 3
        edited = self.text[:n - cut] + follower.text[:cut]
        positions, hashes = winnow(edited, k, window)
        return (self.id, n, hashlib.sha256(edited.encode()).hexdigest(), digest_of(self.positions, self.hashes),
                digest_of(positions, hashes), likeness(self.hashes, hashes), likeness(self.hashes, follower.hashes))


_OUT = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
        "near_next double")
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, window: int = WINDOW,
                      parts: int | None = None) -> DataFrame:
    """Per row its fingerprint, that of its edited text (the last third replaced by the beginning of the next row's
    text) and how alike they and the next row's are. Rows follow one another by descending doc_id (nulls last, equal
    ones by their text's hash), the first follows the last.

    The texts move once: sorted by range, each task compares a row with the one after it. The first and the last text
    of each task are written with the results and compared in a join of neighbouring tasks. A null text is empty. A
    single row follows itself. Repeated rows follow one another. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "winnowing")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = parts or max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = rows.select("*", F.xxhash64("t").alias("h"), F.monotonically_increasing_id().alias("m"))
    # The last key splits rows equal in the first two, which may be in any order.
    order = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("m")]
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "t")

    def run(batches):
        from pyspark import TaskContext

        part, before, begun = TaskContext.get().partitionId(), None, False
        for b in batches:
            done = []
            for i, t in zip(b.column(0), b.column(1), strict=True):
                now = _Doc(i.as_py(), t.as_py(), k, window)
                if before is not None:
                    done.append((*before.against(now, k, window), None, None, None))
                if not begun:
                    done.append((*[None] * 7, part, now.text, None))
                before, begun = now, True
            if done:
                yield batch(done)
        if begun:
            yield batch([(before.id, *[None] * 6, part, None, before.text)])

    fields = ["doc_id", *_NAMES, "part", "first_text", "last_text"]

    def batch(done):
        cols = list(zip(*done, strict=True))
        kinds = [out.field(n).type for n in fields]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=fields)

    schema = f"doc_id {kind}, {_OUT}, part int, first_text string, last_text string"
    out = _arrow(schema)
    made = scratch.table(dealt.mapInArrow(run, schema))
    inner = made.where("part is null").select("doc_id", *_NAMES)
    firsts = made.where("first_text is not null").select("part", F.col("first_text").alias("t"))
    lasts = made.where("last_text is not null").select("doc_id", "part", F.col("last_text").alias("t"))
    # One row per task: which task follows (the first one follows the last).
    after = firsts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")),
                                             F.min("part").over(Window.partitionBy(F.lit(1)))).alias("after"))
    ends = (lasts.join(after, "part")
            .join(firsts.select(F.col("part").alias("after"), F.col("t").alias("follower")), "after")
            .select("doc_id", "t", "follower"))

    def run_ends(batches):
        for b in batches:
            done = [_Doc(i.as_py(), t.as_py(), k, window).against(_Doc(None, f.as_py(), k, window), k, window)
                    for i, t, f in zip(*b.columns, strict=True)]
            cols = list(zip(*done, strict=True)) if done else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, out.field(n).type) for n, c in zip(fields[:7], cols, strict=True)], names=fields[:7])

    return inner.unionByName(ends.mapInArrow(run_ends, f"doc_id {kind}, {_OUT}"))


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))
