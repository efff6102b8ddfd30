"""Periodic runs of words (operator 13): multi-scale minimizers, seed extension, lag scans for short periods.

A run is a stretch of consecutive words with smallest period q, at least ``REPEATS`` periods and ``SHORTEST`` words long,
that no neighbouring word extends. The words of an Arrow batch are numbered and searched together, texts parted by
numbers that occur once:

1. Periods up to ``LAGS``: one scan per lag, words equal to the word that far before them.
2. Periods in (w, 2w] for w = LAGS, 2 LAGS, 4 LAGS, ...: of every w consecutive 2w-grams the one with the least hash (the
   rightmost of equal ones) is a minimizer. Inside a run of such a period q, the windows at i and i + q see the same
   hashes, so their minimizers lie q apart, and no equal 2w-gram lies between (it would give the run a smaller period).
   Two successive equal minimizers at a distance in (w, 2w] therefore seed every run; seeds are extended word by word
   and verified on the words themselves. A minimizer is expected once in about w / 2 words, and only texts long enough
   for the scale's periods take part in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladder.llm.common import GAP, GAP_CHARS, ship
from ladder.llm.words import Words, groups, joined, ragged

REPEATS = 4
SHORTEST = 6
LAGS = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of True."""
    edge = np.flatnonzero(np.diff(np.r_[False, equal, False].view(np.int8)))
    return edge[::2], edge[1::2]


def _primitive(x: np.ndarray, start: int, q: int) -> bool:
    """Whether q, a period of at least two repeats from ``start`` on, is the smallest: a smaller one would divide it."""
    word = x[start:start + q]
    return not any(q % r == 0 and np.array_equal(word, np.roll(word, q // r)) for r in range(2, q + 1))


def _lag_runs(x: np.ndarray, q: int, least: int) -> Iterator[tuple[int, int, int]]:
    if len(x) > q:
        begin, end = _stretches(x[q:] == x[:-q])
        for k in np.flatnonzero(end - begin + q >= least).tolist():
            if _primitive(x, int(begin[k]), q):
                yield int(begin[k]), int(end[k] - begin[k]) + q, q


def _agree(x: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words agree from i and j on, going forwards (step 1) or backwards (-1), i < j."""
    n, size = 0, 64
    while True:
        most = min(size, len(x) - j - n if step > 0 else i - n + 1)
        if most <= 0:
            return n
        a, b = i + step * n, j + step * n
        same = (x[a:a + most] == x[b:b + most]) if step > 0 else (x[a - most + 1:a + 1] == x[b - most + 1:b + 1])[::-1]
        if not same.all():
            return n + int(np.argmin(same))
        n, size = n + most, size * 2


def minimizers(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least hash of every ``w`` (a power of two) consecutive ones, the rightmost of equal ones."""
    bits = max(1, int(len(hashes)).bit_length())
    low = np.uint64((1 << bits) - 1)
    # The lower bits give the place, from the right: what is least and rightmost is least.
    m = (hashes & ~low) | (low - np.arange(len(hashes), dtype=np.uint64))
    step = 1
    while step < w:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    picked = np.zeros(len(hashes), dtype=bool)
    picked[(low - (m & low)).astype(np.int64)] = True
    return np.flatnonzero(picked)


def seeds(x: np.ndarray, w: int) -> Iterator[tuple[int, int]]:
    """(distance, position) of successive equal minimizers of the 2w-grams of ``x`` at a distance in (w, 2w], sorted."""
    h, k = (x.astype(np.uint64) + np.uint64(1)) * _ODD, 1
    while k < 2 * w and len(h) > k:
        a, b = h[:-k], h[k:]
        h = (a ^ (a >> np.uint64(29))) * _ODD + (b ^ (b >> np.uint64(32))) * (_ODD ^ np.uint64(0xBF58476D1CE4E5B8))
        h, k = h ^ (h >> np.uint64(31)), 2 * k
    if k < 2 * w or len(h) < w:
        return
    at = minimizers(h, w)
    order = np.argsort(h[at], kind="stable")
    p, v = at[order], h[at][order]
    apart = p[1:] - p[:-1]
    good = np.flatnonzero((v[1:] == v[:-1]) & (apart > w) & (apart <= 2 * w))
    yield from sorted(zip(apart[good].tolist(), p[good].tolist(), strict=True))


def _seeded_runs(x: np.ndarray, w: int, repeats: int, shortest: int) -> Iterator[tuple[int, int, int]]:
    last, upto = 0, 0
    for q, p in seeds(x, w):
        if q == last and p + q < upto:
            continue  # inside the stretch of that period found last
        back = _agree(x, p - 1, p - 1 + q, -1) if p else 0
        start, ahead = p - back, _agree(x, p, p + q, 1)
        last, upto = q, p + q + ahead
        if upto - start >= max(shortest, repeats * q) and _primitive(x, start, q):
            yield start, upto - start, q


def find_runs(texts: list[np.ndarray], repeats: int = REPEATS, shortest: int = SHORTEST) -> list[list[tuple[int, int, int]]]:
    """Per text (an array of word numbers, 0 or more) its runs (start, length, period), sorted by start and period."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]

    def together(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen texts in one array, each followed by a number of its own; where each begins."""
        x = np.empty(int(size[which].sum()) + len(which), dtype=np.int64)
        begin = np.cumsum(size[which] + 1) - size[which] - 1
        if len(which):
            x[ragged(begin, size[which])] = np.concatenate([texts[i] for i in which])
            x[begin + size[which]] = -1 - np.arange(len(which))
        return x, begin

    def found(which: np.ndarray, begin: np.ndarray, runs: Iterator[tuple[int, int, int]]) -> None:
        for start, length, q in runs:
            k = int(np.searchsorted(begin, start, side="right")) - 1
            out[which[k]].append((start - int(begin[k]), length, q))

    which = np.flatnonzero(size >= shortest)
    x, begin = together(which)
    for q in range(1, LAGS + 1):
        found(which, begin, _lag_runs(x, q, max(shortest, repeats * q)))
    w = LAGS
    while len(which := np.flatnonzero(size >= max(shortest, repeats * (w + 1)))):
        x, begin = together(which)
        found(which, begin, _seeded_runs(x, w, repeats, shortest))
        w *= 2
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repeats: int = REPEATS,
                  shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, runs, collapsed) per row: ``runs`` is an array of (start, length, period) in words by start and period,
    ``collapsed`` the text's words joined by one space without those that a run holds after its first period.

    ``repeats`` is 4 or more: the seeds are proven for that. A null, empty or blank text has no words and no runs. Very
    long texts are searched whole, by themselves, in memory proportional to the text. Repeated rows come out alike, null
    doc_ids stay, other columns are not read, an empty table gives no rows. Rows stay in their partition.
    """
    if repeats < 4:
        raise ValueError("repeats must be 4 or more")
    ship(docs.sparkSession)
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for b in batches:
            all_runs, collapsed = [], []
            for _, texts in groups(b.column(1), 1 << 23):
                words = Words(*joined(texts))
                numbers = np.split(words.codes, words.first[1:-1])
                for data, runs, x in zip(texts, find_runs(numbers, repeats, shortest), numbers, strict=True):
                    parts = (data.as_py() or b"").split()  # bytes: at \x20\x09-\x0D only
                    if runs:
                        stay = np.ones(len(x), dtype=bool)
                        for start, length, q in runs:
                            stay[start + q:start + length] = False
                        parts = compress(parts, stay.tolist())
                    collapsed.append(b" ".join(parts).decode())
                    all_runs.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(all_runs, kinds), pa.array(collapsed, pa.string())],
                                             names=["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, "
                                "collapsed string")


def with_planted_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with a periodic tail in about a tenth of the texts: with h the crc32 of the decimal doc_id and
    g = h div 10, where h mod 10 is 0 and there are n > 0 words, every word i from a = g mod n on becomes the original
    word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). Other texts, and all rows with a null doc_id, stay."""
    inner = F.btrim(F.col(text).cast("string"), F.lit(GAP_CHARS))
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    planted = (h % 10 == 0) & (F.length(inner) > 0)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_t"),
                       F.floor(h / 10).cast("long").alias("_g"), F.when(planted, F.split(inner, GAP)).alias("_w"))
    rows = rows.withColumn("_n", F.size("_w")).withColumn("_a", F.expr("CASE WHEN _n > 0 THEN int(_g % _n) END"))
    rows = rows.withColumn("_p", F.expr("int(1 + (_n - _a) div (3 + _g % 8))"))
    tail = "slice(flatten(array_repeat(slice(_w, _a + 1, _p), int(1 + (_n - _a) div _p))), 1, _n - _a)"
    edited = F.expr(f"concat_ws(' ', concat(slice(_w, 1, _a), {tail}))")
    return rows.select("doc_id", F.when(F.col("_w").isNotNull(), edited).otherwise(F.col("_t")).alias("text"))


def run_report(found: DataFrame) -> DataFrame:
    """Per row of ``periodic_runs``: n_runs; start, length, period and exponent_milli of the run with the greatest
    length / period (ties: smallest start, then period; null without runs); digests of all runs and of what is left."""
    def best(lists):
        for b in lists:
            cols = [[] for _ in range(5)]
            for x in b.column(1):
                runs = [(r["start"], r["length"], r["period"]) for r in x.as_py()]
                top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
                cols[0].append(len(runs))
                for c, v in zip(cols[1:4], top, strict=True):
                    c.append(v)
                cols[4].append(hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string()), b.column(2)],
                names=["doc_id", "n_runs", "start", "length", "period", "runs_sha256", "collapsed_sha256"])

    kind = found.schema["doc_id"].dataType.simpleString()
    digest: Column = F.sha2("collapsed", 256)
    out = found.select("doc_id", "runs", digest.alias("collapsed_sha256")).mapInArrow(
        best, f"doc_id {kind}, n_runs long, start long, length long, period long, runs_sha256 string, collapsed_sha256 string")
    return out.withColumn("exponent_milli", F.expr("1000 * length div period"))
