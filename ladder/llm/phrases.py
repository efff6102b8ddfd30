"""Collocations by best-first branch and bound (operator 11).

A phrase of 2 to ``WORDS`` words that occurs a times and is cut into parts that occur l and r times scores
floor(2000000 a / (l + r)); its lowest-scoring cut counts. Phrases that a longer one nearly always holds are dropped, and
each language's first ``TOP`` of the others are wanted.

Bounds. With x its first word and P its first two, a phrase scores at most 2000000 f(P) / (f(x) + f(P)): the cut after x
has l = f(x), r >= a, and a <= f(P). In the same way its last word and last two words bound it. So:

1. One scan counts words and pairs of words, exactly, and gives every pair its score and its reach, the larger bound.
2. The frontier is expanded from the best reach down, a level at a time: a level is a score per language, and a further
   scan counts the phrases of 3 and 4 words that hold a pair of at least that reach (any phrase scoring that much starts
   and ends with such pairs, all its parts are counted with it, and so is every longer phrase that holds it). Phrases at
   or above the level are then scored and settled for good.
3. A language is done when ``TOP`` settled ones are at or above its level, ties included, or the level is 0. Others
   get a lower level: of ``GROWTH`` times as many pairs.

Tasks know the pairs from a filter of fixed size; a pair let through by chance is counted too and joined away. Only
counts are shuffled, added up by task before; no task sees a language whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ladder.llm.common import Scratch, ship
from ladder.llm.words import LOWER, Words, byte_table, groups, joined, mapped

WORDS = 4
LEAST = 30
TOP = 2000
COVER = 80
#: Pairs at or above the first level, in results wanted; a further level has so many times as many.
FIRST = 2
GROWTH = 8
FILTER_BITS = 1 << 24
#: Bytes of text that a task counts at a time; some forty times as much is in use meanwhile.
GROUP = 1 << 22
#: What parts words, and what parts pieces.
KINDS = byte_table(" \t", ".,;:!?\n\x0b\x0c\r")
_COLUMNS = "lang string, m int, phrase string, f long"


def _word_hashes(lang: str, spellings: list[bytes]) -> np.ndarray:
    import xxhash

    head = lang.encode() + b"\t"
    return np.array([xxhash.xxh64_intdigest(head + s, 42) for s in spellings], dtype=np.uint64)


def pair_place(lang: Column, first: Column, second: Column, bits: int) -> Column:
    """The pair's bit in a filter, as ``_places`` has it."""
    one, two = (F.xxhash64(F.concat(lang, F.lit("\t"), w)) for w in (first, second))
    turned = F.shiftleft(two, 23).bitwiseOR(F.shiftrightunsigned(two, 41))
    return one.bitwiseXOR(turned).bitwiseAND(F.lit(bits - 1).cast("long"))


def _places(hashes: np.ndarray, first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    turned = (hashes << np.uint64(23)) | (hashes >> np.uint64(41))
    return (hashes[first] ^ turned[second]) & np.uint64(bits - 1)


def _filter(pairs: DataFrame, bits: int) -> np.ndarray:
    """Filter of the pairs (lang, x, y), a boolean per bit; at most bits / 64 numbers come to the driver."""
    at = pair_place(F.col("lang"), F.col("x"), F.col("y"), bits)
    rows = (pairs.select(at.alias("at")).groupBy(F.expr("at div 64").alias("id"))
            .agg(F.expr("bit_or(shiftleft(1L, int(at % 64)))").alias("word")).collect())
    words = np.zeros(-(-bits // 64), dtype="<i8")
    words[[r["id"] for r in rows]] = [r["word"] for r in rows]
    return words.view(np.uint8)


def _has(filter_bytes: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (filter_bytes[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a position of each distinct key, its number per position, its count)."""
    _, at, number, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return at, number, n


def _grams(lang: str, texts: pa.Array, bits: int, frequent: np.ndarray | None, active: np.ndarray | None):
    """(words, phrases, counts) of texts in one language: words and pairs without filters, else phrases of 3 and 4."""
    raw, at = joined(texts)
    data = mapped(raw, LOWER)
    kind = mapped(data, KINDS)
    words = Words(data, at, kind > 0)
    codes, n = words.codes, len(words.codes)
    if not n:
        return
    # Words of one piece have the same number of breaks and text ends before them.
    piece = np.searchsorted(np.flatnonzero(kind == 2), words.starts) + np.repeat(np.arange(len(texts)), np.diff(words.first))
    spell = words.spellings
    size = len(spell)

    def phrases(begins: np.ndarray, m: int) -> pa.Array:
        parts = [spell.take(pa.array(codes[begins + i])) for i in range(m)]
        return pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if m > 1 else parts[0]

    pairs = np.flatnonzero(piece[1:] == piece[:-1])
    if frequent is None:
        yield 0, pa.array([b""], pa.large_binary()), [n]
        yield 1, spell, np.bincount(codes, minlength=size)
        if len(pairs):
            first, _, count = _tally(codes[pairs] * size + codes[pairs + 1])
            yield 2, phrases(pairs[first], 2), count
        return
    place = _places(_word_hashes(lang, spell.to_pylist()), codes[pairs], codes[pairs + 1], bits)
    known, wanted = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)  # of the pair that begins at a word
    known[pairs] = _has(frequent, place)
    wanted[pairs] = _has(active, place)
    three = known[:-1] & known[1:]
    four = np.flatnonzero(three[:-1] & three[1:] & (wanted[:-2] | wanted[1:-1] | wanted[2:])) if n > 2 else pairs[:0]
    three_all = np.flatnonzero(three)
    if not len(three_all):
        return
    _, pair_no, _ = _tally(codes[three_all] * size + codes[three_all + 1])
    first, three_no, count = _tally(pair_no * size + codes[three_all + 2])
    hit = wanted[three_all] | wanted[three_all + 1]
    chosen = hit[first]  # the same for all places of a phrase
    if chosen.any():
        yield 3, phrases(three_all[first[chosen]], 3), count[chosen]
    if len(four):
        number = three_no[np.searchsorted(three_all, four)]
        first, _, count = _tally(number * size + codes[four + 3])
        yield 4, phrases(four[first], 4), count


def counts(docs: DataFrame, frequent: np.ndarray | None = None, active: np.ndarray | None = None,
           bits: int = FILTER_BITS) -> DataFrame:
    """(lang, m, phrase, f) of ``docs`` (lang, text): phrases of m words, all occurrences; m = 0: the number of words.

    Without filters words and pairs; with them the phrases of 3 and 4 words all of whose pairs are in ``frequent`` and one
    in ``active``.
    """
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            for first, texts in groups(b.column(1), GROUP):
                langs = b.column(0).slice(first, len(texts)).dictionary_encode()
                for code, lang in enumerate(langs.dictionary.to_pylist()):
                    own = texts.filter(pc.equal(langs.indices, code))
                    for m, phrase, n in _grams(lang, own, bits, frequent, active):
                        k = len(phrase)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * k, pa.string()), pa.array(np.full(k, m, dtype=np.int32)),
                             phrase.cast(pa.large_string()).cast(pa.string()), pa.array(n, pa.int64())],
                            names=["lang", "m", "phrase", "f"])

    rows = docs.select("lang", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("t"))
    return rows.mapInArrow(run, _COLUMNS).groupBy("lang", "m", "phrase").agg(F.sum("f").alias("f"))


def score(a: str, parts: str) -> Column:
    """floor(2000000 a / parts), exactly: the product may pass 64 bits."""
    return F.expr(f"(2000000 * CAST({a} AS DECIMAL(19, 0))) div CAST({parts} AS DECIMAL(20, 0))").cast("long")


def _part(words: str, start: int, n: int) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def scored_pairs(grams: DataFrame) -> DataFrame:
    """(lang, phrase, x, y, a, l, r, score, reach) of the pairs in ``grams``."""
    words = grams.where("m = 1")
    pairs = grams.where("m = 2").select("lang", "phrase", F.split("phrase", " ").alias("w"), F.col("f").alias("a"))
    pairs = pairs.select("lang", "phrase", F.col("w")[0].alias("x"), F.col("w")[1].alias("y"), "a")
    for side, word in (("l", "x"), ("r", "y")):
        pairs = pairs.join(words.select("lang", F.col("phrase").alias(word), F.col("f").alias(side)), ["lang", word])
    return pairs.select("lang", "phrase", "x", "y", "a", "l", "r", score("a", "l + r").alias("score"),
                        F.greatest(score("a", "l + a"), score("a", "r + a")).alias("reach"))


def levels(pairs: DataFrame, langs: DataFrame, rank: int) -> DataFrame:
    """(lang, level) for each of ``langs``: the score that ``rank`` of its pairs reach; 0 if there are fewer."""
    many = pairs.join(langs, "lang", "left_semi").groupBy("lang", "score").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    best = (many.withColumn("n", F.sum("n").over(upto)).where(F.col("n") >= rank)
            .groupBy("lang").agg(F.max("score").alias("level")))
    return langs.join(best, "lang", "left").select("lang", F.coalesce("level", F.lit(0)).cast("long").alias("level"))


def scored_longer(longer: DataFrame, shorter: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of 3 and 4 words all of whose parts are known."""
    cuts = [F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), part.alias("part"))
            for k in range(1, WORDS)
            for side, part in (("l", _part("w", 1, k)), ("r", F.array_join(F.expr(f"slice(w, {k + 1}, {WORDS})"), " ")))]
    parts = (longer.select("lang", "phrase", "m", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
             .select("lang", "phrase", "m", "a", F.explode(F.array(*cuts)).alias("c")).where("c.k < m")
             .select("lang", "phrase", "m", "a", "c.k", "c.side", "c.part"))
    known = shorter.unionByName(longer).select("lang", F.col("phrase").alias("part"), "f")
    found = parts.join(known, ["lang", "part"]).groupBy("lang", "phrase", "m", "a", "k").agg(
        F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    found = found.where("l IS NOT NULL AND r IS NOT NULL").withColumn("score", score("a", "l + r"))
    best = found.groupBy("lang", "phrase", "m", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("b"), F.count("*").alias("cuts")).where("cuts = m - 1")
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def covers(longer: DataFrame) -> DataFrame:
    """(lang, phrase, cover): for each shorter phrase in one of ``longer`` the count of the most frequent such one."""
    inside = [_part("w", s, n) for n in (2, 3) for s in range(1, WORDS - n + 2)]
    held = longer.select("lang", "phrase", "m", "f", F.split("phrase", " ").alias("w")).select(
        "lang", "m", "f", F.explode(F.array_distinct(F.array(*inside))).alias("inner"))
    # A slice past the end of a phrase of 3 gives fewer words, or the phrase itself.
    size = F.size(F.split("inner", " "))
    return held.where((size > 1) & (size < F.col("m"))).groupBy("lang", F.col("inner").alias("phrase")).agg(F.max("f").alias("cover"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP,
                 cover: int = COVER, first: int = FIRST, growth: int = GROWTH, bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases by score, a (both descending) and
    phrase (in byte order), of those that occur ``least`` times and that no longer such phrase holds in ``cover`` per cent.

    A null language is ``und``; a null text is empty. Repeated rows count each time. Very long texts are counted by
    themselves, in memory proportional to the text. Other columns are not read; an empty table gives no rows. ``bits`` is
    a power of two; it bounds the filters' size and changes no result.
    """
    if bits & (bits - 1) or bits < 64:
        raise ValueError("bits must be a power of two")
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    grams = scratch.table(counts(rows).where(f"m = 0 OR f >= {least}"))
    pairs = scratch.table(scored_pairs(grams))
    shorter = grams.where("m IN (1, 2)")
    langs = grams.where("m = 0").select("lang", F.col("f").alias("n"))
    todo, rank, done = scratch.table(langs.select("lang")), first * top, []
    while not todo.isEmpty():
        level = scratch.table(levels(pairs, todo, rank))
        own = pairs.join(level, "lang")
        frequent, active = _filter(own, bits), _filter(own.where("reach >= level"), bits)
        longer = scratch.table(counts(rows, frequent, active, bits).where(f"f >= {least}"))
        longer = longer.join(todo, "lang", "left_semi")
        scored = own.select("lang", "phrase", "a", "l", "r", "score").unionByName(scored_longer(longer, shorter))
        settled = scored.join(level, "lang").where("score >= level")
        stay = (settled.join(covers(longer), ["lang", "phrase"], "left")
                .where(f"cover IS NULL OR 100 * cover < {cover} * a").drop("cover"))
        stay = scratch.table(stay)
        enough = stay.groupBy("lang").agg(F.count("*").alias("n"))
        over = level.join(enough, "lang", "left").where((F.col("level") == 0) | (F.col("n") >= top)).select("lang")
        over = scratch.table(over)
        done.append(stay.join(over, "lang", "left_semi").drop("level"))
        todo, rank = scratch.table(todo.join(over, "lang", "left_anti")), rank * growth
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    found = done[0] if done else pairs.select("lang", "phrase", "a", "l", "r", "score")
    for more in done[1:]:
        found = found.unionByName(more)
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(langs, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
