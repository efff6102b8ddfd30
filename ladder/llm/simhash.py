"""SimHash near-duplicates with pivot distance tables (operator 4).

1. ``fingerprints``: one 64-bit SimHash per row (Arrow batches, numpy).
2. Distinct fingerprints are cut into ``BLOCKS`` blocks. Fingerprints that differ in at most ``max_bits`` bits agree
   on at least ``BLOCKS - max_bits`` whole blocks, so they meet under at least one choice of that many blocks: an
   equi-join key, no cross join and no loss.
3. Fingerprints under one key are compared by their pivot distance tables: Hamming distances to fixed reference
   fingerprints are computed first, a pair whose coordinates differ by more than ``max_bits`` anywhere can't be
   within ``max_bits`` (triangle inequality) and is discarded, survivors are verified. Rows are sorted by one coordinate,
   so only neighbours in it are looked at. Only links that join two groups not joined before are sent on (a spanning set),
   so a group of g near copies gives about g links, not g². ``BLOCKS`` sets the keys' size: 7 give 35 keys of some 27
   bits a fingerprint, 8 give 70 of 32; with more fingerprints larger keys keep the groups small.
4. Keys with more than ``MOST`` fingerprints are cut into chunks, and every pair of chunks is a task of its own.
5. Connected components by alternating large-star and small-star steps over written tables.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladder.llm.common import Scratch, ship

SHINGLE = 4
MAX_BITS = 4
BLOCKS = 7
MOST = 4096
SEED = 42
#: Reference fingerprints: fixed pseudo-random ones.
PIVOTS = np.random.default_rng(SEED).integers(0, 2**64, 16, dtype=np.uint64)


def simhash(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a UTF-8 text; 0 for a text without words."""
    import xxhash

    words = (text or b"").lower().split()  # bytes: lowers A-Z only and splits at \x20\x09-\x0D only
    n = max(len(words) - shingle + 1, 1 if words else 0)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    last = len(words) - 1
    one = xxhash.xxh64_intdigest
    set_in = np.zeros(64, dtype=np.int64)
    for base in range(0, n, 1 << 16):  # bounded memory on very long texts
        h = np.array([one(joined[starts[i]:ends[min(i + shingle - 1, last)] - 1], SEED)
                      for i in range(base, min(base + (1 << 16), n))], dtype="<u8")
        set_in += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, for every row."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([simhash(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def block_keys(fp: Column, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> Column:
    """Array of (choice, value): for every choice of ``blocks - max_bits`` blocks, the bits in them."""
    if not 0 <= max_bits < blocks <= 64:
        raise ValueError("blocks must exceed max_bits")
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    out = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - max_bits)):
        mask = sum((1 << edges[i + 1]) - (1 << edges[i]) for i in chosen)
        out.append(F.struct(F.lit(k).alias("choice"),
                            fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")).alias("value")))
    return F.array(*out)


def spanning_links(fp: np.ndarray, run: np.ndarray, max_bits: int = MAX_BITS,
                   verified: list[int] | None = None) -> list[tuple[int, int]]:
    """Positions of linked pairs of distinct fingerprints within each run of equal ``run`` numbers (non-decreasing), that
    connect what all pairs within ``max_bits`` connect.

    Every fingerprint's distances to PIVOTS are its coordinates. Rows are sorted by run and first coordinate, and compared
    with the one after them, the second after them and so on, all rows at once, while the first coordinate allows it. A
    pair goes on if it isn't joined yet and no other coordinate differs by more than ``max_bits`` (triangle inequality);
    what is left is verified. ``verified`` counts those. The same at every size; memory is a few numbers per row.
    """
    table = np.bitwise_count(fp[:, None] ^ PIVOTS).astype(np.int8)
    order = np.lexsort((table[:, 0], run))
    fp, run, table = fp[order], run[order], np.ascontiguousarray(table[order].T)
    root, links, lag = np.arange(len(fp)), [], 1
    going = np.arange(len(fp))
    while len(going := going[going + lag < len(fp)]):
        going = going[(run[going + lag] == run[going]) & (table[0, going + lag] - table[0, going] <= max_bits)]
        pairs = going[root[going] != root[going + lag]]
        for c in table[1:]:
            pairs = pairs[np.abs(c[pairs + lag] - c[pairs]) <= max_bits]
        if verified is not None:
            verified.append(len(pairs))
        pairs = pairs[np.bitwise_count(fp[pairs] ^ fp[pairs + lag]) <= max_bits]
        if len(pairs):
            links += _join(root, pairs, pairs + lag)
        lag += 1
    return [(int(order[i]), int(order[j])) for i, j in links]


def _join(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Join the pairs, keeping ``root`` flat; the pairs that joined two sets."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    made = []
    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        a, b = find(int(root[i])), find(int(root[j]))
        if a != b:
            up[max(a, b)] = min(a, b)
            made.append((i, j))
    if up:
        old = np.fromiter(up, dtype=root.dtype)
        to = np.arange(len(root))
        to[old] = [find(int(x)) for x in old]
        root[:] = to[root]
    return made


def _near_in_groups(max_bits: int):
    def run(batches):
        kept = None
        for b in batches:  # rows come sorted by group; the last group of a batch may go on in the next
            cols = [np.asarray(b.column(i)) for i in range(4)]
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            new = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
            cut = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
            kept = [x[cut:] for x in cols]
            if cut:
                yield links(np.r_[0, np.cumsum(new[:cut - 1])], cols[3][:cut])
        if kept is not None and len(kept[0]):
            yield links(np.zeros(len(kept[0]), dtype=int), kept[3])

    def links(group, fp):
        found = np.array(spanning_links(fp.view(np.uint64), group, max_bits), dtype=np.int64).reshape(-1, 2)
        ends = fp[found]
        return pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1))], names=["a", "b"])

    return run


def near_links(fps: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS, blocks: int = BLOCKS,
               most: int = MOST) -> DataFrame:
    """Distinct links (a < b) between the distinct fingerprints in ``fps.fp`` whose connected components are those
    of all pairs within ``max_bits``."""
    keyed = fps.select("fp", F.explode(block_keys(F.col("fp"), max_bits, blocks)).alias("k")).select(
        "k.choice", "k.value", "fp")
    # Keys with too many members for one task, at most (members / most) of them.
    hot = scratch.table(keyed.groupBy("choice", "value").count().where(F.col("count") > most)
                        .select("choice", "value", F.ceil(F.col("count") / (most // 2)).cast("int").alias("chunks")))
    keyed = keyed.join(hot, ["choice", "value"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    keyed = (keyed.select("choice", "value", "fp", "chunks", own.alias("own"), other.alias("other"))
             .select("choice", "value", (F.least("own", "other") * F.col("chunks") + F.greatest("own", "other"))
                     .cast("long").alias("part"), "fp"))
    dealt = keyed.repartition("choice", "value", "part").sortWithinPartitions("choice", "value", "part", "fp")
    return dealt.mapInArrow(_near_in_groups(max_bits), "a long, b long").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): for every node of the links (a < b) the smallest node that it is connected to.

    Large-star joins each node's larger neighbours to its smallest neighbour, small-star its smaller neighbours and
    itself; both keep connectivity, and alternating them ends in stars. Each step is two partly aggregated minima and
    equi-joins over a written table. Work per round is proportional to the links.
    """
    def star(pairs, larger: bool):
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        if not larger:
            both = both.where("v < u")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        moved = both.where("v > u") if larger else both
        out = moved.join(low, "u").select(F.col("low").alias("a"), F.col("v").alias("b"))
        if not larger:
            out = out.unionByName(low.select(F.col("low").alias("a"), F.col("u").alias("b")))
        return out.where("a < b").distinct()

    def state(pairs):
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = scratch.table(links.select("a", "b").where("a < b"))
    before = state(now)
    while True:
        after = scratch.table(star(star(now, True), False))
        seen = state(after)
        scratch.drop(now)
        now = after
        if seen == before:
            break
        before = seen
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, blocks: int = BLOCKS, most: int = MOST) -> DataFrame:
    """(doc_id, fp, component_id) per input row; ``component_id`` is the smallest doc_id of the rows connected to it.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. A null doc_id counts only where a
    component has no other (its component_id is null). Repeated rows come out repeated. Other input columns are not
    read. The texts are read once; fingerprints, links and components are tables in the shared folder.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(fingerprints(docs, doc_id, text, shingle))
    fps = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    links = near_links(fps.select("fp"), scratch, max_bits, blocks, most)
    roots = scratch.table(components(links, scratch))
    linked = fps.join(roots, F.col("fp") == F.col("node"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.select("fp", "root").join(least, "root").select("fp", "component_id")
    copies = fps.join(roots, F.col("fp") == F.col("node"), "left_anti").where("n > 1").select(
        "fp", F.col("least").alias("component_id"))
    named = scratch.table(named.unionByName(copies))  # all other rows are components of one
    return rows.join(named, "fp", "left").select(
        "doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each group of near-duplicates: that with the smallest
    doc_id (rows without one last), of several such rows that with the smallest digest of its text, of rows equal
    in both any one.
    """
    digest = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)
    key = F.struct(F.col(doc_id).isNull().alias("z"), F.col(doc_id).alias("id"), digest.alias("h"))  # in this order
    # As text it can be grouped and joined by one exchange (a struct's nullability would ask for a second).
    name = lambda k: F.concat_ws(":", k["z"], k["id"], k["h"])
    rows = docs.select(F.struct("*").alias("_row"), name(key).alias("_key"))
    stay = near_duplicates(docs.select(key.alias("_key"), F.col(text).alias("_text")), "_key", "_text", **settings)
    stay = stay.select(name(F.col("component_id")).alias("_key")).distinct()
    once = rows.groupBy("_key").agg(F.first("_row").alias("_row"))  # repeated rows meet on the map side
    return once.join(stay, "_key", "left_semi").select("_row.*")
