"""Byte-level BPE encoding by overlapping chunks, and decoding (operator 8).

A long text is cut into overlapping chunks, which tasks pre-tokenise side by side. A pre-token's end depends on nothing
before its start, so where two neighbouring chunks have a boundary in common, their boundaries agree from there on:
they resynchronise, and the text is cut there. The pieces between such cuts are encoded and joined. Decoding
concatenates the tokens' bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ladder.llm.common import Scratch, ship

CHUNK = 16384
OVERLAP = 1024
#: Code points after a pre-token's end that decide about its end.
LOOKAHEAD = 2


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def encoder(ranks: str, pattern: str):
    """(tiktoken encoding, bytes of each id)."""
    import base64

    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
    return (tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}),
            {i: t for t, i in table.items()})


@lru_cache(maxsize=2)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def safe_ends(text: str, pattern: str, start: int = 0) -> Iterator[int]:
    """Ends of the pre-tokens from the boundary ``start`` on at which the text can be cut: the parts have the same
    pre-tokens alone. Not after white space, whose last character belongs to what follows only if it is seen."""
    for m in _splitter(pattern).finditer(text, start):
        end = m.end()
        if end == len(text) or not text[end - 1].isspace():
            yield end


def boundaries(chunk: str, pattern: str) -> list[int]:
    """Where the chunk can be cut, if a pre-token starts at its start."""
    return [0, *safe_ends(chunk, pattern)]


def encode_bytes(text: str, ranks: str, pattern: str) -> bytes:
    """Ids as little-endian unsigned 32-bit bytes."""
    return np.array(encoder(ranks, pattern)[0].encode_ordinary(text), dtype="<u4").tobytes()


def _encoded(frame: DataFrame, keys: str, ranks: str, pattern: str) -> DataFrame:
    """Replaces the last column, a text, by its ``ids``."""
    def run(batches):
        for b in batches:
            ids = [encode_bytes(t.as_py(), ranks, pattern) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.binary())],
                                             names=[*b.schema.names[:-1], "ids"])

    return frame.mapInArrow(run, f"{keys}, ids binary")


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str | None = None,
           pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) of every row; ``ids`` are little-endian unsigned 32-bit, binary. A null text is empty.

    Texts of one chunk need no stitching and are encoded where they are read. Chunks of longer ones are dealt out by
    (doc_id, digest of the text, chunk); repeated rows meet there and are counted, so no row key is needed. What brings a
    text's chunks together is their boundaries, not their texts. A piece has at most about two chunks and the run of
    letters between them. Other columns are not read; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    short = _encoded(rows.where(F.length("t") <= chunk), f"doc_id {kind}", ranks, pattern)
    # A null doc_id has a key, too.
    key = F.concat_ws(":", F.col("doc_id").isNull(), F.col("doc_id").cast("string"), F.sha2("t", 256))
    long = rows.where(F.length("t") > chunk).select("doc_id", key.alias("h"), "t")
    return short.unionByName(_encode_long(long, kind, ranks, pattern, chunk, overlap))


def _cut_chunks(long: DataFrame, kind: str, chunk: int, overlap: int) -> DataFrame:
    """(h, c, doc_id, final, n, t): the overlapping chunks of the distinct rows, with the rows' numbers."""
    def cut(batches):
        for b in batches:
            for i, t in enumerate(b.column(2)):
                text = t.as_py()
                starts = list(range(0, len(text), chunk))
                same = pa.array([i] * len(starts), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(same), b.column(1).take(same), pa.array(range(len(starts)), pa.int32()),
                     pa.array([s + chunk >= len(text) for s in starts]),
                     pa.array([text[s:s + chunk + overlap] for s in starts], pa.string())],
                    names=["doc_id", "h", "c", "final", "t"])

    # The condition, always true, is what the join will ask for: with it both users of the exchange are alike.
    return (long.mapInArrow(cut, f"doc_id {kind}, h string, c int, final boolean, t string")
            .where("h IS NOT NULL AND c IS NOT NULL").groupBy("h", "c").agg(F.first("doc_id").alias("doc_id"), F.first("final").alias("final"),
                                   F.count("*").alias("n"), F.first("t").alias("t")))


def _seams(chunks: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(h, c, piece, begin, upto, chunks): what part of each chunk belongs to which piece (named by its first chunk), and of
    how many chunks the piece is. Boundaries only; no texts."""
    def pre_tokenise(batches):
        for b in batches:
            head, tail, size = [], [], []
            for final, t in zip(b.column("final"), b.column("t"), strict=True):
                part = t.as_py()
                at = np.array(boundaries(part, pattern))
                head.append(at[at <= overlap].tolist())
                sure = at[(at >= chunk) & (at + LOOKAHEAD <= len(part))]  # what follows the chunk can't move these
                tail.append([] if final.as_py() else (sure - chunk).tolist())
                size.append(len(part))
            kind_of = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("h"), b.column("c"), b.column("final"), pa.array(size, pa.int32()), pa.array(head, kind_of), pa.array(tail, kind_of)],
                names=["h", "c", "final", "size", "head", "tail"])

    seen = chunks.mapInArrow(  # all columns: the same exchange as the join's
        pre_tokenise, "h string, c int, final boolean, size int, head array<int>, tail array<int>")
    by_text = Window.partitionBy("h").orderBy("c")
    # meet: where this chunk and the one before agree first, from this chunk's start; null where they don't.
    meet = F.when(F.col("c") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect(F.lag("tail").over(by_text), "head")))
    met = seen.select("h", "c", "final", "size", meet.alias("meet"))
    met = met.withColumn("begin", F.coalesce("meet", F.lit(0))).withColumn(
        "piece", F.max(F.when(F.col("meet").isNotNull(), F.col("c"))).over(
            by_text.rowsBetween(Window.unboundedPreceding, 0)))
    upto = F.when(F.col("final"), F.col("size")).otherwise(chunk + F.lead("begin").over(by_text))
    return met.withColumn("upto", upto).select(
        "h", "c", "piece", "begin", "upto", F.count("*").over(Window.partitionBy("h", "piece")).alias("chunks"))


def _encode_long(long: DataFrame, kind: str, ranks: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    scratch = Scratch(long.sparkSession, "bpe")
    keys = f"doc_id {kind}, h string, n long, piece int"
    # Chunks are dealt out by (h, c) once: the boundaries are made from that exchange, and the join with the seams reuses
    # it, as part of the same query.
    chunks = _cut_chunks(long, kind, chunk, overlap)
    seams = _seams(chunks, pattern, chunk, overlap)
    cut = chunks.join(seams, ["h", "c"]).select(
        "doc_id", "h", "n", "piece", "c", "chunks", "final",
        F.substr("t", F.col("begin") + 1, F.col("upto") - F.col("begin")).alias("t"),
        F.substr("t", F.col("upto") + 1, F.lit(overlap + 64)).alias("after"))
    single = _encoded(cut.where("chunks = 1").select("doc_id", "h", "n", "piece", "t"), keys, ranks, pattern)

    def encode_joined(batches):
        for b in batches:
            ids = []
            for t, after in zip(b.column(4), b.column(5), strict=True):
                part, rest = t.as_py(), after.as_py()
                # The cut after a joined piece holds if the piece's own boundaries have it; null: it doesn't.
                holds = rest is None or len(part) in boundaries(part + rest, pattern)
                ids.append(encode_bytes(part, ranks, pattern) if holds else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(ids, pa.binary())],
                                             names=["doc_id", "h", "n", "piece", "ids"])

    in_order = lambda *c: F.sort_array(F.collect_list(F.struct(*c)))
    pieces = cut.where("chunks > 1").groupBy("doc_id", "h", "n", "piece").agg(
        F.array_join(in_order("c", "t")["t"], "").alias("t"),
        F.max_by(F.when(~F.col("final"), F.col("after")), "c").alias("after"))
    encoded = scratch.table(single.unionByName(pieces.mapInArrow(encode_joined, f"{keys}, ids binary")))
    wrong = encoded.where("ids IS NULL").select("h").distinct()
    if not wrong.isEmpty():  # a text whose chunks never agree for good is encoded whole
        whole = chunks.join(wrong, "h", "left_semi").groupBy("doc_id", "h", "n").agg(
            F.array_join(F.transform(in_order("c", F.substring("t", 1, chunk).alias("t"))["t"], lambda x: x), "").alias("t"))
        whole = whole.select("doc_id", "h", "n", F.lit(0).alias("piece"), "t")
        encoded = encoded.join(wrong, "h", "left_anti").unionByName(_encoded(whole, keys, ranks, pattern))
    whole = encoded.groupBy("doc_id", "h", "n").agg(in_order("piece", "ids")["ids"].alias("ids"))

    def join(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([b"".join(x.as_py()) for x in b.column(2)],
                                                                                 pa.binary())],
                                             names=["doc_id", "n", "ids"])

    joined = whole.select("doc_id", "n", "ids").mapInArrow(join, f"doc_id {kind}, n long, ids binary")
    return joined.select("doc_id", "ids", F.explode(F.expr("sequence(1L, n)")).alias("_copy")).drop("_copy")


def decode(encoded: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): the bytes of the tokens of ``ids`` one after another; null for null."""
    ship(encoded.sparkSession)
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()
    rows = encoded.select("doc_id", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        token = encoder(ranks, pattern)[1].__getitem__
        for b in batches:
            out = [None if x.as_py() is None else b"".join(map(token, np.frombuffer(x.as_py(), dtype="<u4").tolist()))
                   for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())],
                                             names=["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")
