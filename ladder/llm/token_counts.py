"""Edit-aware token counts (operator 3).

A document's pre-tokens (joined where a cut isn't safe) lie in leaves of a segment tree whose nodes hold the code points and tokens below them. An
edit re-encodes only the leaves it touches and the boundary context before them, until the pre-tokens meet an old leaf
boundary again; then the sums above the changed leaves are brought up to date. The leaves are columns of a
table, so trees can be kept and edited later.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladder.llm.bpe import LOOKAHEAD, default_pattern, encoder, safe_ends
from ladder.llm.common import ship

LEAF = 64


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@dataclass
class Tree:
    """``chars`` and ``tokens`` are binary trees in arrays: node i has the children 2i and 2i + 1, the leaves begin
    at ``width``. A leaf begins and ends where pre-tokens do; leaves may be empty."""

    text: str
    chars: list[int]
    tokens: list[int]
    ranks: str
    pattern: str
    encoded_chars: int = 0

    @property
    def width(self) -> int:
        return len(self.chars) // 2

    @classmethod
    def of(cls, text: str, ranks: str, pattern: str, leaf: int = LEAF) -> Tree:
        ends = list(safe_ends(text, pattern))
        cuts = ends[leaf - 1::leaf]
        if ends and (not cuts or cuts[-1] != ends[-1]):
            cuts.append(ends[-1])
        chars = np.diff([0, *cuts]).tolist()
        out = cls(text, [], [], ranks, pattern)
        tokens, at = [], 0
        for n in chars:
            tokens.append(out._count(text[at:at + n]))
            at += n
        return out._build(chars, tokens)

    @classmethod
    def from_leaves(cls, text: str, chars: list[int], tokens: list[int], ranks: str, pattern: str) -> Tree:
        return cls(text, [], [], ranks, pattern)._build(chars, tokens)

    def _build(self, chars: list[int], tokens: list[int]) -> Tree:
        width = 1
        while width < len(chars):
            width *= 2
        for name, leaves in (("chars", chars), ("tokens", tokens)):
            node = [0] * width + list(leaves) + [0] * (width - len(leaves))
            for i in range(width - 1, 0, -1):
                node[i] = node[2 * i] + node[2 * i + 1]
            setattr(self, name, node)
        return self

    def _count(self, part: str) -> int:
        self.encoded_chars += len(part)
        return len(encoder(self.ranks, self.pattern)[0].encode_ordinary(part))

    def leaves(self) -> tuple[list[int], list[int]]:
        return self.chars[self.width:], self.tokens[self.width:]

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the code point at ``place`` (the last one beyond the end), and where it starts."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if place - start >= self.chars[i]:
                start += self.chars[i]
                i += 1
        return i - self.width, start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the code points from ``start`` to ``end`` (cut to the text) by ``new``."""
        n = len(self.text)
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        # The first leaf that sees the edit: its end, and what decides about it, reach into the edit.
        first, begin = self.find(max(start - LOOKAHEAD, 0))
        while first and begin > max(start - LOOKAHEAD, 0):
            first -= 1
            begin -= self.chars[self.width + first]
        while first and begin + LOOKAHEAD > start:  # a boundary that the edit may move
            first -= 1
            begin -= self.chars[self.width + first]
        pieces, at = [], begin
        old, old_end = first, begin  # leaves before ``old`` end at ``old_end`` in the old text
        found = False
        for stop in safe_ends(text, self.pattern, begin):
            pieces.append(stop - at)
            at = stop
            while old < self.width and (old_end < end or old_end + shift < at):
                old_end += self.chars[self.width + old]
                old += 1
            if old_end >= end and old_end + shift == at and at >= start + len(new):
                found = True
                break
        if not found:
            old = self.width
        while old < self.width and not self.chars[self.width + old]:
            old += 1
        self.text = text
        self._replace(first, old, begin, pieces)

    def _replace(self, first: int, last: int, begin: int, pieces: list[int]) -> None:
        """Puts the pre-tokens ``pieces`` into the leaves from ``first`` up to ``last``."""
        room = last - first
        per = max(1, -(-len(pieces) // max(room, 1)))
        if per > 4 * LEAF or not room:  # too many for the leaves there: cut anew, with the counts of the others kept
            groups = [pieces[i:i + LEAF] for i in range(0, len(pieces), LEAF)]
            chars, tokens = self.leaves()
            new_chars, new_tokens = self._counts(begin, groups)
            self._build(chars[:first] + new_chars + chars[last:], tokens[:first] + new_tokens + tokens[last:])
            return
        groups = [pieces[i * per:(i + 1) * per] for i in range(room)]
        new_chars, new_tokens = self._counts(begin, groups)
        w = self.width
        self.chars[w + first:w + last] = new_chars
        self.tokens[w + first:w + last] = new_tokens
        low, high = (w + first) // 2, (w + last - 1) // 2
        while low:
            for i in range(low, high + 1):
                self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
                self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            low, high = low // 2, high // 2

    def _counts(self, at: int, groups: list[list[int]]) -> tuple[list[int], list[int]]:
        chars, tokens = [], []
        for g in groups:
            n = sum(g)
            chars.append(n)
            tokens.append(self._count(self.text[at:at + n]) if n else 0)
            at += n
        return chars, tokens


def build_trees(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: str | None = None,
                ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, text, leaf_chars, leaf_tokens[, edits]) per row: the table to keep. A null text is empty."""
    ship(docs.sparkSession)
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()

    def run(batches):
        for b in batches:
            got = [Tree.of(t.as_py(), ranks, pattern).leaves() for t in b.column(1)]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([c for c, _ in got], kind), pa.array([t for _, t in got], kind),
                 *b.columns[2:]], names=["doc_id", "text", "leaf_chars", "leaf_tokens", *b.schema.names[2:]])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
                       *([F.col(edits).alias("edits")] if edits else []))
    kind = rows.schema["doc_id"].dataType.simpleString()
    more = f", edits {rows.schema['edits'].dataType.simpleString()}" if edits else ""
    return rows.mapInArrow(run, f"doc_id {kind}, text string, leaf_chars array<int>, leaf_tokens array<int>{more}")


def apply_edits(trees: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Trees with a column ``edits``, array<struct<from, upto, new>> applied in order (places in the text as it then is).

    Returns doc_id, the edited text and its leaves, n_tokens before and n_tokens_edited after (read from the root) and
    reencoded_chars. A null or empty ``edits`` changes nothing; null places are 0, a null ``new`` deletes.
    """
    ship(trees.sparkSession)
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()
    rows = trees.select("doc_id", "text", "leaf_chars", "leaf_tokens", "edits")
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["text", "leaf_chars", "leaf_tokens", "n_tokens", "n_tokens_edited", "reencoded_chars"]
    kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        for b in batches:
            out = []
            for t, c, k, e in zip(*b.columns[1:], strict=True):
                tree = Tree.from_leaves(t.as_py(), c.as_py(), k.as_py(), ranks, pattern)
                before = tree.tokens[1]
                for x in e.as_py() or []:
                    start, upto, new = x.values()
                    tree.edit(start or 0, upto or 0, new or "")
                out.append((tree.text, *tree.leaves(), before, tree.tokens[1], tree.encoded_chars))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, t) for x, t in zip(cols, kinds, strict=True)]],
                                             names=["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {kind}, text string, leaf_chars array<int>, leaf_tokens array<int>, "
                                "n_tokens long, n_tokens_edited long, reencoded_chars long")


def sample_edits(text):
    """Three edits that any text allows: a word in front, the middle tenth twice, the last twentieth deleted."""
    n = F.length(text)
    tenth = (n * 45 / 100).cast("int")
    one = lambda a, b, new: F.struct(a.cast("int").alias("from"), b.cast("int").alias("upto"), new.alias("new"))
    return F.array(one(F.lit(0), F.lit(0), F.lit("Edited ")),
                   one(7 + tenth, 7 + tenth, F.substr(text, tenth + 1, (n / 10).cast("int"))),
                   one(7 + n + (n / 10).cast("int") - (n / 20).cast("int"), 7 + n + (n / 10).cast("int"), F.lit("")))


def edited_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's token count before and after ``sample_edits``: doc_id, n_chars, n_chars_edited, n_tokens,
    n_tokens_edited, reencoded_chars. Rows stay where they are read. A null text is empty; null doc_ids, repeated
    rows and empty tables need no care; other columns aren't read."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    trees = build_trees(rows.withColumn("edits", sample_edits(F.col("text"))), edits="edits")
    n_chars = lambda x: F.length(x).cast("long")
    done = apply_edits(trees.withColumn("doc_id", F.struct("doc_id", n_chars(F.col("text")).alias("n_chars"))))
    return done.select("doc_id.doc_id", "doc_id.n_chars", n_chars(F.col("text")).alias("n_chars_edited"), "n_tokens",
                       "n_tokens_edited", "reencoded_chars")
