"""Language identification by compression (operator 10).

Each language has a raw-content zstandard dictionary of sample text. A text is lower-cased and cut into blocks, every
block is compressed with every dictionary, and the language whose blocks are smallest in all is chosen. Where the runner-up is
nearly as small, the prediction is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ladder.llm.common import Scratch, ship

#: The sample that dictionaries are made of: at most so many documents of each language, so many code points of each.
SAMPLE_DOCS = 256
SAMPLE_CHARS = 1024
#: Holds the whole sample: no code point has more than four bytes in lower case; a line end parts the texts.
DICTIONARY_BYTES = SAMPLE_DOCS * (4 * SAMPLE_CHARS + 1)
BLOCK = 2048
LEVEL = 9
#: A prediction is rejected if the runner-up's bytes exceed the winner's by less than this share.
MARGIN = 0.002
#: A language is learned if at least one labelled row in so many has it: so many languages at most come to the driver.
RAREST = 10_000
UNKNOWN = "und"
_PLACES = 1 << 40


@dataclass
class Model:
    """Dictionaries by language, in order of the language's name."""

    dictionaries: dict[str, bytes]

    def compressors(self):
        import zstandard as zstd

        out = {}
        for lang, data in self.dictionaries.items():
            d = zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out[lang] = zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False)
        return out


def is_held_out(doc_id):
    """Documents that nothing is learned from: crc32(doc_id as text) mod 3 is 1 (false for a null doc_id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS,
          dictionary_bytes: int = DICTIONARY_BYTES, rarest: int = RAREST) -> Model:
    """Dictionaries from a bounded sample: of each language's documents that aren't held out and have a letter, the
    ``sample_docs`` with the smallest hash, ``sample_chars`` code points of each. Rows without a language teach
    nothing, nor do languages that fewer than one labelled row in ``rarest`` has. The languages' counts say below which hash about four times as many lie, so only those are ranked, however
    many rows and tasks there are; a language's sample comes to the driver."""
    labelled = docs.where(F.col(lang).isNotNull() & ~is_held_out(doc_id) & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("t"), F.xxhash64(doc_id, text).alias("h"))
    tally = Scratch(docs.sparkSession, "langid").table(labelled.groupBy("lang").count())
    often = tally.where(F.col("count") * rarest >= tally.agg(F.sum("count")).scalar())
    counts = {r["lang"]: r["count"] for r in often.collect()}
    if not counts:
        return Model({})
    place = F.pmod("h", F.lit(_PLACES))
    upto = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(_PLACES, 4 * sample_docs * _PLACES // n))])
    rows = labelled.where(place < F.element_at(upto, F.col("lang"))).select(
        "lang", F.substring("t", 1, sample_chars).alias("t"), "h")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "h", "t"))
    sample = rows.withColumn("r", rank).where(F.col("r") <= sample_docs).select("lang", "r", "t").collect()
    made: dict[str, list[bytes]] = {}
    for s in sorted(sample, key=lambda s: (s["lang"], -s["r"])):
        made.setdefault(s["lang"], []).append(s["t"].lower().encode())
    return Model({k: b"\n".join(v)[-dictionary_bytes:] for k, v in made.items()})


def classify(data: bytes, compressors: dict, margin: float = MARGIN) -> tuple[str, float, float, bool]:
    """(language, score, margin, rejected). The score is the winner's share of 2 ** -(bytes more than the winner),
    summed over the languages; equal sizes go to the first language by name."""
    blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
    sizes = {k: sum(len(c.compress(b)) for b in blocks) for k, c in compressors.items()}
    best = min(sizes, key=sizes.get)
    score = 1 / sum(2.0 ** -min(s - sizes[best], 64) for s in sizes.values())
    next_best = min((s for k, s in sizes.items() if k != best), default=math.inf)
    lead = 1.0 if next_best == math.inf else (next_best - sizes[best]) / next_best
    return best, score, lead, lead < margin


def classifier(model: Model, margin: float = MARGIN):
    """``classify`` for texts: of one without a letter, or where no language was learned, nothing is told."""
    compressors = model.compressors()

    def verdict(text: str | None) -> tuple[str, float, float, bool]:
        known = compressors and text is not None and any(map(str.isalpha, text))
        return classify(text.lower().encode(), compressors, margin) if known else (UNKNOWN, 0.0, 0.0, True)

    return verdict


def predictions(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text",
                margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected) per row. Texts that are null or have no letter, and all texts
    where no language was learned, are ``und`` with score 0 and rejected."""
    ship(docs.sparkSession)
    names = ["doc_id", "lang_pred", "score", "margin", "rejected"]
    kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]

    def run(batches):
        verdict = classifier(model, margin)
        for b in batches:
            out = [verdict(t.as_py()) for t in b.column(1)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                                             names=names)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, margin double, rejected boolean")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
             margin: float = MARGIN) -> DataFrame:
    """Learns from the rows that aren't held out and predicts every row: doc_id, held_out, lang_pred, score, margin,
    rejected. Whole texts are compressed, very long ones block by block; other columns aren't read; repeated rows come out
    alike; an empty table gives no rows."""
    model = learn(docs, doc_id, text, lang)
    return predictions(docs, model, doc_id, text, margin).select(
        "doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score", "margin", "rejected")


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                    margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is told; rejected ones go, and so do null texts and those without a
    letter. Repeated rows stay repeated; an empty table gives no rows."""
    ship(docs.sparkSession)
    model = learn(docs, doc_id, text, lang)

    @F.arrow_udf("boolean")
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        verdict = classifier(model, margin)
        for texts in batches:
            yield pa.array([not verdict(t.as_py())[3] for t in texts], pa.bool_())

    return docs.where(told(F.col(text).cast("string")))  # rows stay in the JVM: only texts go out and verdicts come in
