"""Quality rules with adaptive thresholds (operator 1), built-in functions only.

1. ``measures``: whole-text counts per row, computed with array and string functions.
2. ``sketches``: per (language, source) and measure a mergeable quantile sketch: counts per logarithmic bucket with
   ``2**BITS`` steps per power of two (values below that are exact, others within ``2**-BITS``). Sketches merge by
   adding counts, so one pass over the rows makes the finest level and the coarser levels come from it.
3. ``thresholds``: upper and lower fences from each sketch's outer deciles and its own spread between them. A decile is
   drawn in to the other one's distance from the median (or the floor, if that is more), so that junk on one side moves no
   fence while it is less than half. A (language, source) group with fewer than ``min_rows`` rows uses its language's
   merged sketch, a small language the sketch of all rows.
4. ``judge``: the rows joined with their group's fences.

A hot source is one partly aggregated row per task and bucket; the join's other side is a handful of rows per group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ladder.llm.common import GAP, GAP_CHARS, Scratch

SYMBOLS = "#*$%&|<>"
BITS = 5


@dataclass(frozen=True)
class Rule:
    """A measure is out of bounds beyond the outer decile on the given side by more than ``width`` times the group's
    spread (the range between its outer deciles), or by more than ``floor`` where that is wider: in groups whose rows are
    nearly all alike, as for measures that are 0 in most texts. A decile farther from the median than both the other one
    and the floor is first drawn in to that distance."""

    measure: str
    side: str
    floor: int


#: Measures are whole numbers (per mille, or hundredths of a character), and so are floors.
RULES = (
    Rule("symbols_pm", "high", 60),
    Rule("capitals_pm", "high", 16),
    Rule("repeats_pm", "high", 300),
    Rule("dup_lines_pm", "high", 400),
    Rule("word_len_pc", "high", 60),
    Rule("word_len_pc", "low", 60),
)
WIDTH = 3
MIN_ROWS = 100
MIN_WORDS = 50


def words_of(text: Column) -> Column:
    """The words of a text; none for null, empty and blank ones."""
    inner = F.btrim(text, F.lit(GAP_CHARS))
    return F.when(F.coalesce(F.length(inner), F.lit(0)) > 0, F.split(inner, GAP)).otherwise(F.array().cast("array<string>"))


def _repeated(grams: str) -> Column:
    """Number of words that lie in a 3-word window found twice or more. ``grams`` is the sorted array of
    (window, position): equal windows are neighbours."""
    g = F.col(grams)
    twice = F.filter(g, lambda x, i: (F.get(g, i - 1)["g"] == x["g"]) | (F.get(g, i + 1)["g"] == x["g"]))
    spots = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return F.size(F.array_distinct(spots)).cast("long")


def measures(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts and measures to ``rows``, whose columns must not have their names; ``text`` is dropped.

    Null, empty and blank texts have no words: all counts are 0.
    """
    keep = [c for c in rows.columns if c != text]
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.translate(t, GAP_CHARS, "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(GAP_CHARS))) > 0)
    step = rows.select(
        *keep, words_of(F.col(text)).alias("_words"), lines.alias("_lines"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(bare, r"\P{Lu}+", "")).cast("long").alias("n_capitals"))
    w = F.col("_words")
    grams = F.when(F.size(w) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))))
    step = step.select(
        *keep, "word_chars", "n_symbols", "n_capitals", F.size(w).cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.coalesce(grams, F.array().cast("array<struct<g:string,i:int>>"))).alias("_grams"))
    step = step.withColumn("n_repeat_words", _repeated("_grams")).drop("_grams")
    per = lambda a, b, k: F.coalesce(F.expr(f"{k} * {a} div nullif({b}, 0)"), F.lit(0)).cast("long")
    return step.select(
        "*",
        per("n_symbols", "word_chars", 1000).alias("symbols_pm"),
        per("n_capitals", "word_chars", 1000).alias("capitals_pm"),
        per("n_repeat_words", "n_words", 1000).alias("repeats_pm"),
        per("n_dup_lines", "n_lines", 1000).alias("dup_lines_pm"),
        per("word_chars", "n_words", 100).alias("word_len_pc"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"))


def bucket(value: Column) -> Column:
    """The least value of a value's logarithmic bucket: its leading ``BITS + 1`` binary digits."""
    drop = F.greatest(F.length(F.bin(value)) - (BITS + 1), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(measured: DataFrame, lang: str, source: str) -> DataFrame:
    """(lang, source, level, measure, bucket, n). Level 0: by language and source, 1: by language, 2: all rows.
    Rows that fail the base rules don't shape the thresholds. Null languages and sources are groups of their own."""
    names = sorted({r.measure for r in RULES})
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in names]))
    finest = (measured.where(~F.col("base_failed"))
              .select(F.col(lang).alias("lang"), F.col(source).alias("source"), pairs.alias("p"))
              .groupBy("lang", "source", "p.measure", "p.bucket").agg(F.count("*").alias("n")))
    levels = F.explode(F.array(*[F.lit(i) for i in range(3)]))
    return (finest.select("*", levels.alias("level"))
            .select("level", "measure", "bucket", "n",
                    F.when(F.col("level") <= 1, F.col("lang")).alias("lang"),
                    F.when(F.col("level") == 0, F.col("source")).alias("source"))
            .groupBy("level", "lang", "source", "measure", "bucket").agg(F.sum("n").alias("n")))


def fence_sql(rule: Rule, width: int = WIDTH) -> str:
    """The rule's fence from d1, mid and d9 (the deciles and the median of its measure)."""
    upper = f"least(d9, mid + greatest(mid - d1, {rule.floor}))"
    lower = f"greatest(d1, mid - greatest(d9 - mid, {rule.floor}))"
    margin = f"greatest({width} * ({upper} - {lower}), {rule.floor})"
    return f"{upper} + {margin}" if rule.side == "high" else f"{lower} - {margin}"


def thresholds(sketch: DataFrame, min_rows: int = MIN_ROWS, width: int = WIDTH) -> DataFrame:
    """One row per (lang, source) with ``low_<measure>`` and ``high_<measure>`` from the finest level that has
    ``min_rows`` rows (or else that of all rows)."""
    group = ["level", "lang", "source", "measure"]
    running = Window.partitionBy(*group).orderBy("bucket")
    ranked = (sketch.withColumn("upto", F.sum("n").over(running.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("total", F.sum("n").over(Window.partitionBy(*group))))
    # A decile is the first bucket whose running count reaches its share of the rows.
    fences = ranked.groupBy(*group).agg(
        F.min(F.when(10 * F.col("upto") >= F.col("total"), F.col("bucket"))).alias("d1"),
        F.min(F.when(2 * F.col("upto") >= F.col("total"), F.col("bucket"))).alias("mid"),
        F.min(F.when(10 * F.col("upto") >= 9 * F.col("total"), F.col("bucket"))).alias("d9"),
        F.max("total").alias("rows"))
    aggs = []
    for r in RULES:
        aggs.append(F.max(F.when(F.col("measure") == r.measure, F.expr(fence_sql(r, width)))).alias(f"{r.side}_{r.measure}"))
    wide = fences.groupBy("level", "lang", "source").agg(F.max("rows").alias("rows"), *aggs)
    edges = F.struct("rows", *[f"{r.side}_{r.measure}" for r in RULES])
    fine, by_lang, every = (wide.where(F.col("level") == i) for i in range(3))
    fine = fine.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), edges.alias("e0"))
    by_lang = by_lang.select(F.col("lang").alias("l_lang"), edges.alias("e1"))
    joined = (fine.join(by_lang, F.col("g_lang").eqNullSafe(F.col("l_lang")), "left").drop("l_lang")
              .withColumn("e2", every.select(edges).scalar()))
    use = (F.when(F.col("e0.rows") >= min_rows, F.col("e0"))
           .when(F.col("e1.rows") >= min_rows, F.col("e1")).otherwise(F.col("e2")))
    return joined.select("g_lang", "g_source", use.alias("fence"))


def judge(measured: DataFrame, edges: DataFrame, lang: str, source: str) -> DataFrame:
    """Adds ``failed_rules`` (names, in the order of RULES) and ``kept``. A row whose group has no fences (every row of it failed
    the base rules) is judged by the base rules alone."""
    on = F.col(lang).eqNullSafe(F.col("g_lang")) & F.col(source).eqNullSafe(F.col("g_source"))
    broken = [
        F.when(F.col(r.measure) > F.col(f"fence.high_{r.measure}") if r.side == "high"
               else F.col(r.measure) < F.col(f"fence.low_{r.measure}"), F.lit(f"{r.side}_{r.measure}"))
        for r in RULES]
    failed = F.concat_ws(",", *broken)
    return (measured.join(edges, on, "left").withColumn("failed_rules", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))
            .drop("g_lang", "g_source", "fence"))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                  source: str = "source", min_rows: int = MIN_ROWS, width: int = WIDTH) -> DataFrame:
    """One row per input row: ``doc_id``, the counts, ``base_failed``, ``kept``, ``failed_rules``, the measures.

    The measures (a few numbers per row) are written once to the shared folder, so the texts are read once.
    Nulls: a null text has no words and fails the base rules; null languages and sources form their own groups.
    Repeated rows are judged alike; other columns of the input are not read; an empty table gives an empty result. A very
    long text is measured whole, as one row, in memory proportional to it.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("_lang"), F.col(source).alias("_source"),
                       F.col(text).alias("text"))
    scratch = Scratch(docs.sparkSession, "quality")
    measured = scratch.table(measures(rows))
    edges = scratch.table(thresholds(sketches(measured, "_lang", "_source"), min_rows, width))
    judged = judge(measured, edges, "_lang", "_source")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept", "failed_rules", *sorted({r.measure for r in RULES}))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
              min_rows: int = MIN_ROWS, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns whatever their names.

    The rows are written once with their measures, so the texts are measured once, no row key is needed and repeated
    rows stay repeated.
    """
    rows = docs.select(F.struct("*").alias("_row"), F.col(lang).alias("_lang"), F.col(source).alias("_source"),
                       F.col(text).alias("text"))
    scratch = Scratch(docs.sparkSession, "quality")
    measured = scratch.table(measures(rows))
    edges = scratch.table(thresholds(sketches(measured, "_lang", "_source"), min_rows, width))
    return judge(measured, edges, "_lang", "_source").where("kept").select("_row.*")
