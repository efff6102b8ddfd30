"""The registered queries of this package and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladder.llm import (
    bpe,
    exact,
    langid,
    licenses,
    packing,
    phrases,
    quality,
    runs,
    sharding,
    simhash,
    token_counts,
    warc,
    winnowing,
)
from ladder.llm.common import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))


def op3_edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.edited_counts(read(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_with_next(read(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(read(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.decode(bpe.encode(read(spark, sf_dir, "documents")))
    return decoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(read(spark, sf_dir, "documents"), digest_all=True)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(runs.periodic_runs(runs.with_planted_runs(read(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_license_scan, op3_edited_token_counts, op4_simhash_near_dedup, op5_best_fit_packing,
    op6_winnowing, op7_warc, op8_byte_bpe, op9_uniform_shards, op10_language_id, op11_collocations,
    op12_exact_dedup, op13_periodic_runs)}

_WORD = r"[^\x20\x09-\x0D]"


def _fence(rule: quality.Rule) -> str:
    """The rule's fence, told case by case: on which side the decile lies far out, and whether the spread is wide."""
    up = f"CASE WHEN high - mid > mid - low AND high - mid > {rule.floor} THEN mid + greatest(mid - low, {rule.floor}) ELSE high END"
    down = f"CASE WHEN mid - low > high - mid AND mid - low > {rule.floor} THEN mid - greatest(high - mid, {rule.floor}) ELSE low END"
    wide = f"CASE WHEN {quality.WIDTH} * (({up}) - ({down})) > {rule.floor} THEN {quality.WIDTH} * (({up}) - ({down})) ELSE {rule.floor} END"
    return f"({up}) + {wide}" if rule.side == "high" else f"({down}) - {wide}"


def _quality_sql() -> str:
    """The rules as one statement: quantile sketches as bucket counts, merged by sums."""
    names = sorted({r.measure for r in quality.RULES})
    bits = quality.BITS + 1
    fence = {f"{r.side}_{r.measure}": f"max(CASE WHEN measure = '{r.measure}' THEN {_fence(r)} END)" for r in quality.RULES}
    fences = ", ".join(f"{v} AS {k}" for k, v in fence.items())
    pick = ", ".join(f"CASE WHEN e0.n >= {quality.MIN_ROWS} THEN e0.{k} WHEN e1.n >= {quality.MIN_ROWS} THEN e1.{k} "
                     f"ELSE e2.{k} END AS {k}" for k in fence)
    failed = ", ".join(f"CASE WHEN {r.measure} {'>' if r.side == 'high' else '<'} {r.side}_{r.measure} "
                       f"THEN '{r.side}_{r.measure}' END" for r in quality.RULES)
    pairs = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM m WHERE NOT base_failed"
                               for m in names)
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
    s AS (SELECT *, regexp_extract_all(t, '{_WORD}+') AS ws,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
    g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
          FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM s WHERE len(ws) >= 3)),
    twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n >= 2),
    rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r),
    c AS (SELECT s.r, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
                 CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
                 CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                 CAST(length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS BIGINT) AS n_capitals,
                 CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
                 CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
          FROM s LEFT JOIN rep ON rep.r = s.r),
    m AS (SELECT *, coalesce(1000 * n_symbols // nullif(word_chars, 0), 0) AS symbols_pm,
                 coalesce(1000 * n_capitals // nullif(word_chars, 0), 0) AS capitals_pm,
                 coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) AS repeats_pm,
                 coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) AS dup_lines_pm,
                 coalesce(100 * word_chars // nullif(n_words, 0), 0) AS word_len_pc,
                 n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
    b AS (SELECT lang, source, measure, (v >> k) << k AS bucket, count(*) AS n
          FROM (SELECT *, greatest(length(bin(v)) - {bits}, 0) AS k FROM ({pairs})) GROUP BY ALL),
    sk AS (SELECT level, CASE WHEN level <= 1 THEN lang END AS lang, CASE WHEN level = 0 THEN source END AS source,
                  measure, bucket, sum(n) AS n FROM b, (VALUES (0), (1), (2)) AS l(level) GROUP BY ALL),
    cum AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto,
                   sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM sk),
    q AS (SELECT level, lang, source, measure, min(bucket) FILTER (WHERE upto >= 0.1 * total) AS low,
                 min(bucket) FILTER (WHERE upto >= 0.5 * total) AS mid, min(bucket) FILTER (WHERE upto >= 0.9 * total) AS high,
                 max(total) AS n FROM cum GROUP BY ALL),
    e AS (SELECT level, lang, source, max(n) AS n, {fences} FROM q GROUP BY ALL),
    f AS (SELECT e0.lang AS g_lang, e0.source AS g_source, {pick} FROM e e0
          JOIN e e1 ON e1.level = 1 AND e1.lang IS NOT DISTINCT FROM e0.lang JOIN e e2 ON e2.level = 2
          WHERE e0.level = 0),
    v AS (SELECT m.*, concat_ws(',', {failed}) AS failed_rules FROM m LEFT JOIN f
          ON m.lang IS NOT DISTINCT FROM g_lang AND m.source IS NOT DISTINCT FROM g_source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND failed_rules = '' AS kept, failed_rules, {", ".join(names)} FROM v"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_sql() -> str:
    spelling = ", ".join(f"'{a}': '{b}'" for a, b in licenses.SPELLINGS.items())
    known = ", ".join(f"('{k}', {_quoted(t)})" for k, t in licenses.KNOWN)

    def digest(text: str) -> str:
        plain = (f"trim(regexp_replace(regexp_replace(lower({text}), '{licenses.COPYRIGHT_LINE}', ' ', 'g'), "
                 r"'[^\p{L}\p{N}]+', ' ', 'g'))")
        words = f"list_transform(string_split({plain}, ' '), lambda w: coalesce(MAP {{{spelling}}}[w], w))"
        return f"CASE WHEN length({plain}) > 0 THEN sha256(array_to_string({words}, ' ')) END"

    return f"""
    WITH k AS (SELECT {digest("t")} AS digest, min(id) AS id FROM (VALUES {known}) AS known(id, t) GROUP BY 1),
    d AS (SELECT row_number() OVER () AS r, doc_id, text, {digest("text")} AS digest FROM documents),
    l AS (SELECT r, {digest("line")} AS digest FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
    n AS (SELECT r, array_to_string(list_sort(list_distinct(list(id))), ',') AS notice_ids
          FROM l JOIN k USING (digest) GROUP BY r)
    SELECT doc_id, d.digest, k.id AS license_id, notice_ids
    FROM d LEFT JOIN k ON k.digest = d.digest LEFT JOIN n ON n.r = d.r"""


def _warc_sql() -> str:
    nibbles = ", ".join(f"'{i:04b}'" for i in range(16))
    fives = ", ".join(f"'{i:05b}'" for i in range(32))
    bits = f"array_to_string(list_transform(string_split(h, ''), lambda c: [{nibbles}][strpos('0123456789abcdef', c)]), '')"
    return f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
    h AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha1(t) AS h FROM p),
    b AS (SELECT *, {bits} AS bits, min(page_id) OVER (PARTITION BY h) AS first FROM h)
    SELECT page_id, payload_bytes,
           array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               list_position([{fives}], substr(bits, CAST(5 * i + 1 AS INTEGER), 5)), 1)), '') AS payload_digest,
           CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END
               AS record_type,
           CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM b"""


def _phrases_sql() -> str:
    """Every phrase of up to four words counted, every cut scored, every longer phrase compared."""
    lower = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return rf"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({lower}, '[.,;:!?\x0A-\x0D]')) AS t
               FROM documents),
    w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS ws FROM p),
    g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase
          FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), (VALUES (1), (2), (3), (4)) AS s(m)
          WHERE i + m - 1 <= len(ws)),
    f AS (SELECT lang, m, phrase, count(*) AS f, string_split(phrase, ' ') AS ws FROM g GROUP BY ALL),
    c AS (SELECT * FROM f WHERE m >= 2 AND f >= {phrases.LEAST}),
    cuts AS (SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r,
                    CAST(CAST(2000000 AS HUGEINT) * c.f // (l.f + r.f) AS BIGINT) AS score
             FROM (SELECT *, unnest(range(1, m)) AS k FROM c) AS c
             JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:k], ' ')
             JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[k + 1:c.m], ' ')),
    best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    held AS (SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, max(f) AS f
             FROM (SELECT *, unnest(range(1, 4)) AS i FROM c), (VALUES (2), (3)) AS s(k)
             WHERE k < m AND i + k - 1 <= m GROUP BY ALL),
    kept AS (SELECT best.* FROM best LEFT JOIN held USING (lang, phrase)
             WHERE held.f IS NULL OR 100 * held.f < {phrases.COVER} * a),
    total AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN total USING (lang)
    WHERE rank <= {phrases.TOP}"""


_EXACT_SQL = """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
    n AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id DESC NULLS LAST) AS place,
                 max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d)
    SELECT doc_id, keep_id, group_size, place = 1 AS kept, h AS text_sha256 FROM n"""


#: DuckDB SQL by query. The others need a hash, a tokeniser, zstandard or random draws that SQL lacks; the tests hold
#: them against brute force, round trips and held-out accuracy.
ORACLE_SQL = {
    "op1_quality_rules": _quality_sql(),
    "op2_license_scan": _license_sql(),
    "op7_warc": _warc_sql(),
    "op11_collocations": _phrases_sql(),
    "op12_exact_dedup": _EXACT_SQL,
}
