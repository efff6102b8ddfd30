import zlib

from llm_support import odd_rows, rows_of

from ladder.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert set(held) == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(got[i].lang_pred == truth[i] for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and 0 <= r.margin <= 1 for r in got.values())
    assert sum(r.rejected for r in got.values()) < 0.02 * len(got)


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = rows_of(langid.identify(docs))
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(langid.is_held_out("doc_id"), F.lit("zz")).otherwise(F.col("lang"))).withColumn(
        "source", F.lit("?"))
    assert rows_of(langid.identify(other)) == before


def test_odd_rows(spark, odd, none):
    got = langid.identify(odd).collect()
    assert len(got) == len(odd_rows())
    letters = {r[0]: any(map(str.isalpha, r[1] or "")) for r in odd_rows() if r[0] not in (None, 2)}
    for r in got:
        if r.doc_id in letters:
            assert (r.lang_pred == "und") == (not letters[r.doc_id])
            assert r.lang_pred in ("und", "en", "de") and (r.score == 0) == (r.lang_pred == "und")
    assert langid.identify(none).count() == 0
    unlabelled = odd.drop("lang").selectExpr("*", "cast(null as string) lang")
    assert {(r.lang_pred, r.score) for r in langid.identify(unlabelled).collect()} == {("und", 0.0)}


def test_narrow_margins_are_rejected(spark):
    model = langid.Model({"a": b"ab cd ef gh " * 50, "b": b"ij kl mn op " * 50})
    rows = [(1, "ab cd ef gh ef cd ab gh"), (2, "ij kl mn op mn kl ij"), (3, "zz yy xx ww"), (4, "12 34"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predictions(docs, model).collect()}
    assert got[1].lang_pred == "a" and got[2].lang_pred == "b" and not got[1].rejected and not got[2].rejected
    assert got[3].rejected and got[4].lang_pred == "und" and got[5].rejected


def test_keep_identified_keeps_all_columns(odd, none):
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns
    assert kept.count() == langid.identify(odd).where("NOT rejected").count()
    assert langid.keep_identified(none).count() == 0


def test_rows_without_letters_take_no_place_in_the_sample(spark):
    # Some 40 documents of 'aa' among 20,000 rows of it without letters: all 40 are learned from.
    from llm_support import prose

    rows = [(i, prose(i, 40), "aa") for i in range(60)] + [(100 + i, "12 34" if i % 2 else None, "aa") for i in range(30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = [t for i, t, _ in rows[:60] if zlib.crc32(str(i).encode()) % 3 != 1]
    dictionary = langid.learn(docs).dictionaries["aa"].decode()
    assert sorted(dictionary.split("\n")) == sorted(t.lower() for t in learned)


def test_dictionaries_hold_the_whole_sample(spark):
    from llm_support import prose

    # 256 texts of 1,024 code points of two to four bytes: about three quarters of a megabyte.
    letters = dict(zip("abcdeéñß", "яжд語文字𐐨𐐩"))
    rows = [(i, "".join(letters.get(c, c) for c in prose(i, 400))[:1024], "aa") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    parts = langid.learn(docs).dictionaries["aa"].decode().split("\n")
    assert len(parts) == langid.SAMPLE_DOCS and {len(p) for p in parts} == {1024}
    assert set(parts) <= {t.lower() for _, t, _ in rows}


def test_predictions_equal_plain_compression(spark, small):
    """Every row by brute force: each 2 KiB block compressed with each language's dictionary, one after another."""
    import zstandard as zstd

    model = langid.learn(small)
    got = {r.doc_id: r for r in langid.predictions(small, model).collect()}
    for r in small.collect():
        data = (r.text or "").lower().encode()
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == "und"
            continue
        sizes = []
        for name in sorted(model.dictionaries):
            c = zstd.ZstdCompressor(level=9, dict_data=zstd.ZstdCompressionDict(model.dictionaries[name], dict_type=zstd.DICT_TYPE_RAWCONTENT),
                                    write_content_size=False)
            sizes.append((sum(len(c.compress(data[i:i + 2048])) for i in range(0, len(data), 2048)), name))
        best, second = sorted(sizes)[:2]
        row = got[r.doc_id]
        assert row.lang_pred == best[1]
        assert row.rejected == ((second[0] - best[0]) / second[0] < 0.002)
        assert abs(row.score - 1 / sum(2.0 ** -min(s - best[0], 64) for s, _ in sizes)) < 1e-12


def test_the_sample_is_the_smallest_hashes(spark, small):
    """What is learned, by brute force: Spark's own hash of (doc_id, text), ranked in Python."""
    from pyspark.sql import functions as F

    rows = small.select("doc_id", "text", "lang", F.xxhash64("doc_id", "text").alias("h")).collect()
    want = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang and any(c.isalpha() for c in r.text or ""):
            want.setdefault(r.lang, []).append((r.h % (1 << 40), r.h, r.text[:100]))
    model = langid.learn(small, sample_docs=5, sample_chars=100)
    for lang, texts in want.items():
        assert model.dictionaries[lang] == b"\n".join(t.lower().encode() for *_, t in sorted(sorted(texts)[:5], reverse=True))


def test_rare_languages_and_many_of_them(spark):
    from llm_support import prose

    rows = [(i, prose(i % 50, 30), "en") for i in range(3000)] + [(10_000 + i, prose(i, 30), f"l{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert list(langid.learn(docs, rarest=100).dictionaries) == ["en"]
    assert len(langid.learn(docs).dictionaries) > 100


def test_a_very_long_text(spark, small):
    text = " ".join(r.text for r in small.where("lang = 'de'").collect())
    text = text * (3_000_000 // len(text) + 1)
    docs = small.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(10**9, text, None)], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langid.identify(docs).where("doc_id = 1000000000").collect()} == {"de"}
