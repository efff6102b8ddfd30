import random
import re
from collections import Counter

import duckdb
import pytest
from llm_support import odd_rows, rows_of

from ladder.llm import phrases
from ladder.llm.queries import ORACLE_SQL, op11_collocations


def brute(rows, least, top, cover=80):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i:i + m])) for m in range(1, 5) for i in range(len(w) - m + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    held = Counter()
    for (lang, w), a in candidates.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                held[lang, w[i:i + m]] = max(held[lang, w[i:i + m]], a)
    by = {}
    for (lang, w), a in candidates.items():
        if 100 * held[lang, w] >= cover * a:
            continue
        s, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]])
                         for k in range(1, len(w)))
        by.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, total[lang], -s) for lang, found in by.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def texts(seed, n, vocabulary):
    r = random.Random(seed)
    known = ["w%d" % i if i % 7 else "é%d" % i for i in range(vocabulary)]
    fixed = [r.choices(known, k=r.randint(2, 6)) for _ in range(25)]
    out = []
    for _ in range(n):
        words = []
        for _ in range(r.randint(0, 40)):
            words += r.choice(fixed) if r.random() < 0.5 else [r.choices(known, weights=[1 / (i + 1) for i in range(vocabulary)])[0]]
        out.append("".join(w.upper() + r.choices([" ", ", ", ".", "\t", "  ", "\n"], [20, 1, 1, 1, 1, 1])[0] for w in words))
    return out


@pytest.mark.parametrize("least,top,first,growth,bits", [(2, 15, 1, 2, 1 << 24), (3, 40, 1, 8, 64), (5, 4, 2, 8, 1 << 16),
                                                         (2, 100_000, 2, 8, 1 << 20)])
def test_equals_counting_everything(spark, least, top, first, growth, bits):
    rows = [(("en", "de", None)[i % 5 % 3], t) for i, t in enumerate(texts(least * top, 300, 120))]
    docs = spark.createDataFrame([(*r, "q", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(3)
    got = phrases.collocations(docs, least=least, top=top, first=first, growth=growth, bits=bits)
    assert sorted(map(tuple, got.collect())) == brute(rows, least, top)


def test_levels_fall_until_enough_survive(spark, monkeypatch):
    # Nearly all pairs lie inside phrases of four words and are dropped: the first levels don't give enough.
    seen = []
    old = phrases.counts

    def spy(docs, frequent=None, *more, **named):
        seen.append(frequent is None)
        return old(docs, frequent, *more, **named)

    monkeypatch.setattr(phrases, "counts", spy)
    rows = [("en", f"a{i} b{i} c{i} d{i}. x{i % 9} y{i % 5}") for i in range(60)] * 3
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = phrases.collocations(docs, least=2, top=70, first=1, growth=2)
    assert sorted(map(tuple, got.collect())) == brute(rows, 2, 70)
    assert seen[0] and sum(not s for s in seen) > 1


def test_bounds_hold(spark):
    docs = spark.createDataFrame([("en", t) for t in texts(3, 200, 60)], "lang string, text string")
    grams = phrases.counts(docs).cache()
    reach = {r.phrase: (r.reach, r.score) for r in phrases.scored_pairs(grams).collect()}
    assert all(s <= up for up, s in reach.values())
    for _, _, p, *_, s in brute([("en", r.text) for r in docs.collect()], 2, 10**6):
        w = p.split(" ")
        assert s <= min(reach[" ".join(w[:2])][0], reach[" ".join(w[-2:])][0])


def test_filter_places_agree(spark):
    from pyspark.sql import functions as F

    rows = [("en", "the", "cat"), ("fr", "é", "漢字"), ("", "a", "a")]
    df = spark.createDataFrame(rows, "lang string, x string, y string")
    got = [r[0] for r in df.select(phrases.pair_place(F.col("lang"), F.col("x"), F.col("y"), 1 << 20)).collect()]
    for (lang, x, y), place in zip(rows, got, strict=True):
        import numpy as np

        h = phrases._word_hashes(lang, [x.encode(), y.encode()])
        assert int(phrases._places(h, np.array([0]), np.array([1]), 1 << 20)[0]) == place


def test_large_counts_are_exact(spark):
    a, b = 4_611_686_018_427_387_000, 4_611_686_018_427_387_903
    got = spark.createDataFrame([(a, b)], "a long, b long").select(phrases.score("a", "b").alias("s")).first().s
    assert got == 2_000_000 * a // b


def test_odd_rows_and_empty(spark, odd, none):
    got = phrases.collocations(odd, least=3, top=50)
    assert sorted(map(tuple, got.collect())) == brute([(r[2], r[1]) for r in odd_rows()], 3, 50)
    assert phrases.collocations(none).count() == 0


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = duck.sql(ORACLE_SQL["op11_collocations"])
    got = rows_of(op11_collocations(spark, sf).select(*rel.columns))
    assert got == sorted(rel.fetchall(), key=repr) and got
