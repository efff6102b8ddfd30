import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from llm_support import odd_rows, prose

from ladder.llm import runs
from ladder.llm.queries import QUERIES


def brute_runs(w):
    """Every lag: stretches of words equal to the word that far before; the smallest lag names the period."""
    found, out = {}, []
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(6, 4 * q) and not any(q % d == 0 and all(w[k] == w[k - d] for k in range(start + d, start + length))
                                                   for d in range(1, q)):
                found[start, q] = length
            i = j
    out = sorted(((s, n, q) for (s, q), n in found.items()), key=lambda r: (r[0], r[2]))
    return out


def planted(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    w = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found = brute_runs(w)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    return (doc_id, len(found), *top, None if top[0] is None else 1000 * top[1] // top[2],
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def words_with_runs(r, n):
    out = []
    while len(out) < n:
        q = r.choice([1, 2, 3, 4, 6, 7, 8, 9, 12, 15, 16, 17, 31, 32, 33, 40, 64, 65, 100])
        word = [r.randint(0, r.choice([1, 2, 9, 99])) for _ in range(q)]
        out += (word * 8)[:r.randint(q, 7 * q)]
        out += [r.randint(0, 99) for _ in range(r.randint(0, 6))]
    return out


def test_runs_equal_brute_force():
    r = random.Random(5)
    texts = [words_with_runs(r, r.choice([10, 100, 500])) for _ in range(300)]
    texts += [[r.randint(0, 1) for _ in range(r.randint(0, 80))] for _ in range(400)] + [[], [0] * 5, [0] * 6, [0, 1] * 300]
    got = runs.find_runs([np.array(t, dtype=np.int64) for t in texts])
    assert got == [brute_runs(t) for t in texts]


@pytest.mark.parametrize("q", [9, 16, 17, 100, 127, 128, 129, 250])
def test_long_periods_at_the_least_length(q):
    r = random.Random(q)
    word = [r.randint(0, 3) for _ in range(q)]
    for cut in (0, 1):
        text = [1000 + r.randint(0, 5) for _ in range(37)] + (word * 4)[:4 * q - cut] + [2000]
        assert runs.find_runs([np.array(text)])[0] == brute_runs(text)
        assert bool([x for x in brute_runs(text) if x[2] == q]) == (cut == 0)


def test_minimizers_are_the_rightmost_least():
    r = random.Random(9)
    for w in (1, 2, 8):
        h = np.array([r.randint(0, 5) << 40 for _ in range(60)], dtype=np.uint64)
        want = {max(i for i in range(k, k + w) if h[i] == h[k:k + w].min()) for k in range(len(h) - w + 1)}
        assert runs.minimizers(h, w).tolist() == sorted(want)


def test_query_equals_brute_force(spark, small, tmp_path):
    base = prose(4, 40)
    rows = [(i, prose(i, 30 + 7 * i % 400)) for i in range(3000, 3120)] + [
        (r[0], r[1]) for r in odd_rows()] + [(7000, " ".join([base] * 9)), (7001, " ".join([base] * 9)), (7002, "a " * 50_000)]
    where = str(tmp_path)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, runs string")
    docs.repartition(3).write.parquet(f"{where}/documents.parquet")
    got = QUERIES["op13_periodic_runs"](spark, where).select(*COLUMNS).collect()
    # the longest text by itself: all its words are equal
    want = [expected(*r) for r in rows if r[0] != 7002]
    assert sorted((tuple(r) for r in got if r.doc_id != 7002), key=repr) == sorted(want, key=repr)
    one = next(r for r in got if r.doc_id == 7002)
    assert (one.n_runs, one.start, one.length, one.period) == (1, 0, 50_000, 1)
    assert one.collapsed_sha256 == hashlib.sha256(b"a").hexdigest()
    assert any(r.n_runs for r in got) and any(r.period and r.period > 30 for r in got)
    whole = QUERIES["op13_periodic_runs"](spark, "/root/testdata/sf0.001").select(*COLUMNS).collect()
    want = [expected(r.doc_id, r.text) for r in small.collect() if len(r.text or "") < 20_000]
    ids = {w[0] for w in want}
    assert sorted((tuple(r) for r in whole if r.doc_id in ids), key=repr) == sorted(want, key=repr)


def test_empty_table_and_texts(none):
    assert runs.run_report(runs.periodic_runs(none)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(none, repeats=2)
