import hashlib
import random

import numpy as np
import pytest
from llm_support import odd_rows, prose

from ladder.llm import winnowing


def brute_winnow(text, k, window):
    h = winnowing.gram_hashes(winnowing.code_points(text), k).tolist()
    chosen = []
    for i in range(max(0, len(h) - min(window, len(h)) + 1) if h else 0):
        w = h[i:i + window]
        best = max(j for j in range(len(w)) if w[j] == min(w))
        if not chosen or chosen[-1] != i + best:
            chosen.append(i + best)
    return chosen, [h[i] for i in chosen]


def test_gram_hashes_depend_on_the_gram_alone():
    text = prose(4, 50) + "é漢"
    whole = winnowing.gram_hashes(winnowing.code_points(text), 7)
    assert len(whole) == len(text) - 6
    for i in range(0, len(whole), 11):
        assert winnowing.gram_hashes(winnowing.code_points(text[i:i + 7]), 7).tolist() == [whole[i]]


def test_winnow_equals_brute_force():
    r = random.Random(3)
    for n in (0, 1, 5, 15, 16, 17, 40, 47, 48, 200, 1000):
        for alphabet in ("a", "ab", "abcdefgh é漢"):
            text = "".join(r.choices(alphabet, k=n))
            for k, window in ((16, 32), (3, 5), (1, 1), (4, 7)):
                p, h = winnowing.winnow(text, k, window)
                assert (p.tolist(), h.tolist()) == brute_winnow(text, k, window)


def test_shared_runs_of_the_guaranteed_length_are_found():
    r = random.Random(9)
    for s in range(40):
        run = "".join(r.choices("abcdef ", k=47))
        a, b = prose(s, 30) + run + prose(s + 1, 30), prose(s + 2, 20) + run + prose(s + 3, 9)
        assert set(winnowing.winnow(a)[1].tolist()) & set(winnowing.winnow(b)[1].tolist())


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (i, t), (_, f) in zip(order, order[1:] + order[:1], strict=True):
        t, f = t or "", f or ""
        edited = t[:len(t) - len(t) // 3] + f[:len(t) // 3]
        sets = [set(winnowing.winnow(x)[1].tolist()) for x in (t, edited, f)]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), winnowing.digest_of(*winnowing.winnow(t)),
                    winnowing.digest_of(*winnowing.winnow(edited)), like(sets[0], sets[1]), like(sets[0], sets[2])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 4, 31])
def test_compare_with_next_equals_brute_force(spark, small, parts):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    rows += [(-1, None), (-2, ""), (None, prose(1, 40)), (10**9, "short")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, part string, h int").repartition(5)
    got = winnowing.compare_with_next(df, parts=parts).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_odd_rows(spark, odd, none):
    got = winnowing.compare_with_next(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_chars) for r in got if r.doc_id is not None) == sorted(
        (False, r[0], len(r[1] or "")) for r in odd_rows() if r[0] is not None)
    same = {r.fingerprint for r in got if r.doc_id == 1}
    assert len(got) == len(odd_rows()) and len(same) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert winnowing.compare_with_next(none).count() == 0
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert winnowing.compare_with_next(one).first().edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_fingerprints_keep_positions(odd, none):
    for r in winnowing.fingerprints(odd).collect():
        assert len(r.positions) == len(r.hashes) and r.positions == sorted(set(r.positions))
    assert winnowing.fingerprints(none).count() == 0
    assert winnowing.likeness(np.array([]), np.array([])) == 1.0
