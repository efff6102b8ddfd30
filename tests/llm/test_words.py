import random
import re

import numpy as np
import pyarrow as pa

from ladder.llm.words import Words, groups, joined, ragged


def test_words_equal_a_regular_expression():
    r = random.Random(3)
    for _ in range(60):
        texts = ["".join(r.choices(["a", "b", "é", " ", "\n", "\t", "\x1c", "\x85", "漢"], k=r.randint(0, 12))) for _ in range(r.randint(0, 9))]
        texts = [None if t == "a" else t for t in texts]
        w = Words(*joined(pa.array([None if t is None else t.encode() for t in texts], pa.binary())))
        spelt = [x.decode() for x in w.spellings.to_pylist()]
        got = [[spelt[c] for c in w.codes[a:b]] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_slices_of_an_array():
    a = pa.array([b"x y", b"z", None, b"u  v"], pa.binary()).slice(1)
    w = Words(*joined(a))
    assert w.first.tolist() == [0, 1, 1, 3] and len(w.spellings) == 3


def test_groups_cover_all_texts():
    a = pa.array([b"x" * n for n in (5, 0, 9, 100, 1, 1)], pa.binary())
    for most in (1, 10, 1000):
        got = list(groups(a, most))
        assert [x for _, g in got for x in g.to_pylist()] == a.to_pylist()
        assert [i for i, _ in got] == np.cumsum([0] + [len(g) for _, g in got])[:-1].tolist()
    assert list(groups(a.slice(0, 0))) == []


def test_ragged():
    assert ragged(np.array([5, 1, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    assert ragged(np.empty(0, int), np.empty(0, int)).tolist() == []
