import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from llm_support import odd_rows

from ladder.llm import sharding


def shards_of(rows, n_shards=16):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(by[s]) == list(range(len(by[s]))) for s in range(n_shards))


@pytest.mark.parametrize("settings", [{}, {"unit": 7, "block": 3, "group": 2}, {"shards": 5, "unit": 1000, "block": 4}])
def test_exact_sizes_and_whole_rows(odd, settings):
    got = sharding.shard_documents(odd, **settings).collect()
    shards_of(got, settings.get("shards", 16))
    data = [(r[0], (r[1] or "").encode()) for r in odd_rows()]
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(
        ((i, len(t) + 1, zlib.crc32(t)) for i, t in data), key=repr)


def test_same_seed_same_places_and_all_columns(odd, none):
    one, two = (sorted(map(tuple, sharding.uniform_shards(odd, unit=9).collect()), key=repr) for _ in range(2))
    assert one == two
    assert sharding.uniform_shards(odd).columns == [c for c in odd.columns if c != "shard"] + ["shard", "slot"]
    other = sorted(map(tuple, sharding.uniform_shards(odd, unit=9, seed=5).collect()), key=repr)
    assert other != one
    assert sharding.uniform_shards(none).count() == 0


def test_matrix_has_the_sums_and_the_law():
    rng = np.random.default_rng(1)
    rows, cols = [5, 0, 11, 4], np.array([7, 6, 7, 0])
    total = np.zeros((4, 4))
    for _ in range(4000):
        m = np.array(list(sharding.draw_rows(rng, rows, cols)))
        assert (m.sum(axis=1) == rows).all() and (m.sum(axis=0) == cols).all() and (m >= 0).all()
        total += m
    assert np.allclose(total / 4000, np.outer(rows, cols) / 20, atol=0.1)


def test_the_splits_together_have_the_exact_law():
    """Groups to shards, shards to blocks, groups to units: the matrix of units and blocks has the probabilities that all
    permutations, counted one by one, give it."""
    units, groups, blocks, shards = [2, 1, 2], [[0, 1], [2]], [1, 1, 3], [[0, 1], [2]]
    slots = [b for b, n in enumerate(blocks) for _ in range(n)]
    owner = [u for u, n in enumerate(units) for _ in range(n)]
    exact = Counter()
    for order in permutations(range(5)):
        m = np.zeros((3, 3), dtype=int)
        for row, slot in enumerate(order):
            m[owner[row], slots[slot]] += 1
        exact[tuple(m.ravel())] += 1
    rng, seen, times = np.random.default_rng(11), Counter(), 20_000
    for _ in range(times):
        top = np.array(list(sharding.draw_rows(rng, [sum(units[u] for u in g) for g in groups], np.array([sum(blocks[b] for b in s) for s in shards]))))
        by_block = np.zeros((len(groups), 3), dtype=int)
        for s, own in enumerate(shards):
            by_block[:, own] = np.array(list(sharding.draw_rows(rng, top[:, s], np.array([blocks[b] for b in own]))))
        m = np.zeros((3, 3), dtype=int)
        for g, own in enumerate(groups):
            m[own] = np.array(list(sharding.draw_rows(rng, [units[u] for u in own], by_block[g])))
        seen[tuple(m.ravel())] += 1
    assert set(seen) == set(exact)
    chi = sum((seen[m] - times * n / 120) ** 2 / (times * n / 120) for m, n in exact.items())
    assert chi < len(exact) + 5 * (2 * len(exact)) ** 0.5


def test_every_placement_is_as_likely(spark):
    """All of uniform_shards by brute force: which two of four rows go to shard 0, over many seeds."""
    df = spark.range(0, 4, 1, 2).withColumnRenamed("id", "doc_id").cache()
    seen = Counter()
    for seed in range(30):
        got = sharding.uniform_shards(df, 2, seed=seed, unit=1, block=1, group=1).collect()
        seen[tuple(sorted(r.doc_id for r in got if r.shard == 0))] += 1
    assert len(seen) == 6 and sum((n - 5) ** 2 / 5 for n in seen.values()) < 20  # 5 degrees of freedom


def test_large_hypergeometric_by_inversion(monkeypatch):
    rng = np.random.default_rng(2)
    big = [sharding.hypergeometric(rng, 6 * 10**9, 4 * 10**9, 1000) for _ in range(2000)]
    assert abs(np.mean(big) - 600) < 2 and abs(np.std(big) - (1000 * 0.24) ** 0.5) < 1
    assert sharding.hypergeometric(rng, 10**10, 0, 50) == 50 and sharding.hypergeometric(rng, 0, 10**10, 50) == 0


def test_shuffle_is_uniform(spark):
    df = spark.range(64).repartition(4).withColumnRenamed("id", "doc_id").cache()
    seen = np.zeros((64, 8))
    for seed in range(30):
        for r in sharding.uniform_shards(df, 8, seed=seed, unit=5, block=3).collect():
            seen[r.doc_id, r.shard] += 1
    chi = ((seen - 30 / 8) ** 2 / (30 / 8)).sum()
    assert 300 < chi < 600  # 64 x 7 degrees of freedom, 448 expected


def test_blocks_cover_shards():
    for n in (0, 1, 15, 16, 17, 1000):
        blocks = sharding._blocks(n, 16, random.randint(1, 20))
        assert sum(b[2] for b in blocks) == n and {b[0] for b in blocks} == set(range(16))
