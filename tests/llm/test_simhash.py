import random
import re
from collections import Counter

import numpy as np
import xxhash
from llm_support import odd_rows, rows_of

from ladder.llm import simhash
from ladder.llm.common import Scratch


def brute_fingerprint(text, shingle=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, max_bits=4):
    """Component number of each position, all pairs compared."""
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def expected(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(fps)
    least = {}
    for (i, _), c in zip(rows, comp, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return sorted(((i, f - (1 << 64) if f >> 63 else f, least.get(c)) for (i, _), f, c in zip(rows, fps, comp, strict=True)),
                  key=repr)


def test_fingerprint_equals_brute_force_and_sparks_hash(spark):
    from pyspark.sql import functions as F

    for t in (None, "", "A", "a b C d", "é É x y z\x0bw", "w " * 300_000):
        assert simhash.simhash(t.encode() if t else None) == (brute_fingerprint(t[:2000]) if t and len(t) > 9999
                                                              else brute_fingerprint(t))
    one = spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0]
    assert one % 2**64 == simhash.simhash(b"A b c d")


def test_near_duplicates_equal_brute_force(odd, small, none):
    assert rows_of(simhash.near_duplicates(odd)) == expected([(r[0], r[1]) for r in odd_rows()])
    assert rows_of(simhash.near_duplicates(small)) == expected([(r.doc_id, r.text) for r in small.collect()])
    assert simhash.near_duplicates(none).count() == 0


def clouds(seed, centres, each, flips):
    r = random.Random(seed)
    out = set()
    for _ in range(centres):
        c = r.getrandbits(64)
        for _ in range(each):
            x = c
            for b in r.sample(range(64), r.randint(0, flips)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


def roots(n, links):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_spanning_links_connect_what_all_pairs_connect():
    for seed in range(12):
        fps = clouds(seed, 6, 40, 2 + seed % 8)
        random.Random(seed).shuffle(fps)
        links = simhash.spanning_links(np.array(fps, dtype=np.uint64), np.zeros(len(fps), dtype=int))
        assert len(links) < len(fps) and all((fps[i] ^ fps[j]).bit_count() <= 4 for i, j in links)
        a, b = roots(len(fps), links), brute_components(fps)
        assert len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_runs_are_kept_apart():
    fps, run, want, base = [], [], [], 0
    for seed in range(30):
        part = clouds(seed, 2, 1 + seed % 7, 4)
        want += [base + c for c in brute_components(part)]
        fps, run, base = fps + part, run + [seed] * len(part), base + len(part)
    a = roots(len(fps), simhash.spanning_links(np.array(fps, dtype=np.uint64), np.array(run)))
    assert len(set(zip(a, want, strict=True))) == len(set(a)) == len(set(want))
    assert simhash.spanning_links(np.empty(0, dtype=np.uint64), np.empty(0, dtype=int)) == []


def test_pivots_discard_nearly_all_pairs_of_unrelated_fingerprints():
    n = 4096
    fps = np.random.default_rng(3).integers(0, 2**64, n, dtype=np.uint64)
    verified = []
    assert simhash.spanning_links(fps, np.zeros(n, dtype=int), verified=verified) == []
    assert sum(verified) < n * n / 2 / 1000
    # one cloud of near copies: joined after few comparisons
    cloud = np.array([c for c in clouds(1, 1, 3000, 2)], dtype=np.uint64)
    verified = []
    assert len(simhash.spanning_links(cloud, np.zeros(len(cloud), dtype=int), verified=verified)) == len(cloud) - 1
    assert sum(verified) < len(cloud) ** 2 / 50


def test_links_with_hot_keys_split_into_chunks(spark):
    for most in (4, 16, 4096):
        fps = clouds(99, 12, 30, 5)
        df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
        scratch = Scratch(spark, "test")
        links = simhash.near_links(df, scratch, most=most)
        roots = {r.node: r.root for r in simhash.components(links, scratch).collect()}
        got = [roots.get(f - (1 << 64) if f >> 63 else f, f - (1 << 64) if f >> 63 else f) for f in fps]
        want = brute_components(fps)
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_every_pair_within_the_distance_shares_a_block_key(spark):
    from pyspark.sql import functions as F

    r = random.Random(5)
    pairs = []
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), 4):
            b ^= 1 << bit
        pairs.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(pairs, "a long, b long")
    meet = F.arrays_overlap(simhash.block_keys(F.col("a")), simhash.block_keys(F.col("b")))
    assert df.where(~meet).count() == 0


def test_components_of_a_long_path(spark):
    scratch = Scratch(spark, "test")
    ids = list(range(200))
    random.Random(1).shuffle(ids)
    links = spark.createDataFrame([(min(x), max(x)) for x in zip(ids[:-1], ids[1:], strict=True)] + [(1000, 1001)],
                                  "a long, b long")
    got = {r.node: r.root for r in simhash.components(links, scratch).collect()}
    assert got == {i: 0 for i in ids} | {1000: 1000, 1001: 1000}


def test_one_of_each_keeps_one_row_of_each_group(odd, none):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    rows = [(r[0], r[1]) for r in odd_rows()]
    comp = brute_components([brute_fingerprint(t) for _, t in rows])
    least = {}
    for (i, _), c in zip(rows, comp, strict=True):
        least[c] = min(x for x in (i, least.get(c)) if x is not None) if (i, least.get(c)) != (None, None) else None
    assert Counter(r.doc_id for r in kept.collect()) == Counter(least.values())
    assert simhash.one_of_each(none).count() == 0
