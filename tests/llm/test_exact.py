import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from llm_support import odd_rows, rows_of

from ladder.llm import exact
from ladder.llm.queries import ORACLE_SQL, op12_exact_dedup


def brute(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    out = []
    for t, ids in by.items():
        keep = max((i for i in ids if i is not None), default=None)
        h = hashlib.sha256(t.encode()).hexdigest()
        out += [(i, keep, len(ids), k == 0, h) for k, i in enumerate(sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True))]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [64, 1000, exact.FILTER_BITS])
def test_equals_brute_force(odd, none, bits):
    want = brute([(r[0], r[1]) for r in odd_rows()])
    assert rows_of(exact.exact_duplicates(odd, filter_bits=bits, digest_all=True)) == want
    assert exact.exact_duplicates(none, filter_bits=bits).count() == 0


def test_only_surviving_groups_are_digested(spark):
    same = "x" * 300
    rows = [(1, same + "a"), (2, same + "b"), (3, same + "a"), (4, "alone"), (5, "y" * 301), (6, "z" * 301), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in exact.exact_duplicates(docs).collect()}
    assert {i for i, r in got.items() if r.text_sha256} == {1, 2, 3, 7, 8}  # equal length and start
    assert [(got[i].keep_id, got[i].group_size, got[i].kept) for i in range(1, 9)] == [
        (3, 2, False), (2, 1, True), (3, 2, True), (4, 1, True), (5, 1, True), (6, 1, True), (8, 2, False), (8, 2, True)]


def test_a_hot_text_with_many_ids_and_many_equal_rows(spark):
    docs = spark.range(20_000).selectExpr("CASE WHEN id % 2 = 0 THEN id ELSE 7 END AS doc_id",
                                          "CASE WHEN id % 3 = 0 THEN concat('t', id) ELSE 'copy' END AS text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = exact.exact_duplicates(docs, digest_all=True).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    assert Counter(r.kept for r in got)[True] == len({t for _, t in rows})


def test_very_long_texts(spark):
    r = random.Random(1)
    long = "".join(r.choices("ab é", k=3_000_000))
    docs = spark.createDataFrame([(1, long), (2, long), (3, long[:-1] + "#")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact.exact_duplicates(docs).collect()} == {1: 2, 2: 2, 3: 3}


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = duck.sql(ORACLE_SQL["op12_exact_dedup"])
    assert rows_of(op12_exact_dedup(spark, sf).select(*rel.columns)) == sorted(rel.fetchall(), key=repr)


def test_plan_moves_no_text(small):
    plan = exact.exact_duplicates(small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
