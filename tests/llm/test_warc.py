import gzip
import io
import zlib

import duckdb
import pytest
from llm_support import rows_of

from ladder.llm import warc
from ladder.llm.common import Scratch
from ladder.llm.queries import ORACLE_SQL, op7_warc

PAGES = [(1, "http://a/ é", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://b", None), (4, "http://b", ""), (5, "u\r\nx", "é" * 70000),
         (2, "again", "<p>x</p>"), (None, "n", "<p>x</p>"), (None, "n", "only"), (None, "n", "only"), (6, "http://c", "\r\n\r\n")]


def brute(pages, least_bytes=0):
    first = {}
    for i, _, t in pages:
        t = (t or "").encode()
        if i is not None:
            first[t] = min(i, first.get(t, i))
    out = []
    for i, _, t in pages:
        t = (t or "").encode()
        to = first.get(t) if len(t) >= least_bytes else None
        revisit = to is not None and to != i
        out.append((i, len(t), warc.base32_sha1(t), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=repr)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, payload string").repartition(3)
    back = warc.write_and_read(pages, least_bytes=least).cache()
    assert rows_of(back, *COLUMNS) == brute(PAGES, least)
    payloads = {r.page_id: bytes(r.payload) for r in back.where("record_type = 'response'").collect()}
    assert payloads[5] == ("é" * 70000).encode() and payloads[6] == b"\r\n\r\n"


def test_no_rows(spark):
    assert warc.write_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archives_are_gzip_members_and_roll(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    scratch = Scratch(spark, "test")
    listed = scratch.table(warc.write_archives(pages, f"{scratch.path}/a", roll_bytes=1))
    assert listed.count() == len(PAGES)
    for r in listed.collect():
        with open(f"{scratch.path}/a/{r.archive}", "rb") as f:
            data = f.read()
        assert len(data) == r.n_bytes and gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_reading_is_the_same_in_any_chunks_and_damage_is_found():
    data = b"".join(warc.record(i, u, (t or "").encode()) for i, u, t in PAGES) + warc.record(9, "u", b"<p>x</p>", 1)
    for chunk in (1, 3, 1000, 1 << 20):
        got = list(warc.records(io.BytesIO(data), chunk))
        assert [r.payload_bytes for r in got] == [len((t or "").encode()) for _, _, t in PAGES] + [8]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[:-9])))
    for old, new in ((b"<p>x</p>", b"<p>y</p>"), (b"Content-Length: ", b"Content-Length: 1")):
        plain = zlib.decompress(warc.record(1, "u", b"<p>x</p>"), 31)
        packed = gzip.compress(plain.replace(old, new, 1))
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(packed)))


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet' UNION ALL SELECT page_id + 10000, url, html FROM '{sf}/pages.parquet' "
             "WHERE page_id % 3 = 0")
    rel = duck.sql(ORACLE_SQL["op7_warc"])
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages = pages.unionByName(pages.where("page_id % 3 = 0").selectExpr("page_id + 10000 as page_id", "url", "html"))
    assert rows_of(warc.write_and_read(pages).select(*rel.columns)) == sorted(rel.fetchall(), key=repr)
    assert op7_warc(spark, sf).columns == COLUMNS
