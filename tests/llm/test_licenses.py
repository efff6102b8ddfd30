import duckdb
from llm_support import rows_of

from ladder.llm import licenses
from ladder.llm.queries import ORACLE_SQL, op2_license_scan
from pyspark.sql import functions as F

MIT = licenses.KNOWN[0][1]


def test_canonical_forms_meet(spark, odd, none):
    texts = [
        (1, MIT), (2, "Copyright (c) 1999-2024 Some One\n\n" + MIT.upper().replace("LICENSE", "LICENCE").replace(",", " , ")),
        (3, MIT + " and more"), (4, None), (5, ""), (6, "***"), (7, "Intro\nLicensed under the MIT Licence\nend"),
        (7, "Intro\nLicensed under the MIT Licence\nend"), (None, MIT), (8, "© 2020 X. All rights reserved."),
    ]
    docs = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, k_digest string")
    got = rows_of(licenses.license_scan(docs), "doc_id", "license_id", "notice_ids")
    assert got == sorted([(1, "MIT", None), (2, "MIT", None), (3, None, None), (4, None, None), (5, None, None),
                          (6, None, None), (7, None, "MIT"), (7, None, "MIT"), (None, "MIT", None), (8, None, None)], key=repr)
    assert licenses.license_scan(odd).count() == odd.count()
    assert licenses.license_scan(none).count() == 0


def test_known_texts_are_a_parameter(spark):
    known = licenses.known_digests(spark, [("Own", "Do as you like.")])
    docs = spark.createDataFrame([(1, "do as you LIKE!")], "doc_id long, text string")
    assert rows_of(licenses.license_scan(docs, known), "doc_id", "license_id") == [(1, "Own")]


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = duck.sql(ORACLE_SQL["op2_license_scan"])
    got = rows_of(op2_license_scan(spark, sf).select(*rel.columns))
    assert got == sorted(rel.fetchall(), key=repr)
    assert any(r[3] for r in got)


def test_entire_common_licences_and_their_notices_are_known(spark):
    folder = "/usr/share/common-licenses/"
    files = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only",
             "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(f, open(folder + f).read(), k, None) for f, k in files.items()]
    rows += [(f"{f} in one line", " ".join(t.split()), k, k) for f, t, k, _ in rows if f != "BSD"]
    bsd = open(folder + "BSD").read()
    two = bsd[:bsd.index("3. Neither")] + bsd[bsd.index("\nTHIS SOFTWARE"):]
    rows += [("BSD-2", two.replace("REGENTS", "COPYRIGHT HOLDERS", 1).replace("REGENTS", "COPYRIGHT HOLDER"), "BSD-2-Clause", None),
             ("MIT file", "MIT License\n\nCopyright (c) 2020 Some One\n\n" + MIT, "MIT", None)]
    notices = {"SPDX-License-Identifier: MIT": "MIT", "Creative Commons Attribution 4.0 International": "CC-BY-4.0",
               "Licensed under a Creative Commons Attribution 4.0 International": "CC-BY-4.0",
               "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
               "License: Creative Commons Attribution 4.0 International": "CC-BY-4.0",
               "All rights reserved.": licenses.RESERVED, "Released under the GNU GPL v3": "GPL-3.0-only"}
    rows += [(n, f"Intro\n{n}\nend", None, k) for n, k in notices.items()]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id string, text string")
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert {r[0]: got[r[0]].license_id for r in rows} == {r[0]: r[2] for r in rows}
    assert {n: got[n].notice_ids for n in notices} == notices
    assert got["GPL-3 in one line"].notice_ids == "GPL-3.0-only"


def test_what_follows_the_holder_in_a_line_stays(spark):
    one = " ".join(MIT.split())
    whole = [f"{head} {one}" for head in (
        "Copyright (c) 2020 Some One.", "Copyright 2020 Some One, Inc. All rights reserved.", "(c) J. R. Hacker 2019-2020.",
        "Copyright (c) 2020 Acme, Inc. and contributors.", "© 2019 Foo Labs. Copyright (c) 2020 Bar Labs.",
        "Copyright 2020.", "Copyright (c) 2020 Some One\n")]
    gone = ["Copyright (c) 2020 Dr. J. Smith", "Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>",
            "Copyright 2020 a.b.example.org and others", "(c) 2020 Acme Inc. and contributors", "Copyright Acme Inc. 2020",
            "© 2020 X. All rights reserved."]
    rows = [(t, "MIT") for t in whole] + [(f"{g}\n{MIT}", "MIT") for g in gone] + [(g, None) for g in gone]
    docs = spark.createDataFrame([(t, t) for t, _ in rows], "doc_id string, text string")
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert {t: got[t].license_id for t, _ in rows} == dict(rows)
    assert all(got[g].digest is None for g in gone)
    notice = "Copyright 2024 Acme. Licensed under the MIT License."
    law = "Copyright notices stay in. The act of 1976 says more."
    long = "copyright " + "a.b " * 20_000 + "."
    docs = spark.createDataFrame([(t, t) for t in (notice, law, long, "(c) 2020 " + "a.b " * 20_000)], "doc_id string, text string")
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert (got[notice].license_id, got[notice].notice_ids) == ("MIT", "MIT")
    plain = spark.createDataFrame([(law.replace("Copyright", "- copyright"),)], "t string").select(licenses.digest(F.col("t")).alias("d"))
    assert got[law].digest == plain.first().d and got[long].digest is not None


def test_sql_cuts_the_same_clauses(spark):
    texts = ["Copyright (c) 2020 Some One. " + MIT, "© 2020 X. All rights reserved. Licensed under CC BY 4.0.",
             "copyright Acme Ltd. 2020 and Co. and others. Rest", "Copyright notices stay. 1976", "(c) (c) 2020. Copyright 1999 by Dr. No"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    duck = duckdb.connect()
    duck.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    rel = duck.sql(ORACLE_SQL["op2_license_scan"])
    assert rows_of(licenses.license_scan(docs).select(*rel.columns)) == sorted(rel.fetchall(), key=repr)
