"""License scans by canonical digest (operator 2), built-in functions only.

A text is brought to a canonical form (case, holder clauses, punctuation, white space, equivalent spellings) and
the SHA-256 digest of the entire form is hash-joined to the digests of known texts. Each document is looked up as a
whole and by its lines (a notice usually stands on a line of its own), each line again as an entire text.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ladder.llm.common import Scratch

# Words that licence matching treats as the same, each with the form used here.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "https": "http", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed", "licences": "licenses",
    "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sublicence": "sublicense",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

# The wording of short public licences and licence notices.
_AS_IS = (' is provided "as is", without warranty of any kind, express or implied, including but not limited to the '
          "warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the "
          "authors or copyright holders be liable for any claim, damages or other liability, whether in an action of "
          "contract, tort or otherwise, arising from, out of or in connection with the software or the use or other "
          "dealings in the software.")
_GRANT = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
          "hereby granted")
_DISCLAIM = ('\nThe software is provided "as is" and the author disclaims all warranties with regard to this software '
             "including all implied warranties of merchantability and fitness. In no event shall the author be liable "
             "for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from "
             "loss of use, data or profits, whether in an action of contract, negligence or other tortious action, "
             "arising out of or in connection with the use or performance of this software.")
_SHORT = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            'associated documentation files (the "Software"), to deal in the Software without restriction, including '
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions:\nThe above copyright notice and this permission notice shall be included in all "
            "copies or substantial portions of the Software.\nThe software" + _AS_IS),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", _GRANT + ", provided that the above copyright notice and this permission notice appear in all copies."
            + _DISCLAIM),
    ("0BSD", _GRANT + "." + _DISCLAIM),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)

# The titles that short licences carry above their text.
_TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"),
    "Zlib": ("zlib License", "The zlib License"),
}

# How notices name a licence. The SPDX id is a name of each.
_NAMES = {
    "MIT": ("MIT License", "MIT"),
    "ISC": ("ISC License",),
    "0BSD": ("Zero-Clause BSD License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "GPL-1.0-only": (),
    "GPL-2.0-only": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2"),
    "GPL-2.0-or-later": ("GNU General Public License, version 2 or later", "GPLv2+"),
    "GPL-3.0-only": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3"),
    "GPL-3.0-or-later": ("GNU General Public License, version 3 or later", "GPLv3+"),
    "LGPL-2.0-only": (),
    "LGPL-2.1-only": ("GNU Lesser General Public License, version 2.1", "LGPLv2.1"),
    "LGPL-2.1-or-later": ("GNU Lesser General Public License, version 2.1 or later", "LGPLv2.1+"),
    "LGPL-3.0-only": ("GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPLv3"),
    "LGPL-3.0-or-later": ("GNU Lesser General Public License, version 3 or later", "LGPLv3+"),
    "AGPL-3.0-only": ("GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3"),
    "AGPL-3.0-or-later": ("GNU Affero General Public License, version 3 or later", "AGPLv3+"),
    "MPL-1.1": ("Mozilla Public License, version 1.1",),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "BSL-1.0": ("Boost Software License, Version 1.0",),
    "Zlib": ("zlib License",),
    "Unlicense": ("The Unlicense",),
    "Artistic-1.0-Perl": (),
    "GFDL-1.2-only": ("GNU Free Documentation License, version 1.2",),
    "GFDL-1.3-only": ("GNU Free Documentation License, version 1.3",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "CC0"),
} | {f"CC-BY{short}-{v}": (f"CC BY{short} {v}", f"CC BY{short} {v} License",
                           f"Creative Commons Attribution{long} {v} {scope}",
                           f"Creative Commons Attribution{long} {v} {scope} License",
                           f"Creative Commons Attribution{long} {v} License")
     for short, long in (("", ""), ("-SA", "-ShareAlike"), ("-NC", "-NonCommercial"), ("-ND", "-NoDerivatives"),
                         ("-NC-SA", "-NonCommercial-ShareAlike"), ("-NC-ND", "-NonCommercial-NoDerivatives"))
     for v, scope in (("3.0", "Unported"), ("4.0", "International"))}
_SUBJECTS = ("", "This work is ", "This project is ", "This software is ")
_VERBS = ("Licensed", "Released", "Distributed")
#: No licence at all, named as SPDX names what it doesn't list.
RESERVED = "LicenseRef-All-Rights-Reserved"
_APACHE_HEADER = (
    'Licensed under the Apache License, Version 2.0 (the "License")',
    "; you may not use this file except in compliance with the License.",
    "\nYou may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by "
    "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language "
    "governing permissions and limitations under the License.")
_OTHER_NOTICES = (
    *[("Apache-2.0", "".join(_APACHE_HEADER[:i + 1])) for i in range(3)],
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
                "to this work."),
    (RESERVED, "All rights reserved."), (RESERVED, "All rights reserved worldwide."), (RESERVED, "All right reserved."),
    (RESERVED, "All rights are reserved."),
)


def _notices() -> list[tuple[str, str]]:
    """The usual one-line notices, from the licences' names."""
    out = [*_OTHER_NOTICES]
    for k, names in _NAMES.items():
        out += [(k, f"{tag}: {k}") for tag in ("SPDX-License-Identifier", "License")]
        for n in dict.fromkeys([k, *names]):
            out += [(k, f"{subject}{verb if not subject else verb.lower()} under {the}{n}.")
                    for subject in _SUBJECTS for verb in _VERBS for the in ("", "the ")]
            out += [(k, f"License: {n}"), (k, f"Licensed under a {n}."), (k, f"This work is licensed under a {n}.")]
            out += [(k, n)] * ("License" in n or "Creative Commons" in n)
    return out


def _bsd(text: str) -> list[tuple[str, str]]:
    """The 3-clause text and what is usual in its place: other holders, the third clause left out, no numbers."""
    out = []
    holders = (("the University", "REGENTS", "REGENTS"), ("the copyright holder", "COPYRIGHT HOLDERS", "COPYRIGHT HOLDER"),
               ("the copyright holder", "COPYRIGHT HOLDERS", "COPYRIGHT OWNER"))
    for name, many, one in holders:
        t = (text.replace("the University", name).replace("THE REGENTS AND", f"THE {many} AND")
             .replace("THE REGENTS OR", f"THE {one} OR"))
        for k, u in (("BSD-3-Clause", t), ("BSD-2-Clause", re.sub(r"3\. Neither.*?permission\.\n", "", t, flags=re.S))):
            out += [(k, head + v) for v in (u, re.sub(r"(?m)^[123]\. ", "", u)) for head in ("", "All rights reserved.\n")]
    return out


def _layouts(text: str) -> list[str]:
    """A text as it is wrapped, with a line per paragraph, and on a single line: lines decide what is a holder's line."""
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", text) if p.strip()]
    return list(dict.fromkeys([text, "\n".join(paragraphs), " ".join(paragraphs)]))


def _known() -> tuple[tuple[str, str], ...]:
    """(SPDX id, wording): entire texts (with and without appendix and title) and notices."""
    short, long = [*_SHORT], []
    for file in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        k, text = file.stem, file.read_text(encoding="utf-8").strip("\f\n")
        if k == "BSD-3-Clause":
            short += _bsd(text)
        elif k == "Zlib":
            short.append((k, text))
        else:
            body = re.match(r".*END OF TERMS AND CONDITIONS", text, flags=re.S)
            long += [(k, v) for t in ([text, body[0]] if body else [text]) for v in _layouts(t)]
    titled = [(k, f"{title}\n{t}") for k, t in short if len(t) > 200 for title in _TITLES[k]]
    return tuple(dict.fromkeys([*short, *titled, *long, *_notices()]))


KNOWN = _known()

# A sentence ends at a full stop after a word of two letters or more that is no title (Dr., Jr.) and not in "Inc. and ...".
_WORD_END = r"(?:[\p{L}\p{N})>][\p{L}\p{N})>]{2}|\b(?:[a-ce-ikln-rt-z0-9][a-z0-9]|[djms][a-qu-z0-9]))"
_STOP = rf"{_WORD_END}\.[ \t]+(?:(?:and|&)[ \t](?:[^\n]*?{_WORD_END}\.[ \t]+|[^\n]*))?(?:<[^>\n]*>[ \t]*)?"
_RESERVED = r"all rights reserved\b(?: worldwide\b)?\.?"
_ABBREVIATED = r"\b(?:\p{L}|inc|ltd|co|corp|dr|jr|st)\.[ \t]"
#: A holder's clause at the start of a line: dropped before digesting. It names a year, (c) or "all rights reserved" in
#: its first sentence and goes to the sentence's end, "all rights reserved" after it, or else the line's end. What
#: follows it in the line stays, and so does a sentence about copyright.
COPYRIGHT_LINE = (
    r"(?m)^(?:[ \t]*(?:copyright\b|\(c\)|©)"
    rf"[^\n.]*?(?:(?:\.[^ \t\n]|{_ABBREVIATED})[^\n.]*?){{0,20}}?"
    rf"(?:(?:[0-9]{{4}}|\(c\)|©)(?:[ \t,]*(?:by[ \t]+)?(?:dr|prof|mrs?|ms|st)\.)?"
    rf"(?:\.[ \t]+(?:{_RESERVED})?|[^\n]*?(?:{_STOP}(?:{_RESERVED})?|{_RESERVED})|[^\n]*)|{_RESERVED}))+")


def canonical(text: Column) -> Column:
    """The canonical form; null for a text without letters or digits (null, empty, punctuation only)."""
    t = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    t = F.btrim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))
    spelling = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    words = F.transform(F.split(t, " "), lambda w: F.coalesce(F.element_at(spelling, w), w))
    return F.when(F.length(t) > 0, F.array_join(words, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(license_id, digest) of known (id, text) pairs; equal digests under several ids keep the smallest id. The texts
    go to the JVM as one literal, and only their digests are kept, as a table in the shared folder."""
    texts = F.from_json(F.lit(json.dumps([{"license_id": k, "text": t} for k, t in known])),
                        "array<struct<license_id:string,text:string>>")
    rows = spark.range(0, 1, 1, 1).select(F.inline(texts))
    digests = rows.select("license_id", digest(F.col("text")).alias("digest")).groupBy("digest").agg(
        F.min("license_id").alias("license_id"))
    return Scratch(spark, "known_licenses").table(digests.coalesce(1))


def license_scan(docs: DataFrame, known: DataFrame | None = None, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """``doc_id, digest, license_id, notice_ids`` per input row.

    ``license_id``: the known licence that the whole text is (null: none). ``notice_ids``: licences whose notice
    is an entire line of it, comma-joined in order (null: none).
    ``known`` may have any size: Spark picks the join by the tables' sizes. Lines are looked up by distinct digest
    per (document, digest of its text), so a row key isn't needed and repeated rows come out alike. Null and empty
    texts have a null digest and match nothing; other input columns are not read.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    known = known.select(F.col("digest").alias("k_digest"), F.col("license_id").alias("k_id"))
    t = F.col(text)
    digests = docs.select(F.col(doc_id).alias("doc_id"), digest(t).alias("digest"), F.array_distinct(
        F.filter(F.transform(F.split(t, "\n"), digest), lambda d: d.isNotNull())).alias("lines"))
    digests = Scratch(docs.sparkSession, "licenses").table(digests)  # the texts are read and normalised once
    found = (digests.select("doc_id", "digest", F.explode("lines").alias("k_digest")).join(known, "k_digest")
             .groupBy("doc_id", "digest").agg(F.array_join(F.sort_array(F.collect_set("k_id")), ",").alias("notice_ids"))
             .select(F.col("doc_id").alias("n_doc"), F.col("digest").alias("n_digest"), "notice_ids"))
    same = F.col("doc_id").eqNullSafe(F.col("n_doc")) & (F.col("digest") == F.col("n_digest"))
    return (digests.select("doc_id", "digest").join(found, same, "left")
            .join(known, F.col("digest") == F.col("k_digest"), "left")
            .select("doc_id", "digest", F.col("k_id").alias("license_id"), "notice_ids"))
