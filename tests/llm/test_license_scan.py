import re

import duckdb

from roadrisk.llm import license_scan as L
from tests.conftest import SF
from tests.llm import cases

COLS = ("doc_id", "n_known", "sentence_ids", "licences", "unmatched")

ROWS = [
    (1, "Some prose.\nReleased under the MIT License.\nMore prose.", "en", "s", 1),
    (2, "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at\n http://x", "en", "s", 1),
    (3, "This work is licensed under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0.", "en", "s", 1),
    (4, "released UNDER the mit license! Released under the MIT License.", "en", "s", 1),
    (5, "Permission is hereby granted to nobody. The software.", "en", "s", 1),
    (6, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "en", "s", 1),
    (7, "All rights reserved under license", "en", "s", 1),
]


def brute(text):
    known = L.known_sentences()
    ids = [known[n] for n in (re.sub("[^a-z0-9]+", " ", s.lower()).strip() for s in re.split(L.SENTENCE_END, text or "")) if n in known]
    left, found = list(ids), []
    for name, run in L.RULES:
        k, keep = 0, []
        while k < len(left):
            if left[k:k + len(run)] == run:
                found.append(name)
                keep.append(None)  # what is taken parts its neighbours
                k += len(run)
            else:
                keep.append(left[k])
                k += 1
        left = keep
    return len(ids), ",".join(ids), ",".join(found), ",".join(x for x in left if x)


def test_equals_brute_force(spark):
    rows = ROWS + cases.texts()
    got = cases.fields(L.license_scan(cases.documents(spark, rows)), *COLS)
    assert got == sorted(((r[0], *brute(r[1])) for r in rows), key=repr)


def test_known_cases(spark):
    got = {r.doc_id: r for r in L.license_scan(cases.documents(spark, ROWS)).collect()}
    assert got[1].licences == "MIT" and got[3].licences == "GPL-3.0,CC-BY-NC-4.0"
    assert got[4].licences == "MIT,MIT" and got[5].licences == "" and got[6].licences == "GPL-3.0-or-later"
    assert got[2].licences == "Apache-2.0" and got[2].unmatched == "ApacheUse,ApacheCopy"
    assert got[7].licences == "" and got[7].unmatched == "AllRights"


def test_key_words_are_in_every_known_sentence():
    assert all(any(w in s for w in L.KEY_WORDS) for s in L.known_sentences() if s != "licensed under cc by 4 0")
    assert all(any(w in s for w in L.KEY_WORDS) for s in L.known_sentences())
    assert {i for _, run in L.RULES for i in run} <= set(L.SENTENCES)


def test_sql_says_the_same(spark):
    con = duckdb.connect()
    for path in (SF, "/root/testdata/sf0.01"):
        docs = spark.read.parquet(f"{path}/documents.parquet")
        con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet')")
        assert sorted(con.sql(f"SELECT {', '.join(COLS)} FROM ({L.oracle()})").fetchall()) == cases.fields(L.license_scan(docs), *COLS) or \
            sorted(con.sql(f"SELECT {', '.join(COLS)} FROM ({L.oracle()})").fetchall(), key=repr) == cases.fields(L.license_scan(docs), *COLS)


def test_empty_table(spark):
    assert L.license_scan(cases.documents(spark, [])).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
APACHE = """Licensed under the Apache License, Version 2.0
(the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version {} of the License, or
(at your option) any later version."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """3. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
WRAPPED = {
    "MIT": MIT, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL.format(":", 3), "GPL-2.0-or-later": GPL.format(";", 2),
    "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3.format("the copyright holder"),
}


def test_wrapped_notices_match_whole_under_any_comment_leader(spark):
    rows, want = [], {}
    for leader in ("", "# ", "// ", " * ", ";; ", "-- ", "! "):
        for end in ("\n", "\r\n"):
            for name, text in WRAPPED.items():
                lines = "The header\n\n" + text + "\n\nint x = 1;"
                want[len(rows)] = name
                rows.append((len(rows), end.join((leader + x).rstrip() for x in lines.split("\n")), "en", "s", 1))
    got = L.license_scan(cases.documents(spark, rows)).collect()
    assert {r.doc_id: r.licences for r in got} == want and {r.unmatched for r in got} == {""}


def test_bsd_3_clause_of_any_holder(spark):
    holders = ["the copyright holder", "Google Inc.", "the University of\n   California, Berkeley", "[project]"]
    rows = [(i, BSD3.format(h), "en", "s", 1) for i, h in enumerate(holders)]
    assert [r.licences for r in L.license_scan(cases.documents(spark, rows)).collect()] == ["BSD-3-Clause"] * len(rows)


def test_where_lines_join(spark):
    texts = {
        "Released under\nthe MIT License": "MIT",
        "a title\nReleased under the MIT License\nint x": "MIT",
        "a title\n# Released under the\n# MIT License\nint x": "MIT",
        "Released under\n\nthe MIT License": "",
        "# Released under\n#\n# the MIT License": "",
        "Released under.\nthe MIT License": "",
        "not Released under\nthe MIT License": "",
        "Released under\nthe MIT License or not": "",
        "x | Released under\nthe MIT License": "",
        "Released under the MIT License\nLicensed under\nCC BY 4.0": "MIT,CC-BY-4.0",
    }
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r.licences for r in L.license_scan(cases.documents(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == list(texts.values())


def test_own_sentences_need_none_of_the_key_words(spark):
    from roadrisk.llm import license_scan
    rows = [(1, "Use it at your own risk. Nothing else."), (2, "use it at your\nown risk"), (3, "at your own"), (4, None)]
    m = license_scan.license_matches(spark.createDataFrame(rows, "doc_id long, text string"), {"Risk": "Use it at your own risk"}, [("Risky", ["Risk"])])
    assert {r.doc_id: r.licences for r in m.collect()} == {1: ["Risky"], 2: ["Risky"], 3: [], 4: []}
    assert set(license_scan.key_words(license_scan.known_sentences())) <= set(license_scan.KEY_WORDS)
