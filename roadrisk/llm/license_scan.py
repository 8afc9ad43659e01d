"""Licence scan by sentence rules (DataFrame functions only).

Every text is split into sentences, each normalised (lower case, words and
numbers only) and mapped to a known licence-sentence identifier; the sequence
of identifiers is then matched against licence rules in order. A rule is a
sequence of identifiers that must follow each other among the known sentences
of a text (unknown sentences between them don't matter); the first rule that
fits takes its identifiers away, so a longer rule stands before the shorter
ones it contains. Known sentences that no rule takes are reported apart.

Notices are wrapped in real files: a known sentence may go on over line breaks
with their comment leaders (#, //, *, ;; and the like), though not over a blank
line or an end mark. It starts where a line or a sentence starts and ends where
one ends, so one-line notices without a full stop match too; where several
start, the longest is taken. `oracle` says the same of unwrapped notices.

A text without a known sentence costs one search for the key words that every
known sentence holds one of.

Edge cases: null text is empty; texts without licences give empty lists;
repeated sentences count as often as they occur; repeated rows give equal
rows; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: A sentence ends at a line break, or at . ! ? ; : before white space.
SENTENCE_END = r"[\r\n]+|[.!?;:]+(?=\s)"
NOT_A_WORD = r"[^a-z0-9]+"
#: Whose name may not be used: any holder, also one whose name holds an end mark ('Inc.').
HOLDER = r"(?<=[|\n])neither([ \n])the([ \n])name([ \n])of[ \n][a-z0-9 |\n]{1,200}?[ |\n]nor([ \n])the([ \n])names"
ANY_HOLDER = "neither$1the$2name$3of the copyright holder nor$4the$5names"

# Sentences of public licence notices, normalised when loaded.
SENTENCES = {
    "ApacheShort": "Licensed under the Apache License, Version 2.0",
    "ApacheLong": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "ApacheUse": "you may not use this file except in compliance with the License",
    "ApacheCopy": "You may obtain a copy of the License at",
    "ApacheDist": "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                  "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "ApacheSee": "See the License for the specific language governing permissions and limitations under the License",
    "MITName": "Released under the MIT License",
    "MITLicensed": "Licensed under the MIT License",
    "MITGrant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
                "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
                "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
                "subject to the following conditions",
    "MITNotice": "The above copyright notice and this permission notice shall be included in all copies or substantial "
                 "portions of the Software",
    "MITAsIs": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
               "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "GPL3Work": "This work is licensed under the GNU General Public License, version 3",
    "GPL2Work": "This work is licensed under the GNU General Public License, version 2",
    "GPLFree": "This program is free software",
    "GPL3OrLater": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                   "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "GPL2OrLater": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                   "by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    "BSDGrant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                "that the following conditions are met",
    "BSDSource": "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                 "following disclaimer",
    "BSDBinary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
                 "the following disclaimer in the documentation and/or other materials provided with the distribution",
    "BSDEndorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                  "promote products derived from this software without specific prior written permission",
    "BSDName": "Released under the BSD License",
    "MPL2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CCBY": "Licensed under CC BY 4.0",
    "CCBYSA": "Licensed under CC BY-SA 4.0",
    "CCBYNC": "Licensed under CC BY-NC 4.0",
    "CCBYNCSA": "Licensed under CC BY-NC-SA 4.0",
    "CCBYND": "Licensed under CC BY-ND 4.0",
    "CC0": "Dedicated to the public domain under the CC0 1.0 license",
    "AllRights": "All rights reserved under license",
}

# Licence rules, in the order in which they are tried.
RULES = [
    ("Apache-2.0", ["ApacheLong", "ApacheUse", "ApacheCopy", "ApacheDist", "ApacheSee"]),
    ("Apache-2.0", ["ApacheLong"]),
    ("Apache-2.0", ["ApacheShort"]),
    ("MIT", ["MITGrant", "MITNotice", "MITAsIs"]),
    ("MIT", ["MITGrant"]),
    ("MIT", ["MITName"]),
    ("MIT", ["MITLicensed"]),
    ("GPL-3.0-or-later", ["GPLFree", "GPL3OrLater"]),
    ("GPL-2.0-or-later", ["GPLFree", "GPL2OrLater"]),
    ("GPL-3.0", ["GPL3Work"]),
    ("GPL-2.0", ["GPL2Work"]),
    ("BSD-3-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse"]),
    ("BSD-2-Clause", ["BSDGrant", "BSDSource", "BSDBinary"]),
    ("BSD", ["BSDName"]),
    ("MPL-2.0", ["MPL2"]),
    ("CC-BY-NC-SA-4.0", ["CCBYNCSA"]),
    ("CC-BY-NC-4.0", ["CCBYNC"]),
    ("CC-BY-SA-4.0", ["CCBYSA"]),
    ("CC-BY-ND-4.0", ["CCBYND"]),
    ("CC-BY-4.0", ["CCBY"]),
    ("CC0-1.0", ["CC0"]),
]

#: Every sentence above holds one of these (a test checks it).
KEY_WORDS = ["licen", "permi", "redistribut", "software"]


def key_words(known) -> list[str]:
    """Words of which every one of the known (normalised) sentences holds one: the
    ones above and, for a sentence without, its longest word that is no holder's name."""
    out = [w for w in KEY_WORDS if any(w in s for s in known)]
    for s in known:
        if not any(w in s for w in out):
            out.append(max((w for w in s.split() if w not in re.split(r"\$\d| ", ANY_HOLDER)), key=len, default=""))
    return out


def normalise(sentence: str) -> str:
    return re.sub(NOT_A_WORD, " ", sentence.lower()).strip()


def known_sentences(sentences: dict[str, str] = SENTENCES) -> dict[str, str]:
    """Normalised sentence -> identifier. A sentence that the splitter cuts is
    known by its pieces: the first piece carries the identifier."""
    out: dict[str, str] = {}
    for ident, text in sentences.items():
        out.setdefault(normalise(re.split(SENTENCE_END, text)[0]), ident)
    return out


def sql_text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def words_and_breaks(text: Column) -> Column:
    """Normalised words with a space, a line break or | (an end mark) between
    them; two breaks in a row are a blank line."""
    t = F.regexp_replace(F.concat(F.lit("\n"), F.translate(F.lower(text), "|", ","), F.lit("\n")), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?<=\n)[\p{Punct} \t]+", "")  # comment leaders: their ; : ! . end nothing
    t = F.regexp_replace(t, r"[.!?;:]+(?=\s)", "|")
    t = F.regexp_replace(t, r"[^a-z0-9|\n]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r" ?([|\n]) ?", "$1"), HOLDER, ANY_HOLDER)


def known_pattern(known: dict[str, str]) -> str:
    """Matches known sentences in `words_and_breaks`, the longest first."""
    longest = sorted(known, key=lambda s: (-len(s), s))
    return r"(?<=[|\n])(?:" + "|".join(s.replace(" ", r"[ \n]") for s in longest) + r")(?=[|\n])"


def license_matches(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """(doc_id, sentence_ids, licences, unmatched): arrays of strings, one row
    per row of ``docs``; licences in rule order, each as often as it matched."""
    known = known_sentences(sentences)
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    text = text_or_empty()
    found = F.regexp_extract_all(words_and_breaks(text), F.lit(known_pattern(known)), F.lit(0))
    ids = F.transform(found, lambda s: F.try_element_at(table, F.translate(s, "\n", " ")))
    low = F.lower(text)
    maybe = F.lit(False)
    for w in key_words(known):
        maybe = maybe | low.contains(w)
    d = docs.select("doc_id", F.when(maybe, ids).otherwise(F.array().cast("array<string>")).alias("sentence_ids"))
    # identifiers as '<a><b>': a rule is a run of them, and leaves '<>' behind
    seq = F.when(F.size("sentence_ids") > 0, F.concat(F.lit("<"), F.array_join("sentence_ids", "><"), F.lit(">"))).otherwise("")
    d = d.withColumn("__left", seq).withColumn("licences", F.array().cast("array<string>"))
    for name, run in rules:
        token = "".join(f"<{x}>" for x in run)
        n = ((F.length("__left") - F.length(F.replace("__left", F.lit(token), F.lit("")))) / len(token)).cast("int")
        d = d.select("doc_id", "sentence_ids", F.replace("__left", F.lit(token), F.lit("<>")).alias("__left"),
                     F.concat("licences", F.array_repeat(F.lit(name), n)).alias("licences"))
    rest = F.filter(F.split(F.regexp_replace("__left", "^<|>$", ""), "><"), lambda x: x != "")
    return d.select("doc_id", "sentence_ids", "licences", rest.alias("unmatched"))


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_known long, sentence_ids, licences, unmatched): lists joined by commas."""
    m = license_matches(docs)
    join = lambda c: F.array_join(c, ",").alias(c)
    return m.select("doc_id", F.size("sentence_ids").cast("long").alias("n_known"),
                    join("sentence_ids"), join("licences"), join("unmatched"))


def oracle() -> str:
    """DuckDB SQL for the rows of `license_scan`."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    known = known_sentences()
    keys, ids = ", ".join(map(q, known)), ", ".join(map(q, known.values()))
    left, found = "seq", "''"
    steps = []
    for i, (name, run) in enumerate(RULES):
        token = "".join(f"<{x}>" for x in run)
        steps.append(
            f"s{i + 1} AS (SELECT doc_id, ids, replace(seq, {q(token)}, '<>') AS seq, "
            f"found || repeat({q(name + ',')}, CAST((length(seq) - length(replace(seq, {q(token)}, ''))) / {len(token)} AS BIGINT)) "
            f"AS found FROM s{i})")
    del left
    return f"""
WITH t AS (
  SELECT doc_id, list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?;:]+)([ \\t\\n\\x0B\\f\\r])', chr(10) || '\\2', 'g'), '[\\r\\n]+'),
                                lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))) AS norm
  FROM documents),
k AS (SELECT doc_id, list_filter(list_transform(norm, lambda s: list_extract([{ids}], list_position([{keys}], s))),
                                 lambda x: x IS NOT NULL) AS ids FROM t),
s0 AS (SELECT doc_id, ids, CASE WHEN len(ids) > 0 THEN '<' || array_to_string(ids, '><') || '>' ELSE '' END AS seq,
              {found} AS found FROM k),
{", ".join(steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids, rtrim(found, ',') AS licences,
       coalesce(array_to_string(list_filter(string_split(regexp_replace(seq, '^<|>$', '', 'g'), '><'), lambda x: x <> ''), ','), '') AS unmatched
FROM s{len(RULES)}"""
