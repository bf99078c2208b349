"""Licence recognition by sentences and rules.

A text is taken apart into sentences, each is normalised (case, punctuation and white space), and the
known licence sentences become identifiers. What is left of a document is a sequence of identifiers,
and ordered rules are applied to it: each is a sequence of identifiers that stands for a licence, the
longer and more exact ones first, and what a rule has taken no later rule sees.

Comment signs and list numbers at the beginning of lines are taken off first. Sentences run over line
ends, as licences are wrapped; within a stretch that is not known as a whole, known sentences are looked
for from every line start to every line end, so one after a line without a full stop is found.

Cases: a null text has no sentences; a text is read whole; repeated rows get the same result; an empty
table gives an empty result; a known sentence that no rule takes is counted but names no licence; one
licence found several times is listed as often, in the order of the text. Extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vespertide.llm.common import ascii_lower, read_table, whole_text

# Sentences of public licences, as they are written there.
SENTENCES = {
    "apache-2-line": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0", "Licensed under the Apache License 2.0."],
    "apache-2-grant": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "apache-2-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-2-as-is": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "apache-2-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "mit-line": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "MIT License"],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-as-is": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "mit-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "isc-line": ["Licensed under the ISC License.", "ISC License"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd-as-is": ['THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'],
    "bsd-liability": ["IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."],
    "isc-as-is": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'],
    "isc-liability": ["IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "bsd-2-line": ["Licensed under the BSD 2-Clause License.", "BSD 2-Clause License"],
    "bsd-3-line": ["Licensed under the BSD 3-Clause License.", "BSD 3-Clause License"],
    "gpl-3-line": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "GNU General Public License v3.0"],
    "gpl-2-line": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "GNU General Public License v2.0"],
    "gpl-3-grant": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-2-grant": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl-see": ["See the GNU General Public License for more details."],
    "lgpl-3-line": ["This work is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the GNU Lesser General Public License, version 3."],
    "agpl-3-line": ["This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU Affero General Public License, version 3."],
    "mpl-2-grant": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl-2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "unlicense-grant": ["This is free and unencumbered software released into the public domain."],
    "unlicense-anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "cc0-line": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}
# Creative Commons lines are made from the kinds there are.
for _kind in ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"]:
    for _version in ["3.0", "4.0"]:
        SENTENCES[f"cc-{_kind.lower()}-{_version}-line"] = [f"{_verb} under CC {_kind} {_version}." for _verb in ("Licensed", "This work is licensed", "Released")]

#: Licences that a tag of the form "SPDX-License-Identifier: X" names.
TAGGED = ["Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-3.0-only", "AGPL-3.0-only", "MPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-NC-4.0"]
SENTENCES |= {f"tag-{t.lower()}": [f"SPDX-License-Identifier: {t}"] for t in TAGGED}

#: Ordered: a longer sequence comes before those that are part of it.
RULES: list[tuple[str, list[str]]] = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is", "bsd-liability"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability"]),
    ("ISC", ["isc-line", "isc-grant", "isc-as-is", "isc-liability"]),
    ("ISC", ["isc-grant", "isc-as-is", "isc-liability"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("Apache-2.0", ["apache-2-grant", "apache-2-copy", "apache-2-as-is", "apache-2-see"]),
    ("MIT", ["mit-line", "mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("ISC", ["isc-line", "isc-grant"]),
    ("GPL-3.0-or-later", ["gpl-3-grant", "gpl-hope", "gpl-see"]),
    ("GPL-2.0-or-later", ["gpl-2-grant", "gpl-hope", "gpl-see"]),
    ("MPL-2.0", ["mpl-2-grant", "mpl-2-copy"]),
    ("Unlicense", ["unlicense-grant", "unlicense-anyone"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache-2-grant"]),
    ("ISC", ["isc-grant"]),
    ("GPL-3.0-or-later", ["gpl-3-grant"]),
    ("GPL-2.0-or-later", ["gpl-2-grant"]),
    ("MPL-2.0", ["mpl-2-grant"]),
    ("Unlicense", ["unlicense-grant"]),
    ("Apache-2.0", ["apache-2-line"]),
    ("MIT", ["mit-line"]),
    ("ISC", ["isc-line"]),
    ("BSD-2-Clause", ["bsd-2-line"]),
    ("BSD-3-Clause", ["bsd-3-line"]),
    ("GPL-3.0", ["gpl-3-line"]),
    ("GPL-2.0", ["gpl-2-line"]),
    ("LGPL-3.0", ["lgpl-3-line"]),
    ("AGPL-3.0", ["agpl-3-line"]),
    ("CC0-1.0", ["cc0-line"]),
]
RULES += [(k.removesuffix("-line").upper(), [k]) for k in SENTENCES if k.startswith("cc-")]
RULES += [(t, [f"tag-{t.lower()}"]) for t in TAGGED]

BREAK = r"([.!?])[ \t\r\n]+|\n[ \t\r]*\n"
#: Comment signs and list numbers at the beginning of a line.
LEADER = r"(^|\n)[ \t]*(?:#+|//+|/\*+|\*+/|\*+|--+|;+|%+|<!--|dnl |rem |REM )?[ \t]*(?:\([0-9a-z]\)|[0-9]{1,2}[.)])?[ \t]*"
#: Every known sentence holds one of these, so a text without them has none.
HINT = "(?i)licen|permission|distribut|notice|warrant|liable|endorse|public|software|law|(?<![a-z0-9])cc(?![a-z0-9])"


def normalised(sentence: str) -> str:
    """The same as the column expression, for the known sentences."""
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m.group().lower(), sentence)).strip(" ")


#: What a known sentence becomes; one with a break inside ("v. 2.0") is known by what stands before it.
KNOWN = {normalised(re.split(BREAK, s)[0]): name for name, written in SENTENCES.items() for s in written}
#: A known sentence from line start to line end, in text whose line ends are doubled so that each line has its own.
WITHIN = "\n(" + "|".join(k.replace(" ", "(?: |\n\n)") for k in sorted(KNOWN, key=lambda k: (-len(k), k))) + ")\n"


def plain_lines(sentence: Column) -> Column:
    """Lower case, only letters, digits, single blanks and line ends."""
    some = F.regexp_replace(ascii_lower(sentence), "[^a-z0-9\n]+", " ")
    return F.regexp_replace(F.regexp_replace(some, " *\n[ \n]*", "\n"), "^[ \n]+|[ \n]+$", "")


def identifier(plain: Column) -> Column:
    """Identifier of a sentence in its plain form, or null."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    return F.try_element_at(known, F.regexp_replace(plain, "\n+", " "))


def identifiers(text: Column) -> Column:
    """Sequence of the identifiers of the known sentences of a text."""
    bare = F.regexp_replace(whole_text(text), LEADER, "$1")
    sentences = F.transform(F.split(F.regexp_replace(bare, BREAK, "$1\x1e"), "\x1e", -1), plain_lines)

    def within(s: Column) -> Column:
        doubled = F.concat(F.lit("\n"), F.replace(s, F.lit("\n"), F.lit("\n\n")), F.lit("\n"))
        return F.transform(F.regexp_extract_all(doubled, F.lit(WITHIN), F.lit(1)), identifier)

    none = F.array().cast("array<string>")
    found = F.transform(sentences, lambda s: F.when(identifier(s).isNotNull(), F.array(identifier(s))).when(F.contains(s, F.lit("\n")), within(s)).otherwise(none))
    return F.when(whole_text(text).rlike(HINT), F.array_compact(F.flatten(found))).otherwise(none)


def apply_rules(sequence: Column) -> Column:
    """Licences of a sequence of identifiers, in the order of the text."""
    left = F.array_join(F.transform(sequence, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    for licence, rule in RULES:
        left = F.replace(left, F.lit("".join(f"<{x}>" for x in rule)), F.lit(f"{{{licence}}}"))
    return F.regexp_extract_all(left, F.lit(r"\{([^}]*)\}"), F.lit(1))


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with __vt_sentences (identifiers in order) and __vt_licenses (licences in order)."""
    found = docs.withColumn("__vt_sentences", identifiers(F.col(text_col)))
    return found.withColumn("__vt_licenses", F.when(F.size("__vt_sentences") > 0, apply_rules(F.col("__vt_sentences"))).otherwise(F.array().cast("array<string>")))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    out = scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("__vt_sentences").cast("long").alias("n_sentences"), F.array_join("__vt_sentences", ",").alias("sentences"), F.array_join("__vt_licenses", ",").alias("licenses"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in KNOWN.items()) + "}"
    lower = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    plain = r"regexp_replace(regexp_replace(regexp_replace(" + lower + r", '[^a-z0-9\n]+', ' ', 'g'), ' *\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
    one = lambda s: rf"known[regexp_replace({s}, '\n+', ' ', 'g')]"
    within = f"list_transform(regexp_extract_all(chr(10) || replace(s, chr(10), chr(10) || chr(10)) || chr(10), {quoted(WITHIN)}, 1), lambda l: {one('l')})"
    left = "array_to_string(list_transform(ids, lambda x: '<' || x || '>'), '')"
    for licence, rule in RULES:
        left = f"replace({left}, {quoted(''.join(f'<{x}>' for x in rule))}, {quoted('{' + licence + '}')})"
    return rf"""
WITH k AS (SELECT {known} AS known),
b AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{LEADER}', '\1', 'g') AS bare FROM documents),
s AS (SELECT doc_id, list_transform(string_split(regexp_replace(bare, '{BREAK}', '\1' || chr(30), 'g'), chr(30)), lambda x: {plain.format('x')}) AS ss FROM b),
f AS (SELECT doc_id, list_filter(flatten(list_transform(ss, lambda s: CASE WHEN {one('s')} IS NOT NULL THEN [{one('s')}] WHEN contains(s, chr(10)) THEN {within} ELSE [] END)), lambda x: x IS NOT NULL) AS ids FROM s, k)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentences, coalesce(array_to_string(regexp_extract_all({left}, '\{{([^}}]*)\}}', 1), ','), '') AS licenses FROM f
"""


OP7_SQL = _sql()
