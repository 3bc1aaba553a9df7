"""License scans: sentences to known identifiers, identifier sequences to ordered rules.

A text is cut into sentences, a sentence is normalised (letters and digits in
lower case, one space between words), and known ones become identifiers.  Rules
are tried in order, each on the identifiers that the rules before it have left:
where a rule's identifiers stand one after another, they become its license.
Everything is one projection of native functions over the scan: no shuffle, no
Python.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import register, table

# Sentences of public license notices, by identifier.  A line holds one sentence.
NOTICES = {
    "apache2-licensed": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")", "This work is licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0"],
    "apache2-use": ["you may not use this file except in compliance with the License"],
    "apache2-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "apache2-warranty": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "apache2-see": ["See the License for the specific language governing permissions and limitations under the License"],
    "mit-released": ["Released under the MIT License", "Licensed under the MIT License", "This work is licensed under the MIT License", "This project is licensed under the MIT License", "The MIT License (MIT)", "MIT License"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "mit-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"],
    "bsd-redistribute": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"],
    "gpl3-licensed": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Released under the GNU General Public License, version 3"],
    "gpl2-licensed": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2", "Released under the GNU General Public License, version 2"],
    "gpl-redistribute-3-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl-redistribute-2-later": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "gpl-details": ["See the GNU General Public License for more details"],
    "mpl2-subject": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0"],
    "mpl2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"],
    "cc-by-4": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-4": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc-4": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nd-4": ["Licensed under CC BY-ND 4.0", "This work is licensed under CC BY-ND 4.0"],
    "unlicense-released": ["This is free and unencumbered software released into the public domain"],
    "reserved": ["All rights reserved"],
}

#: In order; longer sequences stand before what they begin with.
RULES = [
    ("Apache-2.0", ["apache2-licensed", "apache2-use", "apache2-copy", "apache2-warranty", "apache2-see"]),
    ("Apache-2.0", ["apache2-licensed", "apache2-copy", "apache2-warranty", "apache2-see"]),
    ("Apache-2.0", ["apache2-licensed"]),
    ("MIT", ["mit-released", "mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-released"]),
    ("BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("GPL-3.0-or-later", ["gpl-redistribute-3-later", "gpl-warranty", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl-redistribute-2-later", "gpl-warranty", "gpl-details"]),
    ("GPL-3.0", ["gpl3-licensed"]),
    ("GPL-2.0", ["gpl2-licensed"]),
    ("MPL-2.0", ["mpl2-subject", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-subject"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("Unlicense", ["unlicense-released"]),
    ("All-rights-reserved", ["reserved"]),
]

#: Every known sentence has one of these, within a word; a text without any is not cut into sentences.
HINTS = ["licens", "copyright", "permission", "warrant", "redistribut", "software", "reserved", "mozilla"]

#: The end of a sentence: its sign and the white space behind it, or an empty line.
SENTENCE_END = r"([.;:!?][\"')\]]*)[ \t\r\n]+|\n[ \t\r]*\n"
#: Comment marks and list numbers at the start of a line.
LINE_MARK = r"\n[ \t]*(?:[*#;/%-]+|//+|\(?[0-9a-z]{1,2}[.)])[ \t]+"
MARK = "\x01"


def normalise_text(s: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", s.lower()).strip()


KNOWN = {normalise_text(s): name for name, sentences in NOTICES.items() for s in sentences}


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def sentences(text: Column) -> Column:
    """Normalised sentences in order; one over several lines that is not known as a whole is taken line by line."""
    cut = F.split(F.regexp_replace(F.regexp_replace(F.concat(F.lit("\n"), text), LINE_MARK, "\n"), SENTENCE_END, "$1" + MARK), MARK)
    known = F.array(*map(F.lit, KNOWN))
    return F.flatten(F.transform(cut, lambda s: F.when(F.array_contains(known, normalised(s)), F.array(normalised(s))).otherwise(F.transform(F.split(s, "\n"), normalised))))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, sentence_ids, licenses, unmatched.

    ``sentence_ids``: the known sentences' identifiers in text order, each in
    angle brackets; ``licenses``: the licenses in order, joined by a comma, each
    once; ``unmatched``: identifiers that no rule took.  All empty for a null or
    empty text and one without license sentences.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low = F.lower(text)
    hinted = reduce(lambda a, b: a | b, [F.contains(low, F.lit(h)) for h in HINTS])
    names = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    ids = F.when(hinted, F.filter(F.transform(sentences(text), lambda s: F.try_element_at(names, s)), lambda s: s.isNotNull()))
    found = F.when(F.size("ids") > 0, F.concat(F.lit("<"), F.array_join("ids", "><"), F.lit(">"))).otherwise("")
    taken = reduce(lambda s, r: F.replace(s, F.lit("".join(f"<{i}>" for i in r[1])), F.lit(f"[{r[0]}]")), RULES, F.col("sentence_ids"))
    rows = docs.select("doc_id", ids.alias("ids")).select("doc_id", found.alias("sentence_ids")).withColumn("taken", taken)
    return rows.select(
        "doc_id",
        "sentence_ids",
        F.array_join(F.array_distinct(F.regexp_extract_all("taken", F.lit(r"\[([^\]]*)\]"), F.lit(1))), ",").alias("licenses"),
        F.array_join(F.regexp_extract_all("taken", F.lit("<([^>]*)>"), F.lit(1)), ",").alias("unmatched"),
    )


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    names = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in KNOWN.items()) + "}"
    taken = "ids"
    for name, parts in RULES:
        taken = f"replace({taken}, {quote(''.join(f'<{i}>' for i in parts))}, '[{name}]')"
    norm = lambda s: f"trim(regexp_replace(lower({s}), '[^a-z0-9]+', ' ', 'g'))"
    return rf"""
WITH n AS (SELECT {names} AS names),
s AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(chr(10) || coalesce(text, ''), '{LINE_MARK}', chr(10), 'g'), '{SENTENCE_END.replace("'", "''")}', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
u AS (SELECT doc_id, flatten(list_transform(parts, lambda p: CASE WHEN names[{norm("p")}] IS NOT NULL THEN [{norm("p")}] ELSE list_transform(string_split(p, chr(10)), lambda l: {norm("l")}) END)) AS units, names FROM s, n),
i AS (SELECT doc_id, list_filter(list_transform(units, lambda x: names[x]), lambda x: x IS NOT NULL) AS l FROM u),
j AS (SELECT doc_id, CASE WHEN len(l) > 0 THEN '<' || array_to_string(l, '><') || '>' ELSE '' END AS ids FROM i),
t AS (SELECT doc_id, ids, {taken} AS taken FROM j),
d AS (SELECT doc_id, ids, taken, regexp_extract_all(taken, '\[([^\]]*)\]', 1) AS l FROM t)
SELECT doc_id, ids AS sentence_ids, array_to_string(list_filter(l, lambda x, k: list_position(l, x) = k), ',') AS licenses,
  array_to_string(regexp_extract_all(taken, '<([^>]*)>', 1), ',') AS unmatched FROM d
"""


@register("op7_license_scan", _sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
