"""Licence scans by sentence rules: sentences map to known identifiers, sequences of which match ordered rules.

Texts are cut into sentences, normalised, and looked up in a fixed table of known licence sentences; the
identifiers found, in order, are matched against rules. DataFrame and SQL functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, each as BREAK cuts it out of the standard wording.
_SENTENCES = {
    "spdx": "SPDX-License-Identifier",
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "mit0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "apache-licensed": "Licensed under the Apache License, Version 2.0",
    "apache-licensed-the-license": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-compliance": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-copy-url": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-copy-url-s": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-program": "This program is licensed under the GNU General Public License, version 3",
    "gpl-program": "This program is free software",
    "gpl-library": "This library is free software",
    "gpl3-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    "gpl2-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl3-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
    "agpl3-later": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl21-later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-foundation": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-foundation": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "gpl-either-2": "either version 2 of the License, or (at your option) any later version",
    "gpl-either-21": "either version 2.1 of the License, or (at your option) any later version",
    "gpl-either-3": "either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "agpl-details": "See the GNU Affero General Public License for more details",
    "lgpl-details": "See the GNU Lesser General Public License for more details",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "bsd-liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "mpl2-copy-plain": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "zlib-origin": "The origin of this software must not be misrepresented",
    "boost-distributed": "Distributed under the Boost Software License, Version 1.0",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION",
    "cc0-waived": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "cc0-without": "This software is distributed without any warranty",
    "cc0-work": "This work is licensed under CC0 1.0",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-4": "Licensed under CC BY 4.0",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "all-rights": "All rights reserved",
    "public-domain": "This work has been released into the public domain",
}
#: Licence names as they stand after the tag of a file header; each is a sentence of its own there.
SPDX = ("MIT", "MIT-0", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "AGPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "MPL-2.0", "EPL-2.0", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "WTFPL")
# Licence, then the sentence identifiers in the order in which the licence has them.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT-0", ("mit0-grant", "mit-warranty", "mit-liability")),
    ("Apache-2.0", ("apache-licensed-the-license", "apache-compliance", "apache-copy", "apache-basis", "apache-see")),
    ("Apache-2.0", ("apache-licensed-the-license", "apache-compliance", "apache-copy-url", "apache-basis", "apache-see")),
    ("Apache-2.0", ("apache-licensed-the-license", "apache-compliance", "apache-copy-url-s", "apache-basis", "apache-see")),
    ("Apache-2.0", ("apache-licensed",)),
    ("AGPL-3.0-or-later", ("agpl3-later", "gpl-hope", "gpl-implied", "agpl-details")),
    ("GPL-3.0-or-later", ("gpl3-later", "gpl-hope", "gpl-implied", "gpl-details")),
    ("GPL-3.0-or-later", ("gpl-foundation", "gpl-either-3", "gpl-hope", "gpl-implied", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl-foundation", "gpl-either-2", "gpl-hope", "gpl-implied", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl2-later", "gpl-hope", "gpl-implied", "gpl-details")),
    ("GPL-2.0-only", ("gpl2-only", "gpl-hope", "gpl-implied", "gpl-details")),
    ("GPL-3.0-only", ("gpl3-only", "gpl-hope", "gpl-implied", "gpl-details")),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("GPL-3.0-only", ("gpl3-program",)),
    ("LGPL-2.1-or-later", ("lgpl-foundation", "gpl-either-21", "lgpl-hope", "gpl-implied", "lgpl-details")),
    ("LGPL-2.1-or-later", ("lgpl21-later", "lgpl-hope", "gpl-implied", "lgpl-details")),
    ("LGPL-3.0-or-later", ("lgpl3-later", "lgpl-hope", "gpl-implied", "lgpl-details")),
    ("LGPL-3.0-or-later", ("lgpl3-later", "gpl-hope", "gpl-implied", "lgpl-details")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("0BSD", ("0bsd-grant", "isc-warranty")),
    ("MPL-2.0", ("mpl2-subject", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-subject", "mpl2-copy-plain")),
    ("EPL-2.0", ("epl2-terms",)),
    ("Zlib", ("zlib-as-is", "zlib-liability", "zlib-grant", "zlib-origin")),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-distributed",)),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("WTFPL", ("wtfpl-title",)),
    ("CC0-1.0", ("cc0-waived", "cc0-without")),
    ("CC0-1.0", ("cc0-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-work",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    *((name, ("spdx", f"spdx-{name.lower()}")) for name in SPDX),
    ("Public-Domain", ("public-domain",)),
)
#: What a text without any of the rules' licences is.
OTHERWISE = ("Proprietary", ("all-rights",))
#: Comment marks and blanks at the start of a line, and the label of a list item there, with the line end before them.
MARKS = r"(^|[\x0A\x0D])(?:[\x20\x09#*/;%><!-]+(?:\([0-9a-z]{1,2}\)[\x20\x09]+|[0-9]{1,2}[.)][\x20\x09]+)?|\([0-9a-z]{1,2}\)[\x20\x09]+|[0-9]{1,2}[.)][\x20\x09]+)"
#: The tag of a file header and its line, which ends there.
TAG = r"(spdx-license-identifier:[^\x0A\x0D]*)"
#: Where a sentence ends: closing punctuation before white space, or a colon, semicolon or empty line there.
#: Single line ends join, as licence texts are wrapped, unless the line itself ends a sentence.
BREAK = r"[.!?:;][)\"']*[\x20\x09-\x0D]+|[\x0A\x0D][\x20\x09]*[\x0A\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip(" ")


def cut(text: str) -> list[str]:
    """The text's normalised sentences, as sentence_ids and the SQL cut them."""
    low = re.sub(TAG, r"\1\n\n", re.sub(MARKS, r"\1", text.translate(str.maketrans(UPPER, LOWER))))
    return [s for s in map(normalised, re.split(BREAK, low)) if s]


#: Normalised sentence by identifier. A sentence that BREAK cuts could never be found.
SENTENCES = {name: normalised(s) for name, s in (_SENTENCES | {f"spdx-{x.lower()}": x for x in SPDX}).items()}
for _name, _s in _SENTENCES.items():
    if cut(_s) != [SENTENCES[_name]]:
        raise ValueError(f"{_name} is not one sentence")


def sentence_ids(text: Column) -> tuple[Column, Column]:
    """How many sentences with a letter or digit the text has, and the known ones' identifiers in order."""
    low = F.regexp_replace(F.translate(text, UPPER, LOWER), MARKS, "$1")
    low = F.when(F.contains(low, F.lit("spdx-")), F.regexp_replace(low, TAG, "$1\n\n")).otherwise(low)
    parts = F.transform(F.split(low, BREAK), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    number = F.size(F.filter(parts, lambda s: s != ""))
    known = F.create_map(*(F.lit(x) for name, sentence in SENTENCES.items() for x in (sentence, name)))
    # only sentences with a length that occurs are looked up
    lengths = F.array(*map(F.lit, sorted({len(s) for s in SENTENCES.values()})))
    ids = F.filter(F.transform(F.filter(parts, lambda s: F.array_contains(lengths, F.length(s))), lambda s: F.try_element_at(known, s)), lambda s: s.isNotNull())
    return number, ids


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, n_known, sentence_ids, licenses) for every row of (doc_id, text).

    Comment marks at line starts are no part of a sentence. A rule matches where its identifiers follow one
    another in the text's sequence of known sentences (unknown ones between them don't matter); licenses lists the
    licences of matching rules once each, in rule order, joined by commas, or OTHERWISE where none matches and
    its sentences are there. A null or empty text has no sentences. Rows are independent: no shuffle, whatever
    repeats; an empty table gives no rows; other columns are ignored.
    """
    number, ids = sentence_ids(F.coalesce(F.col("text"), F.lit("")))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), number.cast("long").alias("n_sentences"), ids.alias("ids"))
    joined = F.concat(F.lit(","), F.array_join("ids", ","), F.lit(","))
    has = lambda rule: F.contains(joined, F.lit(f",{','.join(rule)},"))
    rules = F.array_distinct(F.array_compact(F.array(*(F.when(has(rule), F.lit(name)) for name, rule in RULES))))
    licences = F.when(F.size(rules) > 0, F.array_join(rules, ",")).when(has(OTHERWISE[1]), OTHERWISE[0]).otherwise("")
    # most texts hold no known sentence, and none of the rules is tried on them
    return found.select("doc_id", "n_sentences", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"), F.when(F.size("ids") > 0, licences).otherwise("").alias("licenses"))


def oracle() -> str:
    """The same in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    has = lambda rule: f"contains(joined, {quote(',' + ','.join(rule) + ',')})"
    rules = ",\n    ".join(f"CASE WHEN {has(rule)} THEN {quote(name)} END" for name, rule in RULES)
    return f"""
WITH low AS (
  SELECT doc_id, regexp_replace(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {quote(MARKS)}, '\\1', 'g'), {quote(TAG)}, '\\1' || chr(10) || chr(10), 'g') AS low
  FROM documents
), parts AS (
  SELECT doc_id, list_transform(string_split_regex(low, {quote(BREAK)}), lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'), ' ')) AS parts FROM low
), known AS (
  SELECT doc_id, len(list_filter(parts, lambda s: s <> '')) AS n_sentences,
    list_filter(list_transform(parts, lambda s: CASE s {' '.join(f'WHEN {quote(v)} THEN {quote(k)}' for k, v in SENTENCES.items())} END), lambda x: x IS NOT NULL) AS ids
  FROM parts
), joined AS (
  SELECT *, ',' || coalesce(array_to_string(ids, ','), '') || ',' AS joined FROM known
), matched AS (
  SELECT *, {has(OTHERWISE[1])} AS otherwise, list_filter([
    {rules}], lambda x: x IS NOT NULL) AS found FROM joined
)
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, CAST(len(ids) AS BIGINT) AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  CASE WHEN len(found) > 0 THEN array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ',') WHEN otherwise THEN {quote(OTHERWISE[0])} ELSE '' END AS licenses
FROM matched"""
