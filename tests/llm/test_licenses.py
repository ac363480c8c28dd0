"""Licence rules on the standard notices as they stand in files: plain, wrapped, numbered, and inside comments."""

import duckdb
import pytest

from gramquarry.llm import licenses

MIT = """MIT License

Copyright (c) 2021 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so{then}
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
MIT_THEN = """, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

"""
APACHE = """Copyright 2020 The Authors.

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http{s}://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """{This} is free software{sign} you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation{then} either version {version} of the License, or
(at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
GPL_ONLY = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version {version} as
published by the Free Software Foundation.

This program is distributed in the hope that it will be useful, but
WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
Public License for more details."""
BSD = """Copyright (c) 2019, Jane Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{more}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)."""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """Copyright 2018 Jane Doe

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted{then}.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY DAMAGES."""
ISC_THEN = """, provided that the above
copyright notice and this permission notice appear in all copies"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http{s}://mozilla.org/MPL/2.0/."""
EPL = """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software.
2. Altered source versions must be plainly marked as such."""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""
CC0 = """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."""
WTFPL = """Everyone may copy this.

            DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
   TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

  0. You just DO WHAT THE FUCK YOU WANT TO."""


def gpl(what, version, kind="", sign=":", then=","):
    return GPL.format(This=f"This {what}", what=what, version=version, kind=kind, sign=sign, then=then)


NOTICES = [
    ("MIT", MIT.format(then=MIT_THEN)), ("MIT-0", MIT.format(then=".\n\n")), ("Apache-2.0", APACHE.format(s="")), ("Apache-2.0", APACHE.format(s="s")),
    ("Apache-2.0", APACHE.format(s="").replace("at\n\n   ", "at")), ("Apache-2.0", APACHE.format(s="s").replace("at\n\n   ", "at")),
    ("GPL-3.0-or-later", gpl("program", "3")), ("GPL-3.0-or-later", gpl("program", "3", then=";")), ("GPL-2.0-or-later", gpl("program", "2", sign=";", then=";")), ("GPL-2.0-or-later", gpl("program", "2", sign=";")),
    ("AGPL-3.0-or-later", gpl("program", "3", "Affero ")), ("LGPL-2.1-or-later", gpl("library", "2.1", "Lesser ", ";", ";")), ("LGPL-2.1-or-later", gpl("library", "2.1", "Lesser ", ";")),
    ("LGPL-3.0-or-later", gpl("library", "3", "Lesser ")), ("LGPL-3.0-or-later", gpl("program", "3", "Lesser ")), ("GPL-2.0-only", GPL_ONLY.format(version=2)), ("GPL-3.0-only", GPL_ONLY.format(version=3)),
    ("BSD-2-Clause", BSD.format(more="")), ("BSD-3-Clause", BSD.format(more=ENDORSE)), ("BSD-3-Clause", BSD.format(more=ENDORSE).replace("\n1. ", "\n* ").replace("\n2. ", "\n(b) ").replace("\n3. ", "\n    - ")),
    ("ISC", ISC.format(then=ISC_THEN)), ("0BSD", ISC.format(then="")), ("MPL-2.0", MPL.format(s="s")), ("MPL-2.0", MPL.format(s="")), ("EPL-2.0", EPL), ("Zlib", ZLIB), ("BSL-1.0", BOOST),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)"), ("Unlicense", UNLICENSE), ("CC0-1.0", CC0), ("CC0-1.0", "This work is licensed under CC0 1.0."), ("WTFPL", WTFPL),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT license"), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "This program is licensed under the GNU General Public License, version 3."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."), ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."), ("Public-Domain", "This work has been released into the public domain."), ("Proprietary", "Copyright 2001 Jane Doe. All rights reserved."),
    *((x, f"SPDX-License-Identifier: {x}\nCopyright 2020 Jane Doe") for x in licenses.SPDX),
]
COMMENTS = [("", "", ""), ("# ", "", ""), (" * ", "/*\n", "\n */"), ("// ", "", ""), (";; ", "", ""), ("-- ", "", ""), ("> ", "Quoted:\n\n", "")]


def commented(text, style):
    mark, before, after = style
    # editors leave no blank after the mark on an empty line
    return before + "\n".join((mark + x).rstrip() for x in text.split("\n")) + after


@pytest.fixture(scope="module")
def planted():
    rows = [(name, commented(text, style)) for name, text in NOTICES for style in COMMENTS]
    return [(i, name, t) for i, (name, t) in enumerate(rows)]


def test_every_rule_fires_on_its_notice(planted):
    """By the rules in plain Python: each rule matches some notice, and no notice has another licence."""
    fired = set()
    for _, name, t in planted:
        ids = [k for s in licenses.cut(t) for k, v in licenses.SENTENCES.items() if v == s]
        joined = f",{','.join(ids)},"
        hit = [rule for rule in licenses.RULES if f",{','.join(rule[1])}," in joined]
        fired.update(hit)
        assert ({licence for licence, _ in hit} or {licenses.OTHERWISE[0]}) == {name}, t
    assert fired == set(licenses.RULES)


def test_notices_in_files(spark, planted):
    df = spark.createDataFrame([(i, t) for i, _, t in planted], "doc_id long, text string")
    out = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert [(i, out[i].licenses) for i, _, _ in planted] == [(i, name) for i, name, _ in planted]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, _, t in planted])
    rows = con.execute(licenses.oracle()).fetchall()
    assert sorted(rows) == sorted(tuple(out[i]) for i in out)


def test_order_and_place(spark):
    notice = licenses._SENTENCES
    turned = ". ".join(notice[x] for x in ("mit-warranty", "mit-notice", "mit-grant", "mit-liability"))
    two = "Released under the MIT License. Something else entirely. Licensed under CC BY 4.0. All rights reserved."
    rows = [(0, turned), (1, two), (2, "the MIT License is what others are released under"), (3, "# " * 20000 + "\n" + "*" * 50000 + "\nAll rights reserved"), (4, "mit. isc. spdx-license-identifier: nothing known")]
    out = {r.doc_id: r.licenses for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {0: "", 1: "MIT,CC-BY-4.0", 2: "", 3: "Proprietary", 4: ""}
