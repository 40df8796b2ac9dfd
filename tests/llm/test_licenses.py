"""Licence notices in the forms that files hold them in."""

import textwrap

import pytest

from graphloom.llm import licenses

PROVIDED = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE.'
BSD = [
    "Copyright (c) 2020, A. Person. All rights reserved.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
]
GIVEN = 'THIS SOFTWARE IS PROVIDED BY {} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
FREE = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; {}."
HOPE = "This {} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
FEE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
DISCLAIMS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'
#: Identifiers, licence and paragraphs; together they meet every rule.
NOTICES = [
    ([1], "Apache-2.0", ["Licensed under the Apache License, Version 2.0."]),
    ([1, 17, 18], "Apache-2.0", ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software is distributed on an \"AS IS\" BASIS."]),
    ([1, 17, 18], "Apache-2.0", ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0']),
    ([8], "Apache-2.0", ["SPDX-License-Identifier: Apache-2.0"]),
    ([13, 14, 15], "BSD-2-Clause", BSD[:4]),
    ([13, 14, 15, 16], "BSD-3-Clause", BSD),
    ([5], "CC-BY-4.0", ["This work is licensed under CC BY 4.0."]),
    ([4], "CC-BY-NC-4.0", ["Licensed under CC BY-NC 4.0"]),
    ([6], "CC-BY-SA-4.0", ["This work is licensed under CC BY-SA 4.0. To view a copy, visit the site."]),
    ([3], "GPL-3.0-only", ["This work is licensed under the GNU General Public License version 3."]),
    ([9], "GPL-3.0-only", ["SPDX-License-Identifier: GPL-3.0-only"]),
    ([19, 20], "GPL-3.0-or-later", ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."]),
    ([2], "MIT", ["Released under the MIT License."]),
    ([7], "MIT", ["SPDX-License-Identifier: MIT"]),
    *[([licenses.SENTENCES.index("spdx license identifier " + name.lower().replace("-", " ").replace(".", " ")) + 1], name, [f"SPDX-License-Identifier: {name}"]) for name in licenses.SHORT],
    ([19], "GPL-3.0-or-later", [FREE.format("program", "", "either version 3 of the License, or (at your option) any later version")]),
    ([21, 20], "GPL-2.0-or-later", [FREE.format("program", "", "either version 2 of the License, or (at your option) any later version"), HOPE.format("program")]),
    ([22, 20], "GPL-2.0-only", ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", HOPE.format("program")]),
    ([23], "GPL-3.0-only", ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation."]),
    ([24, 20], "AGPL-3.0-or-later", [FREE.format("program", "Affero ", "either version 3 of the License, or (at your option) any later version"), HOPE.format("program")]),
    ([25, 27], "LGPL-2.1-or-later", [FREE.format("library", "Lesser ", "either version 2.1 of the License, or (at your option) any later version"), HOPE.format("library")]),
    ([26, 27], "LGPL-3.0-or-later", [FREE.format("library", "Lesser ", "either version 3 of the License, or (at your option) any later version"), HOPE.format("library")]),
    ([28, 29], "MPL-2.0", ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."]),
    ([30, 32], "ISC", ["Copyright (c) 2020, A. Person", FEE + ", provided that the above copyright notice and this permission notice appear in all copies.", DISCLAIMS]),
    ([37], "MIT", ["This project is licensed under the MIT License."]),
    ([38], "BSD-2-Clause", ["Licensed under the BSD 2-Clause License."]),
    ([39], "BSD-3-Clause", ["Licensed under the BSD 3-Clause License."]),
    ([40], "GPL-2.0-only", ["This work is licensed under the GNU General Public License version 2."]),
    *[([n], name, [f"This work is licensed under a Creative Commons {words} 4.0 International License."]) for n, name, words in ((41, "CC-BY-4.0", "Attribution"), (42, "CC-BY-SA-4.0", "Attribution-ShareAlike"), (43, "CC-BY-NC-4.0", "Attribution-NonCommercial"), (44, "CC-BY-ND-4.0", "Attribution-NoDerivatives"), (45, "CC-BY-NC-SA-4.0", "Attribution-NonCommercial-ShareAlike"))],
    ([46], "CC0-1.0", ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."]),
    ([47, 48], "Unlicense", ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."]),
    ([49, 50], "Zlib", ["This software is provided 'as-is', without any express or implied warranty.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"]),
    ([51], "BSL-1.0", ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)"]),
    ([52], "WTFPL", ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."]),
    ([53], "EPL-2.0", ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0;"]),
    ([54], "EUPL-1.2", ["Licensed under the European Union Public Licence, Version 1.2."]),
    ([13, 14, 15, 55, 16], "BSD-4-Clause", [*BSD[:4], "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization.", BSD[4].replace("3.", "4.")]),
    ([13, 14, 15, 16, 56], "BSD-3-Clause-Clear", [*BSD, "NO EXPRESS OR IMPLIED LICENSES TO ANY PARTY'S PATENT RIGHTS ARE GRANTED BY THIS LICENSE."]),
    ([13, 14, 15, 57, 34], "LicenseRef-BSD-like", [*BSD[:4], "3. Redistributions of any kind must retain a list of all that was changed, with dates.", GIVEN.format("THE COPYRIGHT HOLDERS AND CONTRIBUTORS")]),
    ([58], "Apache-2.0", ["Apache License Version 2.0, January 2004"]),
    ([59], "GPL-3.0-only", ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"]),
    ([60], "GPL-2.0-only", ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"]),
    ([61], "LGPL-3.0-only", ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"]),
    ([62], "AGPL-3.0-only", ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"]),
    ([63], "LGPL-2.1-only", ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"]),
    ([64], "MPL-2.0", ["Mozilla Public License Version 2.0"]),
    ([10, 11, 12], "MIT", ["Copyright (c) 2020 A. Person", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:', "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", PROVIDED]),
]


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["sentence_ids"], r["licenses"]) for r in licenses.scan_licenses(docs).orderBy("doc_id").collect()]


def test_notices_meet_every_rule():
    met = {(tuple(ids[: len(rule)]), name) for ids, name, _ in NOTICES for other, rule in licenses.RULES if other == name and tuple(ids[: len(rule)]) == rule}
    assert met == {(ids, name) for name, ids in licenses.RULES}
    assert all(any(a in s for a in licenses.ANCHORS) for s in (*licenses.SENTENCES, *licenses.VARIANTS)) and len(licenses.ANCHORS) < 12


@pytest.mark.parametrize("start", ["", " * ", "# ", "// "])
def test_wrapped_notices(spark, start):
    texts, want = [], []
    for ids, name, paragraphs in NOTICES:
        for width, end, gap in ((10_000, "\n", [""]), (76, "\n", [""]), (40, "\r\n", [""]), (25, "\n", [])):
            rows = [line for p in paragraphs for line in [*textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False), *gap]]
            texts.append(end.join(["/**" if start else "Some title", *[start + r for r in rows], "", "x = 1"]))
            want.append((ids, [name]))
    assert scan(spark, texts) == want


def test_whole_published_texts(spark):
    mit = "MIT License\n\n" + "\n\n".join(textwrap.fill(p, 78) for p in next(p for ids, _, p in NOTICES if ids == [10, 11, 12]))
    mit += "\n" + textwrap.fill("IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", 78)
    apache = '#   Licensed under the Apache License, Version 2.0 (the "License");\n#   you may not use this file except in compliance with the License.\n#   You may obtain a copy of the License at\n#\n#       http://www.apache.org/licenses/LICENSE-2.0\n#\n#   Unless required by applicable law or agreed to in writing, software\n#   distributed under the License is distributed on an "AS IS" BASIS,\n#   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n#   See the License for the specific language governing permissions and\n#   limitations under the License.\nimport os\n'
    texts = [mit, apache, "// SPDX-License-Identifier: MIT\nint x;", "/* SPDX-License-Identifier: Apache-2.0 */ int x;", "<!-- SPDX-License-Identifier: CC0-1.0 --><p>", "word " * 30_000 + ". Licensed under the MIT License. " + "word " * 30_000, None, "", mit]
    got = scan(spark, texts)
    assert [n for _, n in got] == [["MIT"], ["Apache-2.0"], ["MIT"], ["Apache-2.0"], ["CC0-1.0"], ["MIT"], [], [], ["MIT"]]
    assert got[0][0] == [10, 11, 12, 33] and got[1][0] == [1, 17, 18, 35, 36] and got[0] == got[8]
    assert scan(spark, texts[:1])[0] == got[0] and licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string, licenses int, sentence_ids int")).count() == 0


def test_sql_gives_the_same(spark):
    """The registered SQL on all notices, wrapped and not, and on awkward texts."""
    import duckdb

    from graphloom.llm import queries

    texts = ["\n".join(textwrap.fill(p, w) for p in paragraphs) for _, _, paragraphs in NOTICES for w in (30, 70, 500)]
    texts += [None, "", "This work is\nlicensed under CC BY 4.0.", "a;:. b ;! Released under the MIT License ;", "x\r\n\r\nReleased under the\r\nMIT License", "Released under the MIT License */ x --> Released under: the MIT License", "...\n\n\n...\n:"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = {i: (a, b) for i, a, b in con.execute("SELECT doc_id, sentence_ids, licenses FROM (" + queries.oracle_sql()["op6_license_scan"] + ")").fetchall()}
    got = {i: (",".join(map(str, a)), ",".join(b)) for i, (a, b) in enumerate(scan(spark, texts))}
    assert got == want


def test_parts_count_alone(spark):
    texts = ["License: Released under the MIT License; see below", "Some title\nReleased under the MIT License\nmore", "\x01released under the MIT license\x02", "It is not released under the MIT License.", "Released under the\n\nMIT License", "Released under. The MIT License", "." * 5000 + " licence " + ":" * 5000]
    assert [ids for ids, _ in scan(spark, texts)] == [[2], [2], [2], [], [], [], []]
    known = [*licenses.SENTENCES, *licenses.VARIANTS]
    number = {**licenses.VARIANTS, **{s: i for i, s in enumerate(licenses.SENTENCES, 1)}}
    assert all(number[a] == number[b] for a in known for b in known if f" {a} " in f" {b} ")
