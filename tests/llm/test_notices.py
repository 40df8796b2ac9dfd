"""Published notices with their holders' names, in forms that the tables weren't made from."""

import textwrap

import pytest

from graphloom.llm import licenses

TWO = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{0} Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
{1} Redistributions in binary form must reproduce the above
   copyright notice, this list of conditions and the following disclaimer
   in the documentation and/or other materials provided with the
   distribution.
"""
AS_IS = """
THIS SOFTWARE IS PROVIDED BY {} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {} BE LIABLE FOR ANY DIRECT DAMAGES.
"""
THIRD = {
    "company": "Neither the name of Google Inc. nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission.",
    "university": "Neither the name of the University nor the names of its contributors\n   may be used to endorse or promote products derived from this software\n   without specific prior written permission.",
    "names": "Neither the names of the copyright holders nor the names of the contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "author": "The name of the author may not be used to endorse or promote products\n   derived from this software without specific prior written permission.",
    "short": "Names of contributors may not be used to endorse or promote products derived from this software without prior written permission.",
    "project": "Neither the name of the Foo Bar, Baz & Co. KG project nor the names of its\n contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
}
SIMPLE = {
    "MIT Licensed": ["MIT"],
    "This project is released under the MIT license.": ["MIT"],
    "The library is distributed under the terms of the MIT License.": ["MIT"],
    "This file is licensed under the Apache License, Version 2.0.": ["Apache-2.0"],
    "// SPDX-License-Identifier: MIT OR Apache-2.0\nfn main() {}": ["Apache-2.0", "MIT"],
    "/* SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note */": ["GPL-2.0-only"],
    "# SPDX-License-Identifier: GPL-2.0+\nobj-y": ["GPL-2.0-or-later"],
    "SPDX-License-Identifier: (MIT AND bsd-3-clause) or LicenseRef-Own": ["BSD-3-Clause", "MIT"],
    "<!-- SPDX-License-Identifier: CC-BY-ND-4.0 -->": ["CC-BY-ND-4.0"],
    "See https://creativecommons.org/licenses/by-nc-sa/4.0/ for terms": ["CC-BY-NC-SA-4.0"],
    "http://creativecommons.org/publicdomain/zero/1.0/": ["CC0-1.0"],
    "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n": ["Apache-2.0"],
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright": ["GPL-3.0-only"],
    "We like the MIT license.": [],
    "A university must reproduce this list of names without permission.": [],
    "See creativecommons.org/licenses/by/3.0/": [],
    "SPDX-License-Identifier: NONE": [],
}


def names(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["licenses"] for r in licenses.scan_licenses(docs).orderBy("doc_id").collect()]


@pytest.mark.parametrize("comment", ["", " * ", "# ", "// "])
def test_redistribution_notices(spark, comment):
    texts, want = [], []

    def add(body, name):
        texts.append("\n".join(comment + line for line in body.split("\n")))
        want.append([name])

    for marks in (("1.", "2.", "3."), ("*", "*", "*"), ("(a)", "(b)", "(c)"), ("-", "-", "-")):
        two = "Copyright (c) 1998, A. Person\nAll rights reserved.\n\n" + TWO.format(*marks)
        for holder in ("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE REGENTS AND CONTRIBUTORS", "JANE ROE"):
            tail = AS_IS.format(holder, holder)
            add(two + tail, "BSD-2-Clause")
            for third in THIRD.values():
                add(two + f"{marks[2]} {third}\n" + tail, "BSD-3-Clause")
            add(two + f"{marks[2]} Users of this software owe the author a postcard from their town.\n" + tail, "LicenseRef-BSD-like")
            advert = "All advertising materials mentioning features or use of this software\n   must display the following acknowledgement:\n   This product includes software developed by the University."
            add(two + f"{marks[2]} {advert}\n{marks[2]} {THIRD['university']}\n" + tail, "BSD-4-Clause")
    assert names(spark, texts) == want


def test_two_notices_in_one_file(spark):
    two, tail = TWO.format("1.", "2."), AS_IS.format("THE AUTHOR", "THE AUTHOR")
    other = "\n\nint x;\n\n" + two + "3. " + THIRD["company"] + "\n" + tail
    assert names(spark, [two + tail + other, two + tail + "\nmore words follow here\n" + two + tail]) == [["BSD-2-Clause", "BSD-3-Clause"], ["BSD-2-Clause"]]


def test_simple_forms(spark):
    assert names(spark, list(SIMPLE)) == list(SIMPLE.values())
    assert names(spark, [textwrap.fill(t, 30) for t in list(SIMPLE)[1:4]]) == list(SIMPLE.values())[1:4]


def test_sql_says_the_same(spark):
    import duckdb

    from graphloom.llm import queries

    texts = [TWO.format("1.", "2.") + "3. " + t + "\n" + AS_IS.format("US", "US") for t in [*THIRD.values(), "Send a postcard to the author of it."]] + list(SIMPLE) + [None, "", "\x03 a \x01 MIT Licensed \x02"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = {i: b for i, _, b in con.execute("SELECT doc_id, sentence_ids, licenses FROM (" + queries.oracle_sql()["op6_license_scan"] + ")").fetchall()}
    assert {i: ",".join(n) for i, n in enumerate(names(spark, texts))} == want
    repeated = names(spark, [texts[0], texts[0]])
    assert repeated[0] == repeated[1] == ["BSD-3-Clause"]
