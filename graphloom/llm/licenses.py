"""Licence recognition by known sentences and ordered rules, with plain DataFrame operations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of licence notices, normalised (ASCII lower case, other characters
#: than letters and digits as one space).  A sentence's identifier is its place, from 1.
SENTENCES = (
    "licensed under the apache license version 2 0",
    "released under the mit license",
    "this work is licensed under the gnu general public license version 3",
    "licensed under cc by nc 4 0",
    "licensed under cc by 4 0",
    "licensed under cc by sa 4 0",
    "spdx license identifier mit",
    "spdx license identifier apache 2 0",
    "spdx license identifier gpl 3 0 only",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "you may not use this file except in compliance with the license",
    "you may obtain a copy of the license at",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "this source code form is subject to the terms of the mozilla public license v 2 0",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "see the license for the specific language governing permissions and limitations under the license",
    "licensed under the mit license",
    "licensed under the bsd 2 clause license",
    "licensed under the bsd 3 clause license",
    "this work is licensed under the gnu general public license version 2",
    "this work is licensed under a creative commons attribution 4 0 international license",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "this is free and unencumbered software released into the public domain",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "this software is provided as is without any express or implied warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "distributed under the boost software license version 1 0",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "licensed under the european union public licence version 1 2",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "no express or implied licenses to any party s patent rights are granted by this license",
    "further conditions of a redistribution notice",
    "apache license version 2 0 january 2004",
    "gnu general public license version 3 29 june 2007",
    "gnu general public license version 2 june 1991",
    "gnu lesser general public license version 3 29 june 2007",
    "gnu affero general public license version 3 19 november 2007",
    "gnu lesser general public license version 2 1 february 1999",
    "mozilla public license version 2 0",
)
#: Licences that a tag names by its short identifier alone, beyond those above.
SHORT = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0",
    "EPL-2.0", "EUPL-1.2", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)
_NOTICES = len(SENTENCES)
SENTENCES += tuple("spdx license identifier " + re.sub("[^a-z0-9]+", " ", name.lower()) for name in SHORT)
#: Licence, and the sentence identifiers that must follow one another.
RULES = (
    ("Apache-2.0", (1,)),
    ("Apache-2.0", (1, 17, 18)),
    ("Apache-2.0", (8,)),
    ("BSD-2-Clause", (13, 14, 15)),
    ("BSD-3-Clause", (13, 14, 15, 16)),
    ("CC-BY-4.0", (5,)),
    ("CC-BY-NC-4.0", (4,)),
    ("CC-BY-SA-4.0", (6,)),
    ("GPL-3.0-only", (3,)),
    ("GPL-3.0-only", (9,)),
    ("GPL-3.0-or-later", (19, 20)),
    ("MIT", (2,)),
    ("MIT", (7,)),
    ("MIT", (10, 11, 12)),
    ("GPL-3.0-or-later", (19,)),
    ("GPL-2.0-or-later", (21,)),
    ("GPL-2.0-only", (22,)),
    ("GPL-3.0-only", (23,)),
    ("AGPL-3.0-or-later", (24,)),
    ("LGPL-2.1-or-later", (25,)),
    ("LGPL-3.0-or-later", (26,)),
    ("MPL-2.0", (28,)),
    ("ISC", (30,)),
    ("MIT", (37,)),
    ("BSD-2-Clause", (38,)),
    ("BSD-3-Clause", (39,)),
    ("GPL-2.0-only", (40,)),
    ("CC-BY-4.0", (41,)),
    ("CC-BY-SA-4.0", (42,)),
    ("CC-BY-NC-4.0", (43,)),
    ("CC-BY-ND-4.0", (44,)),
    ("CC-BY-NC-SA-4.0", (45,)),
    ("CC0-1.0", (46,)),
    ("Unlicense", (47,)),
    ("Zlib", (49, 50)),
    ("BSL-1.0", (51,)),
    ("WTFPL", (52,)),
    ("EPL-2.0", (53,)),
    ("EUPL-1.2", (54,)),
    ("BSD-4-Clause", (13, 14, 15, 55, 16)),
    ("BSD-3-Clause-Clear", (13, 14, 15, 16, 56)),
    ("LicenseRef-BSD-like", (13, 14, 15, 57)),
    ("Apache-2.0", (58,)),
    ("GPL-3.0-only", (59,)),
    ("GPL-2.0-only", (60,)),
    ("LGPL-3.0-only", (61,)),
    ("AGPL-3.0-only", (62,)),
    ("LGPL-2.1-only", (63,)),
    ("MPL-2.0", (64,)),
) + tuple((name, (i,)) for i, name in enumerate(SHORT, _NOTICES + 1))
#: Marks put where a sentence ends (HARD) and where it may end or go on (SOFT).
HARD, SOFT = "\x01", "\x02"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Other forms of a sentence in the usual notices, and the sentence's identifier.
VARIANTS = {
    "licensed under the apache license version 2 0 the license": 1,
    "this work is licensed under cc by nc 4 0": 4,
    "this work is licensed under cc by 4 0": 5,
    "this work is licensed under cc by sa 4 0": 6,
    "you may obtain a copy of the license at http www apache org licenses license 2 0": 18,
    "you may obtain a copy of the license at https www apache org licenses license 2 0": 18,
    "this source code form is subject to the terms of the mozilla public license v": 28,
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": 29,
    "this project is licensed under the mit license": 37,
    "this software is licensed under the mit license": 37,
    "mit licensed": 37,
}
#: Mark of a sentence whose slots are filled, until all are.
FILLED = "\x03"
#: A blank between words of a sentence, and some words with the blanks behind them.
_GAP, _WORDS = r"[ \x02]+", r"(?:[a-z0-9]+[ \x02]+)"


def _spaced(sentence: str) -> str:
    return sentence.replace(" ", _GAP)


_START = r"(\A|[\x01\x02]) *(?:[a-z0-9]{1,3} )?"
#: Sentences with slots: what is matched in a text whose words are set apart, and what it becomes, in this order.
#: Conditions may be lettered; a holder's name stands in the third condition of a redistribution notice and in its disclaimer; a notice may begin
#: with the kind of thing that is licensed; and words between the second condition and the disclaimer that are no known
#: sentence are conditions that we don't know.
SLOTS = (
    (rf"(\A|[\x01\x02]) *(?:[a-z]|[ivx]{{1,4}}|[0-9]{{1,2}}){_GAP}(redistributions{_GAP}(?:of|in){_GAP})", r"\1\2"),
    (
        rf"(\A|[\x01\x02]) *{_WORDS}{{0,6}}?(?:neither|nor|the[ \x02]+names?|names?){_GAP}{_WORDS}{{0,60}}?" + _spaced("endorse or promote products derived from this software without ") + rf"(?:specific{_GAP})?" + _spaced("prior written permission"),
        rf"\1{FILLED}" + SENTENCES[15],
    ),
    (_START + _spaced(SENTENCES[54]), rf"\1{FILLED}" + SENTENCES[54]),
    (
        _START + _spaced("this software is provided by ") + rf"{_WORDS}{{1,20}}?" + _spaced("as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
        rf"\1{FILLED}" + SENTENCES[33],
    ),
    (
        f"({_spaced(SENTENCES[14])} *[\x01\x02])[ \x01\x02]*(?:[a-z0-9]+[ \x01\x02]+){{3,400}}?({FILLED}{SENTENCES[33]})",
        rf"\1{SENTENCES[56]}{HARD}\2",
    ),
    (FILLED, ""),
    (
        rf"(\A|[\x01\x02]) *(?:this|the){_GAP}(?:project|software|file|package|library|code|program|module|repository){_GAP}(?:is|was){_GAP}(?:released|licensed|distributed|made{_GAP}available|available){_GAP}under{_GAP}(?:the{_GAP}terms{_GAP}of{_GAP})?the{_GAP}",
        r"\1licensed under the ",
    ),
)
#: Identifiers that an expression may hold besides those of rules, and what they stand for.
OLD_NAMES = {
    "AGPL-3.0": "AGPL-3.0-only", "AGPL-3.0+": "AGPL-3.0-or-later", "GPL-2.0": "GPL-2.0-only", "GPL-2.0+": "GPL-2.0-or-later", "GPL-3.0": "GPL-3.0-only", "GPL-3.0+": "GPL-3.0-or-later",
    "LGPL-2.1": "LGPL-2.1-only", "LGPL-2.1+": "LGPL-2.1-or-later", "LGPL-3.0": "LGPL-3.0-only", "LGPL-3.0+": "LGPL-3.0-or-later", "BSD-2-Clause-FreeBSD": "BSD-2-Clause",
}
#: Names in lower case -> the licence that an expression means by them.
EXPRESSED = {n.lower(): n for n, _ in RULES if not n.startswith("LicenseRef")} | {old.lower(): new for old, new in OLD_NAMES.items()}
#: A tag with its expression; what parts expressions; an address of a Creative Commons licence.
TAG = r"spdx-license-identifier:[ \t]*([^\r\n]*)"
PARTS = r"[ \t]+(?:or|and)[ \t]+|[()]"
COMMONS = r"creativecommons\.org/(licenses/by(?:-nc)?(?:-sa|-nd)?/4\.0|publicdomain/zero/1\.0)"


def _anchors(sentences) -> tuple[str, ...]:
    """A few long words of which every sentence holds one, taken greedily: a text without any of them holds no
    known sentence, whatever the table, and needs no closer look.  Long words are rarer in other texts."""
    left, out = set(sentences), []
    words = sorted({w for s in sentences for w in s.split() if len(w) > 6})
    while left:
        best = max(words, key=lambda w: (sum(w in s for s in left), len(w), w))
        out.append(best)
        left = {s for s in left if best not in s}
    return tuple(out)


#: Words of which every known sentence holds one; found from the table itself.
ANCHORS = _anchors((*SENTENCES, *VARIANTS))
#: What becomes which mark, in this order: the end of a comment; ; or : before white space or the end; the same with . ! or ?
#: among the signs; lines without letters and digits; other line breaks.
ENDS = (
    (r"\*/|-->", HARD),
    (r"(?<![.!?;:])[;:]++(?=[ \t\r\n]|\z)", SOFT),
    (r"(?<![.!?;:])[.!?;:]++(?=[ \t\r\n]|\z)", HARD),
    (r"(?>\r\n|\r|\n)[^a-z0-9\x01]*[\r\n]", HARD),
    (r"[\r\n]+", SOFT),
)


def _once(value: Column, use) -> Column:
    """use(value), with value worked out once a row however often it is used."""
    return F.transform(F.array(value), use)[0]


def lowered(text: Column) -> Column:
    """ASCII letters in lower case; marks of our own become blanks."""
    return F.translate(text, UPPER + HARD + SOFT, LOWER + "  ")


def has_anchor(text: Column) -> Column:
    out = F.lit(False)
    for word in ANCHORS:
        out = out | text.contains(word)
    return out


def sentence_ids(text: Column, sentences=SENTENCES, variants=VARIANTS) -> Column:
    """Identifiers of a text's known sentences in their order; empty for null.

    A sentence reads from one mark to another, over any soft marks between: wrapped lines and the
    ; and : within a sentence join, and a line or a part before ; or : counts alone as well.  Slots
    are filled first.  Of the sentences that begin at one mark the longest is taken."""
    ids = {**variants, **{s: i for i, s in enumerate(sentences, 1)}}
    known = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    longest = sorted(ids, key=len, reverse=True)
    pattern = r"(?:\A|[\x01\x02]) *(" + "|".join(map(_spaced, longest)) + r")(?= *(?:[\x01\x02]|\z))"

    def found(plain: Column) -> Column:
        marked = plain
        for ends, mark in ENDS:
            marked = F.regexp_replace(marked, ends, mark)
        marked = F.regexp_replace(marked, r"[^a-z0-9\x01\x02]+", " ")
        for slot, filled in SLOTS:
            marked = F.regexp_replace(marked, slot, re.sub(r"\\(\d)", r"$\1", filled))
        # parts between hard marks without an anchor hold no known sentence
        marked = F.array_join(F.filter(F.split(marked, HARD), has_anchor), HARD)
        hits = F.regexp_extract_all(marked, F.lit(pattern), F.lit(1))
        return F.transform(hits, lambda s: F.try_element_at(known, F.regexp_replace(s, r"[ \x02]+", " ")))

    # lower() knows more letters than ASCII's, so it loses no anchor; it is much faster than lowered()
    return _once(F.lower(text), lambda low: F.when(has_anchor(low), _once(lowered(text), found)).otherwise(F.array().cast("array<int>")))


def expressed_names(text: Column) -> Column:
    """Licences of a text's tags, whose expressions may hold several, and of its Creative Commons addresses; null for
    null.  `with` and what follows it in a part is left aside, as are names that no rule has."""
    names = F.create_map(*[F.lit(x) for pair in EXPRESSED.items() for x in pair])

    def found(plain: Column) -> Column:
        parts = F.flatten(F.transform(F.regexp_extract_all(plain, F.lit(TAG), F.lit(1)), lambda e: F.split(e, PARTS)))
        tags = F.transform(parts, lambda p: F.try_element_at(names, F.regexp_extract(p, r"\A[ \t]*([a-z0-9.+-]+)", 1)))
        places = F.regexp_extract_all(plain, F.lit(COMMONS), F.lit(1))
        word = lambda p: F.upper(F.regexp_extract(p, r"licenses/([a-z-]+)/", 1))
        commons = F.transform(places, lambda p: F.when(p.startswith("public"), "CC0-1.0").otherwise(F.concat(F.lit("CC-"), word(p), F.lit("-4.0"))))
        return F.array_compact(F.concat(tags, commons))

    some = lambda low: low.contains("spdx-license-identifier:") | low.contains("creativecommons.org/")
    return _once(F.lower(text), lambda low: F.when(some(low), _once(lowered(text), found)).otherwise(F.array().cast("array<string>")))


def license_names(ids: Column, rules=RULES) -> Column:
    """Licences whose rule's identifiers follow one another in ids, sorted, each once.  A rule
    that begins a longer rule of another licence gives way where the longer one is met."""
    line = F.concat(F.lit(","), F.array_join(ids, ","), F.lit(","))
    marks = [(name, "," + ",".join(map(str, seq)) + ",") for name, seq in rules]
    hits = []
    for name, mark in marks:
        longer = [m for other, m in marks if other != name and m != mark and m.startswith(mark)]
        rest = line
        for m in longer:
            rest = F.replace(rest, F.lit(m), F.lit(","))
        hits.append(F.when(rest.contains(mark), F.lit(name)))
    return F.array_sort(F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull())))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids, licenses for every row of docs(doc_id, text).

    One pass without a shuffle, so skew is of no matter.  Null or empty text: no sentences, no
    licences.  Very long texts are read whole.  Equal rows give equal rows; further columns are left
    aside, also if they are named as those above; an empty table gives an empty result.  A tag's
    expression counts with every licence in it, without its exceptions."""
    ids, names = sentence_ids(F.col("text")), expressed_names(F.col("text"))
    rows = docs.select("doc_id", ids.alias("sentence_ids"), names.alias("expressed"))
    rows = rows.withColumn("sentence_ids", F.coalesce("sentence_ids", F.array().cast("array<int>")))
    told = F.concat(license_names(F.col("sentence_ids")), F.coalesce("expressed", F.array().cast("array<string>")))
    return rows.select("doc_id", "sentence_ids", F.array_sort(F.array_distinct(told)).alias("licenses"))
