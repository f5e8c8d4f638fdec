"""Licence scans by sentence rules.

A text is lower-cased and read as words between two kinds of marks: sentence ends and line ends. A known licence
sentence is found where its words stand between any two marks, so wrapped lines, blank lines, comment signs and an
unterminated line before it (a title, a copyright line) do not hide it. A whole sentence over several lines counts
beside its lines. Known sentences are cut at sentence ends as texts are: one with an inner 'v. ' is a sequence of
pieces. The identifiers of a text in order are then matched against licence rules,
which are ordered: full texts come before notices, notices before mentions, and each rule is a sequence of identifiers
that must occur in this order. Every licence of a text is reported, by the first of its rules that matches; a rule
whose sentences are part of a longer one's (two clauses of three) gives way to that.

An SPDX expression counts as one tag per licence, wherever AND, OR or WITH join them.

Everything happens within the row, in DataFrame functions: no join, no shuffle. The known sentences are a fixed list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licences and of their usual notices, by identifier.
SENTENCES: dict[str, tuple[str, ...]] = {
    "apache-notice": ("Licensed under the Apache License, Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    "apache-comply": ("you may not use this file except in compliance with the License",),
    "apache-copy": ("You may obtain a copy of the License at",),
    "apache-asis": ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',),
    "apache-see": ("See the License for the specific language governing permissions and limitations under the License",),
    "mit-notice": ("Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "Distributed under the MIT License"),
    "mit-title": ("MIT License", "The MIT License (MIT)"),
    "mit-grant": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',),
    "mit-condition": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    "mit-warranty": ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',),
    "gpl3-notice": ("This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License v3.0"),
    "gpl-free": ("This program is free software",),
    "gpl3-terms": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "gpl2-notice": ("Licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License v2.0", "This work is licensed under the GNU General Public License, version 2"),
    "lgpl-free": ("This library is free software",),
    "lgpl21-terms": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version"),
    "lgpl3-terms": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version"),
    "lgpl3-notice": ("Licensed under the GNU Lesser General Public License, version 3", "Licensed under the GNU Lesser General Public License v3.0"),
    "agpl3-terms": ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "agpl3-notice": ("Licensed under the GNU Affero General Public License, version 3", "Licensed under the GNU Affero General Public License v3.0"),
    "gpl2-terms": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",),
    "lgpl-hope": ("This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",),
    "gpl-hope": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",),
    "ccbync4-notice": ("Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0"),
    "ccby4-notice": ("Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "ccbysa4-notice": ("Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "ccbynd4-notice": ("Licensed under CC BY-ND 4.0", "This work is licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "ccbyncsa4-notice": ("Licensed under CC BY-NC-SA 4.0", "This work is licensed under CC BY-NC-SA 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "ccbyncnd4-notice": ("Licensed under CC BY-NC-ND 4.0", "This work is licensed under CC BY-NC-ND 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "cc0-waived": ("To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work",),
    "bsd3-notice": ("Licensed under the BSD 3-Clause License", "Released under the BSD 3-Clause License", 'Licensed under the BSD 3-Clause "New" or "Revised" License'),
    "bsd2-notice": ("Licensed under the BSD 2-Clause License", "Released under the BSD 2-Clause License"),
    "bsd-style": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",),
    "epl2-notice": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "Licensed under the Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 2.0"),
    "ofl11-notice": ("This Font Software is licensed under the SIL Open Font License, Version 1.1",),
    "zlib-warranty": ("This software is provided 'as-is', without any express or implied warranty",),
    "zlib-grant": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",),
    "bsl1-notice": ("Distributed under the Boost Software License, Version 1.0",),
    "artistic2-notice": ("Licensed under the Artistic License 2.0", "Released under the Artistic License 2.0"),
    "cc0-notice": ("This work is dedicated to the public domain under CC0 1.0", "Licensed under CC0 1.0"),
    "bsd-redistribution": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",),
    "bsd-endorse": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "mpl2-notice": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "mpl2-copy": ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",),
    "isc-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "apache-terms": ("TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",),
    "apache-definition": ('"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document',),
    "gpl3-copyleft": ("The GNU General Public License is a free, copyleft license for software and other kinds of works",),
    "agpl3-copyleft": (
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with "
        "the community in the case of network server software",
    ),
    "gpl2-freedom": ("The licenses for most software are designed to take away your freedom to share and change it",),
    "gpl2-contrast": (
        "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for "
        "all its users",
    ),
    "lgpl21-contrast": (
        "By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software--to make sure the software is free "
        "for all its users",
    ),
    "lgpl3-incorporates": (
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by "
        "the additional permissions listed below",
    ),
    "mpl2-contributor": ('"Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software',),
    "unlicense": ("This is free and unencumbered software released into the public domain",),
    "reserved": ("All rights reserved",),
}

#: The Creative Commons licences of version 4.0, by identifier: the name, and the SPDX name.
CREATIVE_COMMONS = {
    "ccby4-terms": ("Attribution", "CC-BY-4.0"),
    "ccbysa4-terms": ("Attribution-ShareAlike", "CC-BY-SA-4.0"),
    "ccbync4-terms": ("Attribution-NonCommercial", "CC-BY-NC-4.0"),
    "ccbynd4-terms": ("Attribution-NoDerivatives", "CC-BY-ND-4.0"),
    "ccbyncsa4-terms": ("Attribution-NonCommercial-ShareAlike", "CC-BY-NC-SA-4.0"),
    "ccbyncnd4-terms": ("Attribution-NonCommercial-NoDerivatives", "CC-BY-NC-ND-4.0"),
}
_BOUND = 'By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {} 4.0 International Public License ("Public License")'
SENTENCES |= {name: (_BOUND.format(kind),) for name, (kind, _) in CREATIVE_COMMONS.items()}

#: Licence rules in their order.
RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("MIT", "text", ("mit-grant", "mit-condition", "mit-warranty")),
    ("BSD-3-Clause", "text", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", "text", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("Apache-2.0", "text", ("apache-notice", "apache-comply", "apache-copy", "apache-asis", "apache-see")),
    ("GPL-3.0-or-later", "text", ("gpl-free", "gpl3-terms", "gpl-hope")),
    ("GPL-2.0-or-later", "text", ("gpl-free", "gpl2-terms", "gpl-hope")),
    ("LGPL-2.1-or-later", "text", ("lgpl-free", "lgpl21-terms")),
    ("LGPL-3.0-or-later", "text", ("lgpl3-terms",)),
    ("AGPL-3.0-or-later", "text", ("gpl-free", "agpl3-terms", "gpl-hope")),
    ("MPL-2.0", "text", ("mpl2-notice", "mpl2-copy")),
    ("ISC", "text", ("isc-grant",)),
    ("Zlib", "text", ("zlib-warranty", "zlib-grant")),
    ("Unlicense", "text", ("unlicense",)),
    ("CC0-1.0", "text", ("cc0-waived",)),
    ("Apache-2.0", "text", ("apache-terms", "apache-definition")),
    ("GPL-3.0-only", "text", ("gpl3-copyleft",)),
    ("AGPL-3.0-only", "text", ("agpl3-copyleft",)),
    ("GPL-2.0-only", "text", ("gpl2-freedom", "gpl2-contrast")),
    ("LGPL-2.1-only", "text", ("gpl2-freedom", "lgpl21-contrast")),
    ("LGPL-3.0-only", "text", ("lgpl3-incorporates",)),
    ("MPL-2.0", "text", ("mpl2-contributor",)),
    *((spdx, "text", (name,)) for name, (_, spdx) in CREATIVE_COMMONS.items()),
    ("Apache-2.0", "notice", ("apache-notice",)),
    ("GPL-3.0-or-later", "notice", ("gpl3-terms",)),
    ("GPL-2.0-or-later", "notice", ("gpl2-terms",)),
    ("AGPL-3.0-or-later", "notice", ("agpl3-terms",)),
    ("GPL-3.0-only", "notice", ("gpl3-notice",)),
    ("GPL-2.0-only", "notice", ("gpl2-notice",)),
    ("LGPL-3.0-only", "notice", ("lgpl3-notice",)),
    ("AGPL-3.0-only", "notice", ("agpl3-notice",)),
    ("CC-BY-NC-SA-4.0", "notice", ("ccbyncsa4-notice",)),
    ("CC-BY-NC-ND-4.0", "notice", ("ccbyncnd4-notice",)),
    ("CC-BY-NC-4.0", "notice", ("ccbync4-notice",)),
    ("CC-BY-SA-4.0", "notice", ("ccbysa4-notice",)),
    ("CC-BY-ND-4.0", "notice", ("ccbynd4-notice",)),
    ("CC-BY-4.0", "notice", ("ccby4-notice",)),
    ("CC0-1.0", "notice", ("cc0-notice",)),
    ("MPL-2.0", "notice", ("mpl2-notice",)),
    ("EPL-2.0", "notice", ("epl2-notice",)),
    ("OFL-1.1", "notice", ("ofl11-notice",)),
    ("BSL-1.0", "notice", ("bsl1-notice",)),
    ("Artistic-2.0", "notice", ("artistic2-notice",)),
    ("BSD-3-Clause", "notice", ("bsd3-notice",)),
    ("BSD-2-Clause", "notice", ("bsd2-notice",)),
    ("MIT", "notice", ("mit-notice",)),
    ("LicenseRef-BSD-style", "mention", ("bsd-style",)),
    ("MIT", "mention", ("mit-title",)),
    ("LicenseRef-reserved", "mention", ("reserved",)),
)


def tags() -> dict[str, str]:
    """SPDX tag of each named licence, by the identifier of its sentence."""
    names = dict.fromkeys(name for name, _, _ in RULES if not name.startswith("LicenseRef"))
    return {f"spdx-{name.lower()}": f"SPDX-License-Identifier: {name}" for name in names}


SENTENCES |= {name: (sentence,) for name, sentence in tags().items()}
_TAGGED = tuple((sentence.split(": ")[1], "tag", (name,)) for name, sentence in tags().items())
RULES = (*(r for r in RULES if r[1] != "mention"), *_TAGGED, *(r for r in RULES if r[1] == "mention"))


def covers(i: int, j: int) -> bool:
    """Whether rule j says nothing beside rule i: a later rule of the same licence, or of a part of its sentences."""
    return i != j and ((RULES[i][0] == RULES[j][0] and i < j) or set(RULES[j][2]) < set(RULES[i][2]))


SENTENCE_END = r"[.!?;:]+(?:[ \t\n\x0b\f\r]+|\z)"
NOT_WORD = r"[^a-z0-9.]+"
EDGE = " ."
#: Marks in lower-cased text, where no capital occurs: a sentence end and a line end.
END, LINE = "E", "L"


#: Every known sentence has one of these in a word of its own: a text without them is not searched.
ANCHORS = ("licen", "software", "permission", "redistribut", "reserved", "warranty", "cc0", "mpl", "reproduction")
#: The tag of an SPDX expression, and what stands between its licences.
TAG = "spdx-license-identifier:"
OPERATOR = r"[ \t]+(?:or|and|with)[ \t]+"


def normalised(sentence: str) -> str:
    """Lower case, everything but letters, digits and inner dots to single spaces."""
    import re

    return re.sub("[^a-z0-9.]+", " ", sentence.lower()).strip(EDGE)


def known_sentences() -> dict[str, str]:
    """Normalised sentence -> identifier."""
    return {normalised(s): name for name, variants in SENTENCES.items() for s in variants}


def known_pieces() -> dict[tuple[str, ...], str]:
    """Normalised pieces of a sentence, cut at sentence ends as texts are -> identifier."""
    import re

    cut = re.compile(SENTENCE_END.replace(r"\z", r"\Z"))
    return {tuple(normalised(piece) for piece in cut.split(s)): name for name, variants in SENTENCES.items() for s in variants}


def _known_pattern() -> str:
    """A known sentence as a whole one, with the mark that ends it, or else between any two marks; its words may be on several lines."""
    piece = lambda p: f"[ {LINE}]++".join(w.replace(".", "[.]") for w in p.split(" "))
    known = "|".join(f"[ {LINE}]*{END}{END}[ {LINE}]*".join(piece(p) for p in pieces) for pieces in known_pieces())
    return f"{END}[ .{LINE}]*(?:{known})[ .{LINE}]*{END}|[{END}{LINE}][ .]*(?:{known})[ .]*(?=[{END}{LINE}])"


def _tagged_singly(lowered: Column) -> Column:
    """A lower-cased text in which each licence of an SPDX expression has a tag and a line of its own; exceptions are none."""

    def single(line: Column) -> Column:
        plain = F.regexp_replace(line, r"[()]", " ")
        return F.when(line.rlike(TAG + ".*" + OPERATOR), F.regexp_replace(plain, OPERATOR, f"\n{TAG} ")).otherwise(line)

    lines = F.array_join(F.transform(F.split(lowered, "\n"), single), "\n")
    return F.when(F.contains(lowered, F.lit(TAG)), lines).otherwise(lowered)


def sentence_ids(text: Column) -> Column:
    """Array of the identifiers of a text's known licence sentences, in order; null and empty texts have none."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    none = F.array().cast("array<string>")
    return F.when(lowered.rlike("|".join(ANCHORS)), _found_ids(_tagged_singly(lowered))).otherwise(none)


def _found_ids(lowered: Column) -> Column:
    ends = F.regexp_replace(lowered, SENTENCE_END, END + END)
    words = F.regexp_replace(F.translate(ends, "\n", LINE), f"[^a-z0-9.{END}{LINE}]+", " ")
    hits = F.regexp_extract_all(F.concat(F.lit(END), words, F.lit(END)), F.lit(_known_pattern()), F.lit(0))
    by_words = {" ".join(pieces): name for pieces, name in known_pieces().items()}
    names = F.create_map(*[F.lit(x) for item in by_words.items() for x in item])
    plain = lambda s: F.btrim(F.regexp_replace(s, f"[ {END}{LINE}]+", " "), F.lit(EDGE))
    several = lambda s: F.endswith(s, F.lit(END)) & (F.instr(s, LINE) > 0)
    found = F.flatten(F.transform(hits, lambda s: F.when(several(s), F.concat(F.array(s), F.split(s, LINE))).otherwise(F.array(s))))
    return F.filter(F.transform(found, lambda s: F.element_at(names, plain(s))), lambda n: n.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, license (null if none), kind, licenses, n_sentences, sentence_ids (joined by commas).

    licenses joins all licences of the text as license:kind, in the order of the rules; license and kind are the
    first. Rows are kept one for one. A text without a known sentence, a null or an empty one has license and kind
    null and no licenses.
    """
    ids = docs.select("doc_id", sentence_ids(F.col("text")).alias("ids"))
    joined = F.concat(F.lit(","), F.array_join("ids", ",,"), F.lit(","))
    # the rules that match, by number: tested where there are sentences only
    numbers = F.array(*[F.when(F.col("sequence").rlike(_pattern(rule)), F.lit(i)) for i, (_, _, rule) in enumerate(RULES)])
    matched = ids.withColumn("sequence", joined).withColumn("matched", F.when(F.size("ids") > 0, F.array_compact(numbers)))
    hidden = F.array(*[F.array(*[F.lit(i) for i in range(len(RULES)) if covers(i, j)]).cast("array<int>") for j in range(len(RULES))])
    left = F.filter("matched", lambda j: ~F.arrays_overlap(F.element_at(hidden, j + 1), F.col("matched")))
    names = F.array(*[F.lit(f"{name}:{kind}") for name, kind, _ in RULES])
    found = matched.withColumn("found", F.coalesce(F.transform(left, lambda j: F.element_at(names, j + 1)), F.array().cast("array<string>")))
    first = F.split(F.element_at("found", 1), ":")
    return found.select(
        "doc_id",
        F.when(F.size("found") > 0, F.element_at(first, 1)).alias("license"),
        F.when(F.size("found") > 0, F.element_at(first, 2)).alias("kind"),
        F.array_join("found", ",").alias("licenses"),
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
    )


def _pattern(rule: tuple[str, ...]) -> str:
    return ".*".join(f",{name}," for name in rule)


def oracle() -> str:
    """The scan as SQL over the same fixed lists."""
    known = ", ".join(f"('{s}', '{n}')" for s, n in known_sentences().items())
    rules = ", ".join(f"({i}, '{_pattern(rule)}', '{name}', '{kind}')" for i, (name, kind, rule) in enumerate(RULES))
    hidden = ", ".join(f"({i}, {j})" for i in range(len(RULES)) for j in range(len(RULES)) if covers(i, j))
    return rf"""
WITH known(sentence, id) AS (VALUES {known}), rules(i, pattern, license, kind) AS (VALUES {rules}), hidden(i, j) AS (VALUES {hidden}),
lowered AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents),
singly AS (SELECT doc_id, CASE WHEN contains(low, '{TAG}') THEN array_to_string(list_transform(string_split(low, chr(10)),
  lambda l: CASE WHEN regexp_matches(l, '{TAG}.*{OPERATOR}') THEN regexp_replace(regexp_replace(l, '[()]', ' ', 'g'), '{OPERATOR}', chr(10) || '{TAG} ', 'g') ELSE l END), chr(10)) ELSE low END AS tagged FROM lowered),
chunked AS (SELECT doc_id, unnest(list_transform(string_split_regex(tagged, '[.!?;:]+(?:[ \t\n\x0b\f\r]+|\z)'), lambda x, k: {{'c': x, 'i': k}})) AS c FROM singly),
lined AS (SELECT doc_id, c.i AS pos, unnest(list_transform(string_split(c.c, chr(10)), lambda x, k: {{'c': x, 'i': k}})) AS l FROM chunked WHERE strpos(c.c, chr(10)) > 0),
pieces AS (SELECT doc_id, c.i AS pos, 0 AS line, c.c AS piece FROM chunked UNION ALL SELECT doc_id, pos, l.i, l.c FROM lined),
hits AS (SELECT doc_id, pos, line, id FROM pieces JOIN known ON trim(regexp_replace(piece, '[^a-z0-9.]+', ' ', 'g'), ' .') = sentence),
ordered AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY pos, line) AS ids, ',' || string_agg(id, ',,' ORDER BY pos, line) || ',' AS sequence FROM hits GROUP BY doc_id),
matched AS (SELECT doc_id, i, license, kind FROM ordered JOIN rules ON regexp_matches(sequence, pattern)),
seen AS (SELECT * FROM matched m WHERE NOT EXISTS (SELECT 1 FROM hidden h JOIN matched o ON o.i = h.i WHERE h.j = m.i AND o.doc_id = m.doc_id)),
ruled AS (SELECT doc_id, arg_min(license, i) AS license, arg_min(kind, i) AS kind, string_agg(license || ':' || kind, ',' ORDER BY i) AS licenses FROM seen GROUP BY doc_id)
SELECT d.doc_id, r.license, r.kind, coalesce(r.licenses, '') AS licenses, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids
FROM documents d LEFT JOIN ordered o ON d.doc_id = o.doc_id LEFT JOIN ruled r ON d.doc_id = r.doc_id
"""
