"""The training-data operators against brute force, exact round trips, held-out accuracy and odd inputs."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.llm import components as CC
from demandloom.llm import langid, lattice_lm, licenses, mips, mixing, neardup, pieces, quality, toxicity, warc_fixity
from demandloom.llm.common import word_count

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, digest string, copies int"
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "one", "en", None), (5, "one", "en", "b"), (6, "*** ### $$$", "en", "b"),
    (7, "Ünïcödé ▁ text\x00 with 日本語 and 🎉", None, "b"), (8, "the cat sat on the mat " * 400, "en", "a"), (8, "the cat sat on the mat " * 400, "en", "a"), (9, "x" * 3000, "en", "a"), (None, "no id here at all", "en", "a"),
]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "s", "d", 7) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


# quality rules


def plain_quality(text):
    w = (text or "").encode().split()
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = [False] * len(w)
    for i in range(len(w) - 2):
        if windows[w[i], w[i + 1], w[i + 2]] > 1:
            hit[i] = hit[i + 1] = hit[i + 2] = True
    lines = [x for x in (text or "").encode().split(b"\n") if x.strip()]
    chars = sum(len(x.decode()) for x in w)
    return len(w), chars, sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(hit)


def test_quality_base_counts_and_odd_rows(odd, docs, empty):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.quality_report(docs).collect():
        want = plain_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    got = quality.quality_report(odd).collect()
    assert len(got) == len(ODD)
    assert all(r.base_failed and not r.kept for r in got)
    assert quality.quality_report(empty).count() == 0
    assert quality.keep_good(docs).columns == docs.columns
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert kept == {r.doc_id for r in quality.quality_report(docs).where("kept").collect()} < {r.doc_id for r in quality.keep_good(docs, least_words=1).collect()}


def test_quality_measures_and_verdict_by_brute_force(spark, docs):
    import base64 as b64

    import sentencepiece
    import tiktoken

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    ranks = {b64.b64decode(a): int(b) for a, b in map(bytes.split, open(quality.SECOND_MODEL, "rb"))}
    second = tiktoken.Encoding("own", pat_str=quality.SECOND_PATTERN, mergeable_ranks=ranks, special_tokens={})
    extra = ["שלום עולם " * 5 + " ".join(f"מילה{i} טובה" for i in range(40)), " ".join(f"слово{i} и дело" for i in range(40)), " ".join(chr(0x2600 + i) * 3 for i in range(90)), "zq" * 300 + " a" * 60]
    texts = {r.doc_id: r.text for r in docs.limit(120).collect()} | {10_000 + i: t for i, t in enumerate(extra)}
    asked = 0
    for r in quality.quality_report(docs_of(spark, [(i, t, "en", "a") for i, t in texts.items()])).collect():
        words = (texts[r.doc_id] or "").encode().split()
        if not words:
            assert not r.kept and r.chars_per_token is None
            continue
        shown = [w.decode() for w in words]
        ids = [i for w in shown for i in sp.encode(w)]
        share = np.array(list(Counter(ids).values())) / len(ids)
        chars = sum(map(len, shown))
        assert abs(r.chars_per_token - chars / len(ids)) < 1e-9
        assert abs(r.byte_share - sum(sp.is_byte(i) for i in ids) / len(ids)) < 1e-9
        assert abs(r.token_entropy + (share * np.log2(share)).sum() / np.log2(min(max(len(ids), 2), 256))) < 1e-9
        scripts = Counter()
        for w in shown:
            first = next((c for c in w if c.isalpha()), None)
            if first:
                scripts[__import__("unicodedata").name(first, "").split(" ")[0]] += len(w)
        assert r.script == (max(scripts, key=scripts.get) if scripts else "NONE")
        band = quality.BANDS[r.script]
        known = band.min_chars <= r.chars_per_token <= band.max_chars and r.byte_share <= band.max_bytes
        if not known and not r.base_failed:
            asked += 1
            other = second.encode_ordinary(" ".join(shown))
            broken = sum("\ufffd" in second.decode_single_token_bytes(i).decode("utf-8", "replace") for i in other)
            assert abs(r.chars_per_token_second - chars / len(other)) < 1e-9 and abs(r.byte_share_second - broken / len(other)) < 1e-9
            known = band.min_chars <= r.chars_per_token_second <= band.max_chars and r.byte_share_second <= band.max_bytes
        else:
            assert r.chars_per_token_second is None
        assert r.kept == (not r.base_failed and known and r.token_entropy >= band.min_entropy and r.n_symbols <= band.max_symbols * chars)
    assert asked
    rng = np.random.default_rng(0)
    for _ in range(50):
        ids = rng.integers(0, 6, rng.integers(1, 40))
        assert quality.repeated_words(ids) == quality.repeated_words(ids + 3_000_000) == plain_quality(" ".join(map(str, ids)))[4]


def test_quality_keeps_sound_texts_and_drops_noise(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    met = quality.quality_report(docs).join(labels, "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    share = {r.quality: r.k for r in met}
    assert share[1] > 0.98 and share.get(0, 0) < 0.6


# language identification


def test_language_model_is_a_distribution():
    words = ["abc", "abd", "bcd", "aab"]
    m = langid.fit_model("x", words, np.array([5, 2, 1, 3]), 3)
    letters = "abcd"
    total = sum(2 ** -m.entropy([a])[0] for a in letters) + sum(2 ** -m.entropy([a + b])[0] for a in letters for b in letters)
    assert 0 < total <= 1.0
    assert m.entropy(["abc"])[0] < m.entropy(["dca"])[0]


def plain_kneser_ney(words, counts, order):
    """log2 probability of a predicted mark or letter given what precedes it in its word, by dictionaries."""
    grams = [Counter() for _ in range(order + 1)]
    for w, c in zip(words, counts, strict=True):
        marked = ["<", *w, ">"]
        for at in range(1, len(marked)):
            for n in range(1, min(order, at + 1) + 1):
                grams[n][tuple(marked[at - n + 1 : at + 1])] += c
    times = {}
    for n in range(1, order + 1):
        kinds = Counter(g[1:] for g in grams[n + 1]) if n < order else {}
        times[n] = {g: (kinds[g] if n < order and kinds.get(g) else c) for g, c in grams[n].items()}
    tables, below = {}, None
    for n in range(1, order + 1):
        t = times[n]
        once, twice = sum(x == 1 for x in t.values()), sum(x == 2 for x in t.values())
        d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        total, kinds = Counter(), Counter()
        for g, x in t.items():
            total[g[:-1]] += x
            kinds[g[:-1]] += 1
        tables[n] = (t, total, kinds, d)

    def p(history, c, n):
        t, total, kinds, d = tables[n]
        h = tuple(history[len(history) - n + 1 :]) if n > 1 else ()
        if n == 1:
            spare = d * kinds[()] / total[()] / (kinds[()] + 256)
            return max(t.get((c,), 0) - d, 0) / total[()] + spare
        if not total[h]:
            return p(history, c, n - 1)
        return max(t.get((*h, c), 0) - d, 0) / total[h] + d * kinds[h] / total[h] * p(history, c, n - 1)

    def bits(word):
        marked = ["<", *word, ">"]
        return -sum(math.log2(p(marked[:at], marked[at], min(order, at + 1))) for at in range(1, len(marked)))

    return bits


def test_language_model_equals_plain_kneser_ney():
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("abcdé", k=rng.randint(1, 7))) for _ in range(60)})
    counts = [rng.randint(1, 6) for _ in words]
    for order in (2, 3, 5):
        m, bits = langid.fit_model("x", words, np.array(counts), order), plain_kneser_ney(words, counts, order)
        some = [*words[:20], "zzz", "abz", "a", "bcdéabcd", "dddd"]
        assert np.allclose(m.entropy(some), [bits(w) for w in some], rtol=1e-4)


def test_language_groups_agree(spark, docs):
    one = langid.train(docs)
    many = langid.train(docs, model_bytes=1)
    assert len(one.groups) == 1 and len(many.groups) == len(one.groups[0]) > 2
    a, b = ({(r.doc_id, r.lang_pred, round(r.score, 9), r.rejected) for r in langid.predict(docs, x).collect()} for x in (one, many))
    assert a == b
    assert langid.letter_runs(("é" * 2500 + " 12 ab²c").encode()) == ["é" * 1000, "é" * 1000, "é" * 500, "ab", "c"]


def test_language_held_out_accuracy_and_odd_rows(spark, docs, odd, empty):
    r = langid.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(r) == docs.count()
    out = [x for x in r if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in r)
    assert np.mean([x.lang == x.lang_pred for x in out]) > 0.97
    assert np.mean([x.rejected for x in r]) < 0.02
    assert all(0 <= x.score <= 1 for x in r)
    got = langid.language_report(odd).collect()
    assert len(got) == len(ODD)
    assert all(x.lang_pred == "und" and x.score == 0 for x in got if x.doc_id in (1, 2, 3, 6))
    assert langid.language_report(empty).count() == 0
    noise = docs_of(spark, [(1, " ".join("".join(random.Random(i).choices("qxzjvkwypfg", k=9)) for i in range(80)), None, "a")])
    identifier = langid.train(docs)
    assert langid.predict(noise, identifier).first().rejected
    assert langid.keep_known(noise, identifier).count() == 0


# licences


def test_every_labelled_language_has_a_model(spark, docs):
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(3, 8)))
    rows = [(10_000 + k, " ".join(word("abcdefghijklmnop"[k : k + 6]) for _ in range(60)), f"x{k}", "a") for k in range(10)]
    rows += [(20_000 + k, f"ωραίο κείμενο {k} γράμματα", "two", "a") for k in range(2)]
    rows += [(30_000, "".join(f"длинное слово{i} " for i in range(70_000)), "long", "a")]  # above the bytes of a sample text
    rows += [(40_000 + k, "одно и то же слово снова", "copies", "a") for k in range(3_000)]
    some = docs.select("doc_id", "text", "lang", "source").collect()
    df = docs_of(spark, [tuple(r) for r in some] + rows)
    trained = langid.train(df)
    want = {r.lang for r in some if r.lang} | {r[2] for r in rows}
    assert {r.lang for r in trained.table.select("lang").collect()} == want
    kept = {r.doc_id for r in langid.keep_known(df, trained).collect()}
    assert {r[0] for r in rows if r[2] in ("two", "long", "copies")} <= kept
    assert len({i for i, *_ in rows if i < 20_000} & kept) == 10


def test_stages_with_clashing_columns(spark, docs):
    odd_names = docs.withColumns({c: F.lit("MINE") for c in ("__lang", "__entropy", "__mix_rate", "__mix_copies", "c0", "__h")})
    trained = langid.train(docs)
    kept = langid.keep_known(odd_names, trained)
    assert kept.columns == odd_names.columns and kept.where("__lang != 'MINE' OR c0 != 'MINE'").count() == 0
    assert kept.count() == langid.keep_known(docs, trained).count()
    mixed = mixing.mix(odd_names)
    assert mixed.columns == odd_names.columns and mixed.where("__mix_rate != 'MINE' OR __mix_copies != 'MINE'").count() == 0
    assert mixed.count() == mixing.mix(docs).count()


def test_license_sentences_in_order(spark, odd, empty):
    mit = " ".join(s[0] + "." for k, s in licenses.SENTENCES.items() if k in ("mit-grant", "mit-condition", "mit-warranty"))
    rows = [
        (1, "Some words here.\nReleased under the MIT License.", "en", "a"), (2, f"MIT License\n\n{mit}", "en", "a"), (3, "Licensed under CC BY-NC 4.0", "en", "a"),
        (4, "this is licensed work, not a licence", "en", "a"), (5, "Licensed under the Apache License, Version 2.0.\nAll rights reserved.", "en", "a"), (6, mit.replace(" a copy ", "\na copy "), "en", "a"),
    ]
    got = {r.doc_id: (r.license, r.kind) for r in licenses.scan(docs_of(spark, rows)).collect()}
    assert got == {1: ("MIT", "notice"), 2: ("MIT", "text"), 3: ("CC-BY-NC-4.0", "notice"), 4: (None, None), 5: ("Apache-2.0", "notice"), 6: ("MIT", "text")}
    assert licenses.scan(odd).where("license IS NULL AND n_sentences = 0").count() == len(ODD)
    assert licenses.scan(empty).count() == 0


MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy
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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
"""
APACHE_BODY = """Copyright [yyyy] [name of copyright owner]

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MPL_BODY = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def test_wrapped_license_texts(spark):
    holder = "Copyright (c) 2024 Some Body\n"
    commented = lambda t, sign: "".join(f"{sign} {line}".rstrip() + "\n" for line in t.splitlines())
    texts = {
        "MIT": [f"MIT License\n\n{holder}\n{MIT_BODY}", f"{holder}\n{MIT_BODY}", f"{holder}{MIT_BODY}", f"{holder}\n{MIT_BODY}".replace("\n", "\r\n")], "ISC": [f"ISC License\n\n{holder}\n{ISC_BODY}", f"{holder}{ISC_BODY}"],
        "Apache-2.0": [APACHE_BODY, APACHE_BODY.replace("at\n\n", "at\n").replace("2.0\n\n", "2.0\n")], "MPL-2.0": [MPL_BODY, MPL_BODY.replace("v. 2.0", "v.\n2.0"), f"An unterminated title\n{MPL_BODY}"],
    }
    rows = [(t, name) for name, ts in texts.items() for t in ts for t in (t, commented(t, "#"), commented(t, " *"))]
    got = {r.doc_id: r for r in licenses.scan(docs_of(spark, [(i, t, "en", "a") for i, (t, _) in enumerate(rows)])).collect()}
    assert [(got[i].license, got[i].kind) for i in range(len(rows))] == [(name, "text") for _, name in rows]
    assert got[0].sentence_ids == "mit-title,mit-grant,mit-condition,mit-warranty" and got[0].n_sentences == 4
    short = [
        (0, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "en", "a"), (1, "This Source Code Form is subject to the terms of the Mozilla Public License, v. Other words. 2.0", "en", "a"),
        (2, "Licensed under the. MIT License", "en", "a"), (3, "not Licensed under the MIT License", "en", "a"), (4, "words\n\nLicensed under\n\nthe MIT License\n", "en", "a"),
    ]
    got = {r.doc_id: (r.license, r.kind, r.n_sentences) for r in licenses.scan(docs_of(spark, short)).collect()}
    assert got == {0: ("MPL-2.0", "notice", 1), 1: (None, None, 0), 2: ("MIT", "mention", 1), 3: (None, None, 0), 4: ("MIT", "notice", 1)}


def test_every_license_rule_and_several_licenses(spark):
    rows = [(i, "Some title\n\n" + "\n".join(licenses.SENTENCES[s][0] + "." for s in rule) + "\nOther words.", "en", "a") for i, (_, _, rule) in enumerate(licenses.RULES)]
    got = {r.doc_id: r for r in licenses.scan(docs_of(spark, rows)).collect()}
    for i, (name, kind, rule) in enumerate(licenses.RULES):
        assert f"{name}:{kind}" in got[i].licenses.split(","), (name, kind, got[i])
        assert got[i].sentence_ids == ",".join(rule)
        assert len(got[i].licenses.split(",")) == 1
    two = [
        (0, "Licensed under the Apache License, Version 2.0. Released under the MIT License.", "en", "a"),
        (1, "# SPDX-License-Identifier: GPL-3.0-only\nAll rights reserved.\nReleased under the MIT License.\nMIT License", "en", "a"),
        (2, "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", "en", "a"),
        (3, "/* SPDX-License-Identifier: BSD-2-Clause */", "en", "a"),
    ]
    got = {r.doc_id: (r.license, r.kind, r.licenses) for r in licenses.scan(docs_of(spark, two)).collect()}
    assert got == {
        0: ("Apache-2.0", "notice", "Apache-2.0:notice,MIT:notice"),
        1: ("MIT", "notice", "MIT:notice,GPL-3.0-only:tag,LicenseRef-reserved:mention"),
        2: ("LGPL-2.1-or-later", "text", "LGPL-2.1-or-later:text"),
        3: ("BSD-2-Clause", "tag", "BSD-2-Clause:tag"),
    }


def test_license_bodies_and_expressions(spark):
    apache = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.
"""
    gpl3 = """ Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.
"""
    gpl2 = """  The licenses for most software are designed to take away your
freedom to share and change it.  By contrast, the GNU General Public
License is intended to guarantee your freedom to share and change free
software--to make sure the software is free for all its users.  This
"""
    lgpl21 = gpl2.replace("Public\nLicense is intended", "Public\nLicenses are intended")
    lgpl3 = """  This version of the GNU Lesser General Public License incorporates
the terms and conditions of version 3 of the GNU General Public
License, supplemented by the additional permissions listed below.
"""
    mpl = """1.1. "Contributor"
    means each individual or legal entity that creates, contributes to
    the creation of, or owns Covered Software.
"""
    cc = """By exercising the Licensed Rights (defined below), You accept and agree
to be bound by the terms and conditions of this Creative Commons
Attribution-ShareAlike 4.0 International Public License ("Public
License"). To the extent"""
    texts = [
        apache, gpl3, gpl2, lgpl21, lgpl3, mpl, cc, "# SPDX-License-Identifier: (MIT OR Apache-2.0)\ncode", "// SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0",
        "x\n/* SPDX-License-Identifier: (MIT AND BSD-3-Clause) OR GPL-3.0-or-later AND ISC */\ny", "SPDX-License-Identifier: NONE OR mine", "a licence, or and with",
    ]
    got = [set(r.licenses.split(",")) for r in licenses.scan(docs_of(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).orderBy("doc_id").collect()]
    assert got == [
        {"Apache-2.0:text"}, {"GPL-3.0-only:text"}, {"GPL-2.0-only:text"}, {"LGPL-2.1-only:text"}, {"LGPL-3.0-only:text"}, {"MPL-2.0:text"}, {"CC-BY-SA-4.0:text"},
        {"Apache-2.0:tag", "MIT:tag"}, {"GPL-2.0-only:tag"}, {"MIT:tag", "BSD-3-Clause:tag", "GPL-3.0-or-later:tag", "ISC:tag"}, {""}, {""},
    ]
    assert all(any(a in s for a in licenses.ANCHORS) for s in licenses.known_sentences())


# exact top-k


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * rng.lognormal(0, 1.0, size=(300, 1))
    x[10:40] = x[10]  # a common vector
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(300, None, 0), (301, [1.0, None], 0), (302, [math.nan] * 8, 0), (303, [math.inf] * 8, 0), (304, [], 0), (305, [2.0, 1.0], 0), (None, [1.0] * 8, 0), (5, [float(v) for v in x[5]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    whole = {i: np.floor(64 * np.float32(v).astype(float)).astype(int) for i, v in enumerate(x)} | {305: np.array([128, 64] + [0] * 6)}
    got = defaultdict(list)
    for r in mips.search_report(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {q for q in whole if q % 20 == 0}
    for q, found in got.items():
        want = sorted([(i, int(whole[q] @ v)) for i, v in whole.items() if i != q] + [(5, int(whole[q] @ whole[5]))], key=lambda t: (-t[1], t[0]))[:20]
        assert found == want
    few = spark.createDataFrame(rows[:5], df.schema)
    assert mips.search_report(few).count() == 4
    assert mips.search_report(df.limit(0)).count() == 0


def test_top_k_of_large_values_and_one_wanted_level(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.integers(-4, 5, 3) * 10.0 ** rng.integers(0, 7)]) for i in range(200)]
    rows += [(1000, [4.0e6, 1.0]), (1020, [5.0e6, 1.0]), (1040, [3.0e38, -3.0e38, 1.0]), (1041, [3.0e38, 3.0e38, 5.0]), (1060, [0.0, 0.0, 0.0]), (1080, [1e18, 3.0, 1.0]), (1081, [1.0, 2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows}
    inner = lambda a, b: min(2**63 - 1, max(-(2**63), sum(x * y for x, y in zip(a, b, strict=False))))
    got = defaultdict(list)
    for r in mips.search_report(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in (i for i in whole if i % 20 == 0):
        want = sorted(((i, inner(whole[q], v)) for i, v in whole.items() if i != q), key=lambda t: (-t[1], t[0]))[:20]
        assert got[q] == want
    # vectors of one length fill one level, which every query needs: it is cut into buckets, shelves and stacks
    turn = rng.normal(size=(3000, 8))
    turn *= 40 / np.linalg.norm(turn, axis=1)[:, None]
    same = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(turn)], "vec_id long, embedding array<double>")
    m = np.floor(64 * turn).astype(np.int64)
    small = {"BUCKET": 256, "QUERY_BLOCK": 16, "STACK_BYTES": 2 * 16 * 8 * 8, "SHELF": 3}
    kept = {n: getattr(mips, n) for n in small}
    try:
        for n, x in small.items():
            setattr(mips, n, x)
        found = mips.search_report(same).toPandas()
    finally:
        for n, x in kept.items():
            setattr(mips, n, x)
    for q, rows_ in found.groupby("query_id"):
        want = sorted(((-int(s), i) for i, s in enumerate(m @ m[q]) if i != q))[:20]
        assert [(-r.score, r.vec_id) for r in rows_.sort_values("rank").itertuples()] == want
    assert found["query_id"].nunique() == 150


def test_rows_that_repeat_an_id_are_candidates(spark):
    rows = [(20, [1.0, 0.0]), (1, [5.0, 0.0]), (1, [-9.0, 0.0]), (20, [2.0, 0.0]), (7, [1e308, 0.0])]
    got = mips.search_report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    most = 2**63 - 1
    first = [(20, 1, 7, most), (20, 2, 1, 64 * 64 * 5), (20, 3, 20, 64 * 64 * 2), (20, 4, 1, -64 * 64 * 9)]
    second = [(20, 1, 7, most), (20, 2, 1, 64 * 64 * 10), (20, 3, 20, 64 * 64 * 2), (20, 4, 1, -64 * 64 * 18)]
    assert sorted(tuple(r) for r in got) == sorted(first + second)


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for size in (10, 1e6, 1e9, 1e15, 1e30):
        q, p = np.trunc(rng.normal(size=(6, 5)) * size), np.trunc(rng.normal(size=(7, 5)) * size)
        want = [[min(2**63 - 1, max(-(2**63), sum(int(x) * int(y) for x, y in zip(a, b, strict=True)))) for b in p] for a in q]
        assert mips._products(q, p).tolist() == want


def test_coordinate_route_loses_nothing():
    rng = np.random.default_rng(1)
    p = rng.integers(-5, 6, size=(500, 6)) * 100
    q = p[:40] + rng.integers(-9, 10, size=(40, 6))
    p, q = p.astype(float), q.astype(float)
    scores = q @ p.T
    thresholds = np.sort(scores, 1)[:, -3].astype(float)
    got = {i: set(ids.tolist()) for i, ids, _ in mips.bucket_best(np.full(40, -1), q, thresholds, np.arange(500), np.arange(500), p, 500)}
    for i in range(40):
        assert got[i] == set(np.flatnonzero(scores[i] >= thresholds[i]).tolist())


# language-model scores


def brute_marginal(vocabulary, logs, word):
    word, memo = pieces.MARK + word, {}

    def total(at):
        if at == len(word):
            return 1.0
        if at not in memo:
            memo[at] = sum(math.exp(logs[i]) * total(at + n) for n in range(1, 20) if at + n <= len(word) and (i := vocabulary.ids.get(word[at : at + n])) is not None)
        return memo[at]

    return math.log(total(0))


def test_lattice_marginals_and_expected_counts():
    proto = pieces.read_model()
    lattice, vocabulary = lattice_lm.Lattice.from_model(proto), pieces.Vocabulary.from_model(proto)
    words = ["the", "hello", "unbelievable", "é", "a", "motion"]
    assert np.allclose(lattice.marginals(words)[0], [brute_marginal(vocabulary, lattice.logs, w) for w in words])
    assert np.isfinite(lattice.marginals(["日本🎉", "x" * 200, "\x00", "a\udcffb"])[0]).all()
    uses = lattice.expected(["hello"], np.array([3.0]))
    size = [len(p) for p in vocabulary.pieces]
    assert abs(sum(u * size[i] for i, u in enumerate(uses[:-1])) - 3 * 6) < 1e-6
    fitted = lattice.fitted(uses, 2)
    assert abs(np.exp(fitted.logs[np.isfinite(fitted.logs)]).sum() - 1) < 1e-9
    assert fitted.marginals(["hello"])[0] > lattice.marginals(["hello"])[0]
    assert np.array_equal(lattice.marginals(words, fitted)[1], fitted.marginals(words)[0])


def test_lm_base_scores_by_brute_force(spark, odd, empty):
    rows = [(i, t, "en", "a") for i, t in enumerate(["The cat sat", "the the dog", "Zebra cat", "", None, "new words here cat", "cat", "dog dog", "x y z"])] + [(6, "cat", "en", "a")]
    df = docs_of(spark, rows)
    counts = Counter()
    for i, t, *_ in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update((t or "").lower().split() + ["</end>"])
    n, v = sum(counts.values()), len(counts)
    for report in (lattice_lm.score_report(df), lattice_lm.score_texts(df.withColumn("learn", ~lattice_lm.held_out(F.col("doc_id"), 7, 2)), head_words=2, rounds=1)):
        got = report.collect()
        assert len(got) == len(rows)
        text = dict((i, t) for i, t, *_ in rows)
        for r in got:
            w = (text[r.doc_id] or "").lower().split() + ["</end>"]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
            assert abs(r.base_score - sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) < 1e-9
            assert r.score < 0
    assert lattice_lm.score_report(odd).count() == len(ODD)
    assert lattice_lm.score_report(empty).count() == 0


def segmentations(vocabulary, logs, marked):
    """Every way to cut a marked word into pieces, or bytes for one character outside the vocabulary."""
    if not marked:
        yield []
        return
    for n in range(1, 20):
        i = vocabulary.ids.get(marked[:n]) if n <= len(marked) else None
        if i is not None:
            for rest in segmentations(vocabulary, logs, marked[n:]):
                yield [i, *rest]
    if marked[:1] not in vocabulary.ids:
        own = [vocabulary.byte_ids[b] for b in marked[0].encode("utf-8", "surrogateescape")]
        for rest in segmentations(vocabulary, logs, marked[1:]):
            yield [*own, *rest]


def plain_scores(texts, learn, rounds):
    """log10 of the marginal of each text (fitted, and by the vocabulary's own scores) from all segmentations."""
    proto = pieces.read_model()
    vocabulary, logs = pieces.Vocabulary.from_model(proto), lattice_lm.Lattice.from_model(proto).logs
    words = [[w.decode("utf-8", "surrogateescape") for w in t.lower().split()] for t in texts]
    ways = {w: list(segmentations(vocabulary, logs, pieces.MARK + w)) for ws in words for w in ws}
    own = logs
    for _ in range(rounds):
        uses = np.zeros(len(logs))
        for ws, teaches in zip(words, learn, strict=True):
            for w in ws if teaches else ():
                p = np.array([math.exp(sum(logs[i] for i in way)) for way in ways[w]])
                for share, way in zip(p / p.sum(), ways[w], strict=True):
                    for i in way:
                        uses[i] += share
        prior = np.where(np.isfinite(logs), np.exp(logs), 0.0)
        prior[-1] = 0.0
        total = uses + prior * lattice_lm.PRIOR_PIECES / prior.sum()
        total[-1] = sum(learn) + 1.0
        logs = np.log(np.maximum(total, 1e-300) / total.sum())
    end = logs[-1]
    score = lambda ws, l: (end + sum(math.log(sum(math.exp(sum(l[i] for i in way)) for way in ways[w])) for w in ws)) / math.log(10)
    return [(score(ws, logs), score(ws, own)) for ws in words]


def test_lm_scores_of_whole_texts_by_brute_force(spark):
    texts = [b"the cat sat", b"The hat\ton a mat", b"", b"caf\xc3\xa9 \xe6\x97\xa5", b"ab\xffcd \xed\xa0\x80", b"zebra the the"]
    learn = [True, True, True, False, True, False]
    raw = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(texts, learn, strict=True))], "doc_id long, t binary, learn boolean")
    df = raw.select("doc_id", F.expr("CAST(t AS STRING)").alias("text"), "learn")
    for rounds, head in ((2, 100_000), (1, 3)):
        want = plain_scores(texts, learn, rounds)
        got = {r.doc_id: r for r in lattice_lm.score_texts(df, rounds=rounds, head_words=head).collect()}
        for i, (score, own) in enumerate(want):
            assert abs(got[i].score - score) < 1e-6 and abs(got[i].own_score - own) < 1e-6


def test_lm_scores_of_many_equal_and_null_texts(spark):
    rows = [(i, "the same odd wordings zqxj", "en", "a") for i in range(2_000)] + [(5_000 + i, None, "en", "a") for i in range(2_000)] + [(7, "the same odd wordings zqxj", "en", "a")]
    got = lattice_lm.score_texts(docs_of(spark, rows).withColumn("learn", F.lit(True)), head_words=2).collect()
    assert len(got) == len(rows)
    by_kind = {(r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in got}
    assert len(by_kind) == 2 and {t[0] for t in by_kind} == {1, 6}


def test_lm_very_long_words():
    lattice = lattice_lm.Lattice.from_model(pieces.read_model())
    for word in ("ab" * 30, "x\udcff" * 25, "日本" * 22):
        whole = lattice._short([pieces.MARK + word])
        arcs, first, last, states = whole
        assert abs(lattice.marginals([word])[0][0] - lattice._forward(arcs, lattice._weights(arcs.ids), first, states)[last][0]) < 1e-6
        uses = lattice.expected([word], np.array([2.0]))
        assert abs((lattice.expected([word[:19], word], np.array([1.0, 2.0])) - lattice.expected([word[:19]], np.array([1.0])) - uses).max()) < 1e-6
    assert np.isfinite(lattice.marginals(["ab" * 500_000])[0]).all()


# SentencePiece


def test_encoding_equals_the_library_and_decodes(docs, odd, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=pieces.read_model())
    got = pieces.encode(docs, check=True).collect()
    assert all(r.round_trip and r.token_ids == sp.encode(r.text) for r in got)
    rows = pieces.encode(odd, check=True).select("text", "token_ids", "round_trip").collect()
    assert len(rows) == len(ODD) and all(r.round_trip for r in rows)
    assert all((r.token_ids is None) == (r.text is None) for r in rows)
    back = pieces.decode(pieces.encode(odd)).where("text IS NOT NULL AND NOT (text <=> decoded)")
    assert back.count() == 0
    assert pieces.encode_report(odd).count() == len(ODD) and pieces.encode(empty).count() == 0


def test_encoding_keeps_other_columns_and_odd_texts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=pieces.read_model())
    texts = ["a" * 70_000 + " b", "the cat " * 60_000, "x\ny  z \u2581", " lead", "tail  ", "é" * 500]
    df = spark.createDataFrame([(i, t, "mine", 5) for i, t in enumerate(texts)], "doc_id long, text string, round_trip string, token_ids int")
    got = pieces.encode(df)
    assert got.columns == ["doc_id", "text", "round_trip", "token_ids"] and {r.round_trip for r in got.collect()} == {"mine"}
    for r in pieces.encode(df, check=True).collect():
        assert r.round_trip is True
        assert pieces.MARK in r.text or r.token_ids == sp.encode(r.text)
    raw = spark.createDataFrame([(1, b"ab\xff cd \xed\xa0\x80")], "doc_id long, t binary").select("doc_id", F.expr("CAST(t AS STRING)").alias("text"))
    assert pieces.encode(raw, check=True).where("round_trip").count() == 1


def test_unigram_viterbi_is_the_best_of_all():
    names = ["<unk>", "▁", "a", "b", "c", "▁a", "ab", "bc", "abc", "▁ab"]
    scores = [0.0, -3.1, -2.0, -2.5, -2.2, -2.1, -2.9, -3.3, -5.2, -3.9]
    v = pieces.Vocabulary(names, scores, "unigram", {}, [0])

    def best(word, at=0):
        if at == len(word):
            return 0.0
        return max((scores[i] + best(word, at + n) for n in range(1, 5) if at + n <= len(word) and (i := v.ids.get(word[at : at + n])) is not None), default=-math.inf)

    words = ["▁" + "".join(w) for n in range(1, 6) for w in __import__("itertools").product("abc", repeat=n)]
    for word, ids in pieces.encode_words(v, words):
        assert "".join(names[i] for i in ids) == word
        assert abs(sum(scores[i] for i in ids) - best(word)) < 1e-9


# toxicity


def test_folding_and_exceptions():
    assert toxicity.fold("1d10t") == ["idiot"] and toxicity.fold("іdiоt###") == ["idiot"] and toxicity.fold("$cum") == ["scum"] and toxicity.fold("***") == []
    lexicon = toxicity.Lexicon([" trash "], [12.0], exceptions=("trash can",))
    folder = toxicity.Folder()
    assert lexicon.evidence(folder("a trash can here".encode()))[1] == 0
    assert lexicon.evidence(folder("such tr4sh and a trash can".encode()))[1] == 1


def plain_evidence(lexicon, folded):
    """Matches at every position, without an automaton."""
    spans = lambda p: [(k, k + len(p)) for k in range(len(folded)) if folded.startswith(p, k)]
    excused = [s for e in lexicon.exceptions for s in spans(" " + " ".join(x for w in e.split() for x in toxicity.fold(w)) + " ")]
    total, n = 0.0, 0
    for p, weight in zip(lexicon.patterns, lexicon.weights, strict=True):
        k = sum(not any(a <= s and e <= b for a, b in excused) for s, e in spans(p))
        expected = max(1, folded.count(" ") - 1) * math.exp(-weight)
        n += k
        if k > expected:
            total += k * math.log(k / expected) - (k - expected)
    return total, n


def test_toxicity_evidence_by_brute_force():
    rng = random.Random(6)
    lexicon = toxicity.Lexicon([" trash ", " idio", " lose", " tr4p "], [6.0, 7.0, 3.0, 2.0], exceptions=("trash can", "sore loser", "the trash can lid"))
    folder = toxicity.Folder()
    words = ["trash", "can", "lid", "the", "1diot", "idiotic", "sore", "loser", "losing", "tr4p", "ok", "tr\u0430sh", "tra\u200bsh", "tr\u00e1sh", "***"]
    for _ in range(200):
        folded = folder(" ".join(rng.choices(words, k=rng.randint(0, 25))).encode())
        got, want = lexicon.evidence(folded), plain_evidence(lexicon, folded)
        assert abs(got[0] - want[0]) < 1e-9 and got[1] == want[1]
    assert toxicity.phrases(lexicon, " the idiotic lid ") == {"the idiotic", "idiotic lid"}
    assert folder("tra\u200bsh tr\u00e1sh tr\u0430sh".encode()) == " trash trash trash "


def test_toxicity_learns_exceptions(spark):
    rng = random.Random(7)
    filler = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        w = rng.choices(filler, k=40)
        if i % 3 == 0:
            w[5:5] = ["grub", "grub"]
        elif i % 9 == 1:
            w[5:5] = ["beetle", "grub"]
        rows.append((i, " ".join(w), i % 3 == 0))
    docs = docs_of(spark, [(i, t, "en", "a") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, int(x)) for i, _, x in rows], "doc_id long, toxic int")
    lexicon = toxicity.train(docs, labels, exceptions=())
    assert "beetle grub" in lexicon.exceptions and "grub grub" not in lexicon.exceptions
    got = {r.doc_id: r.predicted for r in toxicity.score_texts(docs_of(spark, [(1, "w1 w2 beetle grub w3", "en", "a"), (2, "w1 w2 grub grub w3 w4", "en", "a")]), lexicon).collect()}
    assert got[1] == 0 and got[2] == 1


def test_toxicity_held_out(spark, odd, empty):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    r = toxicity.toxicity_report(d, l).join(l, "doc_id").where("held_out").collect()
    assert np.mean([x.predicted for x in r if x.toxic == 1]) > 0.6
    assert np.mean([x.predicted for x in r if x.toxic == 0]) < 0.02
    got = toxicity.toxicity_report(odd, l.limit(0)).collect()
    assert len(got) == len(ODD) and all(x.score < 0.01 and x.predicted == 0 for x in got)
    assert toxicity.toxicity_report(empty, l).count() == 0


# mixing


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] >= 3 * sizes[s]]
        if not over:
            return fixed | {s: level * w[s] for s in free}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mixing_targets_and_copies(spark, odd, empty):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 30), "en", rng.choice(["s1", "s2", "é", "Z", None] + ["big"] * 10)) for i in range(600)] + [(600, "w " * 4000, "en", "tiny")]
    df = docs_of(spark, rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    want = plain_targets(sizes)
    got = mixing.mix_report(df).collect()
    source = {i: s for i, _, _, s in rows}
    taken = Counter()
    for r in got:
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 and r.source_size == sizes[source[r.doc_id]] and r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert abs(taken["big"] - want["big"]) < 0.1 * want["big"]
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_report(df.repartition(7)).collect()))
    assert mixing.mix(df).count() == sum(r.copies for r in got)
    assert mixing.mix(df).columns == df.columns
    assert mixing.mix_report(odd).count() == len(ODD) and mixing.mix_report(empty).count() == 0
    assert [r.n for r in odd.select(word_count(F.col("text")).alias("n")).collect()] == [len((t or "").encode().split()) for _, t, *_ in ODD]


# fixity


def test_fixity_finds_exactly_the_damage(spark):
    rows = [(i, f"http://h/{i}", "<p>" + "x" * (i * 37 % 900)) for i in range(900)] + [(None, "u", "h"), (5, None, None)]
    made = warc_fixity.warc_records(spark.createDataFrame(rows, "page_id long, url string, html string"), 700)
    rec = warc_fixity.placed(made.withColumn("length", F.octet_length("record").cast("long")).withColumn("hash", warc_fixity.sha(F.col("record")))).drop("hash").cache()
    bad = rec.where("record_id NOT IN (17, 640)").withColumn("record", F.when(F.col("record_id").isin(3, 899), F.lit("broken")).otherwise(F.col("record")))
    extra = spark.createDataFrame([(9, 5000, "more", 4, 0)], "file long, record_id long, record string, length long, offset long")
    got = {(r.record_id, r.status) for r in warc_fixity.audit(rec, bad.unionByName(extra), range_bytes=1024, fanout=4).collect()}
    assert got == {(3, "changed"), (899, "changed"), (17, "missing"), (640, "missing"), (5000, "extra")}
    assert warc_fixity.audit(rec, rec).count() == 0
    assert warc_fixity.audit(rec.limit(0), rec.limit(0)).count() == 0
    by_file = defaultdict(int)
    for r in rec.orderBy("file", "offset").collect():
        assert r.offset == by_file[r.file]
        by_file[r.file] += r.length


def test_fixity_of_odd_rows(spark):
    schema = "file long, offset long, length long, record_id long, record string, node string, status int"
    of = lambda rows: spark.createDataFrame([(*r, "n", 1) for r in rows], schema)
    one = [(None, 0, 3, 1, "aaa"), (-1, 0, 3, 2, "bbb"), (1, None, 3, 3, "ccc"), (1, 0, 3, 4, "ddd"), (1, 0, 3, 5, "eee"), (1, 0, 3, 5, "eee"), (1, 70_000, 0, 6, None), (1, 70_000, 3, None, "fff")]
    two = [(None, 0, 3, 1, "aaX"), (-1, 0, 3, 2, "bbb"), (1, None, 3, 3, "other"), (1, 0, 3, 4, "ddd"), (1, 0, 3, 5, "eeX"), (1, 0, 3, 7, "new"), (1, 70_000, 0, 6, "")]
    got = sorted((r.file is None, r.offset, r.record_id, r.status) for r in warc_fixity.audit(of(one), of(two)).collect())
    assert got == [(False, 0, 5, "changed"), (False, 0, 7, "extra"), (False, 70_000, None, "missing"), (True, 0, 1, "changed")]
    assert warc_fixity.audit(of(one), of(one).repartition(3)).count() == 0
    assert warc_fixity.audit(of(one), of([])).count() == 6


# near-duplicates


def plain_components(rows, width, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(zip(*[w[k:] for k in range(width)], strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else [])

    sets = [(i, shingles(t)) for i, t in rows]
    above = {i: i for i, _ in sets}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(i), root(j)
                above[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in sets}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, width, percent):
    rng = random.Random(width)
    rows = []
    for g in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([2, 8, 60, 150]))]
        for _ in range(rng.choice([1, 3, 40])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"n{rng.randint(0, 99999)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, "Solo"), (1003, "solo")]
    df = docs_of(spark, [(i, t, "en", "a") for i, t in rows] + [(None, rows[0][1], "en", "a")])
    got = neardup.near_duplicates(df, width, percent).collect()
    want = plain_components(rows, width, percent)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got) and len(got) == len(rows) + 1


def test_large_clusters_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SET_BLOCK", 5)
    monkeypatch.setattr(neardup, "SET_SHINGLES", 300)
    monkeypatch.setattr(neardup, "POST_BLOCK", 6)
    monkeypatch.setattr("demandloom.llm.common.HOT_ROWS", 20)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    chain = [base]
    for _ in range(90):  # neighbours are near copies, ends are not
        chain.append([w if rng.random() > 0.02 else f"n{rng.randint(0, 10**6)}" for w in chain[-1]])
    family = [[w if rng.random() > 0.015 else f"m{rng.randint(0, 10**6)}" for w in base[::-1]] for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rng.sample(chain + family, len(chain) + len(family)))]
    got = neardup.near_duplicates(docs_of(spark, [(i, t, "en", "a") for i, t in rows]), 3, 85).collect()
    want = plain_components(rows, 3, 85)
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) > 3


def test_near_duplicates_of_very_long_texts(spark):
    rng = random.Random(4)
    words = [f"w{rng.randint(0, 50_000)}" for _ in range(400_000)]
    other = words[:390_000] + [f"x{i}" for i in range(10_000)]
    rows = [(1, " ".join(words), "en", "a"), (2, " ".join(other), "en", "a"), (3, "y" * 2_000_000, "en", "a"), (4, "y" * 2_000_000, "en", "a"), (5, " ".join(words[::-1]), "en", "a")]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_drop_near_duplicates_keeps_one_row(odd, empty):
    left = neardup.drop_near_duplicates(odd)
    assert left.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9]
    assert neardup.near_duplicates(empty).count() == 0 and neardup.drop_near_duplicates(empty).count() == 0


def test_agreement_bound_and_components(spark):
    for s in (0.8, 0.85):
        k = neardup.least_agreement(s)
        assert sum(math.comb(40, i) * s**i * (1 - s) ** (40 - i) for i in range(k)) < neardup.MISS
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (5, 5), (None, 3)]
    got = dict(map(tuple, CC.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}


# pipeline


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language_id", "quality_rules", "near_dedup", "mix_sources", "encode"]
    out = P.run(spark, SF)
    assert out.columns == [*docs.columns, "token_ids"]
    rows = out.collect()
    assert rows
    kept = {r.doc_id for r in quality.keep_good(docs, least_words=1).select("doc_id").collect()}
    assert {r.doc_id for r in rows} <= kept
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
