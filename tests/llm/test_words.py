"""Spelling variants, the exact n-gram join and periodic runs against brute force, with odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.llm import neardup, ngram_join, periodic, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n int, word string, runs string, tiles string"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, "*** ### $$$"), (7, "Ünïcödé ▁ text with 日本語 and × ÷ ÿ"), (8, "the cat sat on the mat " * 400),
    (8, "the cat sat on the mat " * 400), (9, "x" * 3000), (None, "no id here at all here at all"), (None, None),
]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", 1, "w", "r", "t") for i, t in rows], SCHEMA)


# periodic runs


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        at = 0
        while at < n - q:
            end = at
            while end < n - q and words[end] == words[end + q]:
                end += 1
            if end > at and end - at + q >= max(12, 2 * q):
                found.setdefault((at, end - at + q), q)
            at = max(end, at + 1)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(250):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, k = rng.randint(0, 120), rng.choice([1, 2, 2, 3, 5, 30])
            w = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.6:
                a, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
                w[a:] = [w[a + (i - a) % p] for i in range(a, n)]
            if n and rng.random() < 0.3:
                w[n // 2 : n // 2] = [rng.randrange(k) for _ in range(rng.randint(1, 9))] * rng.randint(2, 8)
            texts.append(w)
        starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        got = periodic.runs_of(np.array(sum(texts, []), np.int64), starts)
        want = [(s + starts[i], length, q) for i, t in enumerate(texts) for s, length, q in plain_runs(t)]
        assert [tuple(r) for r in got] == sorted(want, key=lambda r: (r[0], r[2]))


def test_range_successors():
    rng = np.random.default_rng(2)
    values = rng.permutation(300)
    tree = periodic.RangeSuccessor(values)
    left = rng.integers(0, 299, 500)
    right = np.array([rng.integers(a + 1, 301) for a in left])
    low = rng.integers(0, 300, 500)
    high = np.array([rng.integers(a, 301) for a in low])
    n, first, second, last = tree.window(left, right, low, high)
    for i in range(500):
        inside = sorted(v for v in values[left[i] : right[i]] if low[i] <= v <= high[i])
        assert n[i] == len(inside)
        assert not inside or (first[i], last[i]) == (inside[0], inside[-1])
        assert len(inside) < 2 or second[i] == inside[1]


def test_runs_report_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 150)))) for i in range(150)]
    rows += [(i, "a  b\tc\nd " * k) for i, k in ((500, 3), (501, 2), (502, 40))] + ODD
    got = periodic.runs_report(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    chosen = 0
    for doc_id, text in rows:
        words = (text or "").encode().split()
        n = len(words)
        if doc_id is not None and n:
            h = zlib.crc32(str(doc_id).encode())
            if h % 10 == 0:
                chosen += 1
                g = h // 10
                a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
                words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = plain_runs(words)
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()
        collapsed = b" ".join(w for i, w in enumerate(words) if i not in dropped)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines).hexdigest(), hashlib.sha256(collapsed).hexdigest(), n)
        assert want in [tuple(r)[1:] for r in by_id[doc_id]]
    assert chosen > 5
    assert periodic.runs_report(docs_of(spark, [])).count() == 0


def test_runs_of_a_very_long_text(spark):
    rng = random.Random(6)
    head = [f"w{rng.randint(0, 9_000)}" for _ in range(200_000)]
    text = " ".join(head + head[-50_000:] * 2 + ["end"])
    r = periodic.periodic_runs(docs_of(spark, [(1, text), (2, "z " * 300_000)])).orderBy("doc_id").collect()
    assert [tuple(x) for x in r[0].runs][-1] == (150_000, 150_000, 50_000) and r[0].collapsed == " ".join([*head, "end"])
    assert [tuple(x) for x in r[1].runs] == [(0, 300_000, 1)] and r[1].collapsed == "z" and r[1].n_words == 300_000


# spelling variants


def plain_variants(counts):
    near = {w: set() for w in counts}
    letters = {c for w in counts for c in w}
    for w in counts:
        changed = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        near[w] = {v for v in changed if v in counts and v != w}
    out = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        out[w] = (form, len(near[w]), counts.get(form))
    rows = set()
    for w, (form, k, form_n) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, counts[w], k, form_n))
    return rows


def plain_counts(rows, typo=None, least=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if typo and h % typo == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                counts[w] += 1
    return counts


def test_variants_equal_brute_force(spark):
    rng = random.Random(7)
    for letters, size in (("ab", 7), ("abcé", 5)):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, size))) for _ in range(160)]
        counts = {w: rng.choice([1, 1, 2, 3, 5, 9, 20, 100]) for w in words}
        got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
        assert {tuple(r) for r in got} == plain_variants(counts) and len(got) == len(counts)
    ties = {"aaaaa": 10, "aaaab": 20, "aaaac": 20, "aaaaaa": 5, "aaaaaaa": 1}
    assert {tuple(r) for r in spelling.variants(spark.createDataFrame(list(ties.items()), "word string, n long")).collect()} == plain_variants(ties)
    # each form doubles the count: a chain as long as counts allow
    chain = {"a" * (5 + i): 2**i for i in range(40)}
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"a" * 44}


def test_variants_report_by_brute_force(spark):
    rng = random.Random(8)
    words = ["Planet", "planes", "école", "Écoles", "lettre", "lettres", "WORD", "ÀÉÎÕÜ", "naïve"]
    rows = [(i, ", ".join(rng.choice(words) for _ in range(120)) + " x×y÷z abĀcdefg") for i in range(60)] + ODD
    got = spelling.variants_report(docs_of(spark, rows)).collect()
    counts = {w: n for w, n in plain_counts(rows, 97).items() if n >= 3}
    assert {tuple(r) for r in got} == plain_variants(counts) and len(counts) > len(words) - 2
    plain = spelling.word_counts(docs_of(spark, rows), least_letters=1).collect()
    assert {r.word: r.n for r in plain} == plain_counts(rows, least=1)
    assert spelling.variants_report(docs_of(spark, [])).count() == 0
    assert spelling.variants_report(docs_of(spark, [(1, None), (2, "")])).count() == 0


# n-gram join


def plain_sets(rows, width):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


def plain_components(rows, width, percent):
    sets = plain_sets(rows, width)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_bounds_and_bands():
    rng = np.random.default_rng(3)
    assert [ngram_join.band_of(n) for n in (1, 128, 129, 256, 257, 512, 513)] == [0, 0, 1, 1, 2, 2, 3]
    sets = [np.unique(rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64)) for _ in range(40)]
    sets += [np.unique(np.concatenate((s[: int(len(s) * 0.95)], rng.integers(0, 2**63, 3).astype(np.uint64)))) for s in sets]
    for band in (0, 2):
        bits = np.stack([ngram_join.bitmap(s, band) for s in sets])
        every = np.arange(len(sets))
        bound = ngram_join.overlap_bound(np.array([len(s) for s in sets]), bits, every, every)
        shared = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
        assert (shared <= bound).all() and (np.diag(bound) == np.diag(shared)).all()
    common = np.sort(sets[0])[::2]
    order = ngram_join.first_shingles(sets[0], common, np.zeros(len(common), np.uint8), len(sets[0]))
    assert sorted(order) == sorted(sets[0]) and not set(order[: len(sets[0]) // 2 - 1].tolist()) & set(common.tolist())


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_join_equals_brute_force(spark, monkeypatch, width, percent):
    monkeypatch.setattr(neardup, "POST_BLOCK", 6)
    monkeypatch.setattr(neardup, "SET_BLOCK", 5)
    monkeypatch.setattr(ngram_join, "RARE_DOCS", 8)
    monkeypatch.setattr("demandloom.llm.common.HOT_ROWS", 20)
    rng = random.Random(width)
    passage = [f"p{i}" for i in range(80)]
    rows = []
    for _ in range(14):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([2, 8, 60, 130, 135, 300]))]
        for _ in range(rng.choice([1, 3, 30])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"n{rng.randint(0, 99999)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(600 + i, " ".join([*passage, *(f"q{rng.randint(0, 10**6)}" for _ in range(rng.choice([1, 4, 9, 40])))])) for i in range(60)]  # a passage in many documents
    chain = [f"c{i}" for i in range(120)]
    for i in range(40):  # neighbours are alike, ends are not
        chain = [w if rng.random() > 0.01 else f"d{rng.randint(0, 10**6)}" for w in chain]
        rows.append((800 + i, " ".join(chain)))
    rows += [(1000, None), (1001, ""), (1002, "Solo"), (1003, "solo"), (1004, " \t")]
    got = ngram_join.ngram_join(docs_of(spark, [*rows, (None, rows[0][1]), (None, None)]), width, percent).collect()
    want = plain_components(rows, width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert len(got) == len(rows) + 2 and all(r.component_id is None for r in got if r.doc_id is None)
    assert len({c for _, c in want.values()}) < len(rows) - 60


def test_join_of_odd_rows(spark):
    got = ngram_join.join_report(docs_of(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id in (1, 2, 3, 4, 5, 8)} == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (8, 6, 8)}
    assert ngram_join.join_report(docs_of(spark, [])).count() == 0
    rng = random.Random(4)
    words = [f"w{rng.randint(0, 50_000)}" for _ in range(300_000)]
    long_ = [(1, " ".join(words)), (2, " ".join(words[:295_000] + [f"x{i}" for i in range(5_000)])), (3, " ".join(words[:150_000]))]
    assert {r.doc_id: r.component_id for r in ngram_join.join_report(docs_of(spark, long_)).collect()} == {1: 1, 2: 1, 3: 3}


def test_common_shingles_are_counted_over_all_documents(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "RARE_DOCS", 50)
    monkeypatch.setattr(ngram_join, "STRETCH", 2_000)
    rng = random.Random(2)
    rows = [(i, " ".join(["all of them", *(f"w{rng.randint(0, 10**6)}" for _ in range(30))])) for i in range(900)]
    hashes, classes = ngram_join.common_shingles(docs_of(spark, rows).repartition(3), 3)
    assert hashes.tolist() == neardup.Shingler(3).sets(b"all of them").tolist() and classes.tolist() == [9]
