"""Each stage of the pipeline, on its own input, against brute force; odd rows and clashing names."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from demandloom.llm import langid, pieces, quality

SF = "/root/testdata/sf0.001"
CLASHES = ("__lang", "__entropy", "__mix_rate", "__mix_row", "digest", "task", "component_id", "kept", "c0")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """[(name, rows in, rows out)] over a folder whose documents hold nulls, blanks, copies, near copies, a long text and odd columns."""
    import corpus_pipeline as P

    rng = random.Random(1)
    base = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    words = [w for _, t, lang, _ in base if lang == "en" and t for w in t.split() if w.isalpha()]
    near = [w for _ in range(200) for w in rng.sample(words, 1)]
    rows = base + [(5_000, None, "en", "src0"), (5_001, "", None, None), (5_002, "12 34 %% ##", "en", "src1"), (5_003, " \n\t", "fr", "src2"), (None, " ".join(near[:120]), "en", None)]
    rows += [(6_000 + i, " ".join(near[:i * 7] + ["other"] + near[i * 7 + 1 :]), "en", "src3") for i in range(12)] + [base[0], base[0]]
    rows += [(7_000, " ".join(rng.choice(words) for _ in range(120_000)), "en", "src1")]
    folder = tmp_path_factory.mktemp("pipeline")
    df = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.withColumns({c: F.lit("MINE") for c in CLASHES}).repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in P.STAGES:
        after = stage(spark, docs, str(folder)).cache()
        out.append((name, docs, after))
        docs = after
    whole = P.run(spark, str(folder))
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))
    return out


def rows_of(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def of(stages, name):
    return next((before, after) for n, before, after in stages if n == name)


def test_columns_and_clashes(stages):
    for name, before, after in stages:
        assert after.columns == (before.columns if name != "encode" else [*before.columns, "token_ids"])
        assert after.where(" OR ".join(f"`{c}` != 'MINE'" for c in CLASHES)).count() == 0


def test_language_stage(stages):
    before, after = of(stages, "language_id")
    trained = langid.train(before.where("text IS NOT NULL AND lang IS NOT NULL"))
    models = trained.identifier([r.lang for r in trained.table.select("lang").collect()])
    want = Counter()
    for r in before.collect():
        state = models.identify([None if r.text is None else r.text.encode()])[0]
        if state.lang is not None and state.entropy <= state.limit:
            want[r.doc_id, r.text, r.source] += 1
    assert rows_of(after) == want
    assert not {5_000, 5_001, 5_002, 5_003} & {k[0] for k in want} and {7_000, None} <= {k[0] for k in want}


def test_quality_stage(stages):
    before, after = of(stages, "quality_rules")
    table = quality._table(*quality._models(quality.DEFAULT_MODEL, quality.SECOND_MODEL))
    want = Counter()
    for r in before.collect():
        found, band = next(quality._measured(table, [None if r.text is None else r.text.encode()], quality.BANDS, 1))
        w = (r.text or "").encode().split()
        assert found.n == len(w)
        if found.kept(band, 1):
            assert w
            want[r.doc_id, r.text, r.source] += 1
    assert rows_of(after) == want


def test_near_duplicate_stage(stages):
    before, after = of(stages, "near_dedup")
    sets, first = {}, {}
    for r in before.collect():
        w = (r.text or "").encode().lower().split()
        if r.doc_id is not None:
            sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
            first[r.doc_id] = (r.doc_id, r.text, r.source)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for at, i in enumerate(ids):
        for j in ids[:at]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = Counter(first[i] for i in ids if find(i) == i) + Counter((r.doc_id, r.text, r.source) for r in before.where("doc_id IS NULL").collect())
    assert rows_of(after) == want and len(want) < len(first)


def test_mixing_stage(stages):
    before, after = of(stages, "mix_sources")
    rows = before.collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len((r.text or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while True:  # shares by weight; what goes beyond a cap is shared anew among the others
        rest = total - sum(target.values())
        over = [s for s in open_ if weight[s] * rest / sum(weight[o] for o in open_) >= 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        open_ -= set(over)
    target |= {s: weight[s] * rest / sum(weight[o] for o in open_) for s in open_}
    want = Counter()
    for r in rows:
        rate = target[r.source] / sizes[r.source] if sizes[r.source] else 0.0
        draw = int(hashlib.md5(f"mix:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        copies = math.floor(rate) + (draw < rate - math.floor(rate))
        if copies:
            want[r.doc_id, r.text, r.source] += copies
    assert rows_of(after) == want


def test_encoding_stage(stages):
    import sentencepiece

    before, after = of(stages, "encode")
    assert rows_of(after) == rows_of(before)
    sp = sentencepiece.SentencePieceProcessor(model_proto=pieces.read_model())
    known = {}
    for r in after.collect():
        if pieces.MARK not in r.text:
            assert r.token_ids == known.setdefault(r.text, sp.encode(r.text))
