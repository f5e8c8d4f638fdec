"""Language identification by interpolated Kneser-Ney character models.

Words are maximal runs of letters, lower-cased, between a start and an end mark; contexts do not reach over a word.
So a text's cross-entropy under a language is a sum over its words, and a worker scores each different word once.

Training counts (language, word) on a sample of labelled rows, bounded in rows and bytes per language, then builds
one model per language: for each order the hashes of the n-grams seen, sorted, with their interpolated
log-probability, and the hashes of the contexts seen, sorted, with their back-off weight. Models are written as
Parquet. They travel to the workers in groups of at most MODEL_BYTES: mostly one; with more, the best language so far
goes from pass to pass with the row. Prediction takes the language with the lowest cross-entropy per character and
rejects a text whose cross-entropy is far above what texts of that language have (calibrated on sample rows the model
did not learn from).
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.llm.common import bytes_list, durable, held_out, map_arrow, slices, spread_join, worker_state

#: Order of the models, and the bound of the sample of each language in expectation: rows, bytes, and bytes of one text.
ORDER = 5
SAMPLE_ROWS = 1_500
SAMPLE_BYTES = 8 << 20
SAMPLE_TEXT_BYTES = 1 << 20
#: Models that the driver and the workers hold at a time; a single larger one goes alone.
MODEL_BYTES = 64 << 20
#: A longer run of letters is read as several.
LONGEST_RUN = 1_000
#: A text is rejected if its cross-entropy exceeds the mean of its language by this many standard deviations, and by
#: this many bits a character at least: a sound text that quotes another language at length stays below that.
REJECT_Z = 8.0
REJECT_BITS = 2.25
UNDETERMINED = "und"
MEMO_WORDS = 150_000
MEMO_CHARS = 40

_LETTERS = re.compile(r"[^\W\d_]+")
_START, _END = 2, 3
_MIX = np.uint64(0x9E3779B97F4A7C15)


def letter_runs(text: bytes | None) -> list[str]:
    """Lower-cased runs of letters (numerals that are no digits are dropped)."""
    if not text:
        return []
    found = _LETTERS.findall(text.decode("utf-8", "replace").lower())
    if not all(map(str.isalpha, found)):
        found = [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]
    if len(max(found, key=len, default="")) > LONGEST_RUN:
        found = [w[k : k + LONGEST_RUN] for w in found for k in range(0, len(w), LONGEST_RUN)]
    return found


def _grams(words: list[str], order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Per order n: hashes of the n-gram that ends at each position, and whether it lies within the word; word number by position.

    Positions are the characters and the end mark; an n-gram may begin with the start mark.
    """
    lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    total = int(lengths.sum() + 2 * len(words))
    flat = np.empty(total, np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths + 2)[:-1]]).astype(np.int64)
    flat[starts] = _START
    flat[starts + lengths + 1] = _END
    inside = np.ones(total, bool)
    inside[starts] = False
    inside[starts + lengths + 1] = False
    flat[inside] = codes
    inside[starts + lengths + 1] = True  # now: every position that is predicted
    at = np.flatnonzero(inside)
    depth = at - np.repeat(starts, lengths + 1)
    hashes, within, value = [], [], np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, order + 1):
            ok = depth >= n - 1
            value = np.where(ok, (value + flat[np.maximum(at - n + 1, 0)] + np.uint64(1)) * _MIX, value)
            value = value ^ (value >> np.uint64(29))
            hashes.append(value.copy())
            within.append(ok)
    return hashes, within, np.repeat(np.arange(len(words)), lengths + 1)


def _contexts(words: list[str], order: int) -> list[np.ndarray]:
    """Per order n from 2: the hash of the n-1 characters before each predicted position."""
    lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
    total = int(lengths.sum() + 2 * len(words))
    flat = np.empty(total, np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths + 2)[:-1]]).astype(np.int64)
    flat[starts], flat[starts + lengths + 1] = _START, _END
    middle = np.ones(total, bool)
    middle[starts] = middle[starts + lengths + 1] = False
    flat[middle] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    predicted = np.ones(total, bool)
    predicted[starts] = False
    at = np.flatnonzero(predicted)
    out, value = [], np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(2, order + 1):
            value = (value + flat[np.maximum(at - n + 1, 0)] + np.uint64(1)) * _MIX
            value = value ^ (value >> np.uint64(29))
            out.append(value.copy())
    return out


@dataclass
class Model:
    """One language: sorted hash arrays by order with log2 probabilities, and by context length with log2 back-off."""

    lang: str
    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backs: list[np.ndarray]
    unseen: float  # log2 probability of a character never seen
    mean: float = 0.0
    spread: float = 1.0
    per_char: float = 1.0

    def entropy(self, words: list[str]) -> np.ndarray:
        """Bits of each word, its end mark included."""
        hashes, within, word = _grams(words, len(self.grams))
        contexts = _contexts(words, len(self.grams))
        bits = np.zeros(len(word))
        open_ = np.arange(len(word))
        for n in range(len(self.grams), 0, -1):
            rows = open_[within[n - 1][open_]] if n > 1 else open_
            found, where = _find(self.grams[n - 1], hashes[n - 1][rows])
            bits[rows[found]] += self.logs[n - 1][where[found]]
            missed = rows[~found]
            if n > 1:
                known, where = _find(self.contexts[n - 2], contexts[n - 2][missed])
                bits[missed[known]] += self.backs[n - 2][where[known]]
                done = np.zeros(len(word), bool)
                done[rows[found]] = True
                open_ = open_[~done[open_]]
            else:
                bits[missed] += self.unseen
        return -np.bincount(word, weights=bits, minlength=len(words))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table) or not len(keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


def fit_model(lang: str, words: list[str], counts: np.ndarray, order: int = ORDER) -> Model:
    """Interpolated Kneser-Ney from different words and how often they occur.

    The highest order takes counts, lower ones the number of different characters before (n-grams that begin with the
    start mark have none and keep their counts). One discount per order, n1 / (n1 + 2 n2).
    """
    hashes, within, word = _grams(words, order)
    contexts = _contexts(words, order)
    weight = counts[word].astype(np.float64)
    grams, logs, context_keys, backs = [], [], [], []
    lower = None  # per position: interpolated probability at the order below
    for n in range(1, order + 1):
        ok = within[n - 1]
        keys, first, back_to = np.unique(hashes[n - 1][ok], return_index=True, return_inverse=True)
        times = np.bincount(back_to, weights=weight[ok])
        if n < order:
            longer = within[n]
            pairs = np.unique(np.stack([hashes[n][longer], hashes[n - 1][longer]], 1), axis=0)
            kinds = np.bincount(np.searchsorted(keys, pairs[:, 1]), minlength=len(keys))
            times = np.where(kinds > 0, kinds, times).astype(np.float64)
        once, twice = float((times == 1).sum()), float((times == 2).sum())
        discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        if n == 1:
            total, kinds_here = times.sum(), len(keys)
            spare = discount * kinds_here / total
            probability = np.maximum(times - discount, 0) / total + spare / (kinds_here + 256)
            unseen = float(np.log2(spare / (kinds_here + 256)))
        else:
            of = contexts[n - 2][ok][first]  # the context of each n-gram
            keys_c, inverse = np.unique(of, return_inverse=True)
            total = np.bincount(inverse, weights=times)
            kinds_here = np.bincount(inverse)
            gamma = discount * kinds_here / total
            below = lower[ok][first]
            probability = np.maximum(times - discount, 0) / total[inverse] + gamma[inverse] * below
            context_keys.append(keys_c)
            backs.append(np.log2(gamma).astype(np.float32))
        per_position = np.full(len(word), 0.0)
        per_position[ok] = probability[back_to]
        lower = per_position if lower is None else np.where(ok, per_position, lower)
        grams.append(keys)
        logs.append(np.log2(probability).astype(np.float32))
    return Model(lang, grams, logs, context_keys, backs, unseen)


class Identifier:
    """The models of all languages; identify() works on the words of texts."""

    def __init__(self, models: list[Model], reject_z: float = REJECT_Z):
        self.models, self.reject_z = models, reject_z
        self.memo: dict[str, int] = {}
        self.bits = np.zeros((0, max(1, len(models))))

    def _rows(self, words: set[str]) -> tuple[dict[str, int], np.ndarray]:
        """Numbers and bits (word x language) of words outside the memo; joins the memo as long as there is room."""
        new = sorted(words.difference(self.memo))
        bits = np.stack([m.entropy(new) for m in self.models], 1) if new else self.bits[:0]
        base = len(self.bits)
        if base + len(new) <= MEMO_WORDS:
            self.memo.update((w, base + i) for i, w in enumerate(new) if len(w) <= MEMO_CHARS)
            self.bits = np.concatenate([self.bits, bits])
            if all(len(w) <= MEMO_CHARS for w in new):
                return {}, self.bits
            return {w: base + i for i, w in enumerate(new)}, self.bits
        return {w: base + i for i, w in enumerate(new)}, np.concatenate([self.bits, bits])

    def identify(self, texts: list[bytes | None], states: list[State] | None = None) -> list[State]:
        """The state of each text after these languages, from that after earlier groups of languages.

        Ties go to the language that sorts first.
        """
        runs = [letter_runs(t) for t in texts]
        states = states or [NO_STATE] * len(texts)
        if not self.models:
            return states
        extra, bits = self._rows({w for words in runs for w in words})
        memo, out = self.memo, []
        for words, before in zip(runs, states, strict=True):
            if not words:
                out.append(before)
                continue
            at = [memo[w] if w in memo else extra[w] for w in words]
            n = sum(map(len, words)) + len(words)
            entropy = bits[at].sum(0) / n
            best = int(np.argmin(entropy))
            logs = -entropy * min(n, SCORE_CHARS)
            total = float(logs.max() + np.log2(np.exp2(logs - logs.max()).sum()))
            if before.total is not None:
                total = float(np.logaddexp2(total, before.total))
            if before.lang is not None and before.entropy <= entropy[best]:
                out.append(State(before.lang, before.entropy, before.limit, n, total))
                continue
            model = self.models[best]
            limit = model.mean + max(REJECT_BITS, self.reject_z * float(np.sqrt(model.spread**2 + model.per_char**2 / n)))
            out.append(State(model.lang, float(entropy[best]), limit, n, total))
        return out


#: The score takes a text as no longer than this.
SCORE_CHARS = 40


class State(NamedTuple):
    """Of a text: the best language so far, its bits per character and their limit, characters, and log2 of the sum of likelihoods."""

    lang: str | None
    entropy: float
    limit: float
    n: int
    total: float | None


NO_STATE = State(None, math.inf, math.inf, 0, None)
STATE = [T.StructField(n, t) for n, t in (("__lang", T.StringType()), ("__entropy", T.DoubleType()), ("__limit", T.DoubleType()), ("__n", T.LongType()), ("__total", T.DoubleType()))]
STATE_TYPES = (pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.float64())


def _sample(labelled: DataFrame, rows: int) -> DataFrame:
    """About `rows` different texts and SAMPLE_BYTES of each language, chosen by a hash of the text; all of a smaller one.

    Copies of a text count once. No language is left without a text: the one with the smallest hash is always in, and of
    a language whose texts are all above SAMPLE_TEXT_BYTES its shortest ones count.
    """
    texts = labelled.select("lang", F.xxhash64("text").alias("__h"), F.octet_length("text").alias("__size")).groupBy("lang", "__h").agg(F.min("__size").alias("__size"))
    texts = durable(texts, "lang-texts")
    longest = durable(texts.groupBy("lang").agg(F.count("*").alias("__n"), F.greatest(F.min("__size"), F.lit(SAMPLE_TEXT_BYTES)).alias("__longest")), "lang-longest")
    fitting = spread_join(texts, longest, ["lang"], "__n").where("__size <= __longest")
    draw = F.pmod(F.col("__h"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    totals = fitting.groupBy("lang").agg(F.count("*").alias("__texts"), F.sum("__size").alias("__bytes"), F.min(F.struct(draw, "__h"))["__h"].alias("__first"), F.max("__longest").alias("__longest"))
    share = F.least(F.lit(float(rows)) / F.col("__texts"), F.lit(float(SAMPLE_BYTES)) / F.greatest("__bytes", F.lit(1)))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("__rows"))
    totals = durable(totals.join(counts, "lang").select("lang", "__rows", "__first", "__longest", share.alias("__share")), "lang-totals")
    met = spread_join(labelled.select("lang", "text", F.xxhash64("text").alias("__h")), totals, ["lang"], "__rows")
    chosen = ((draw < F.col("__share")) & (F.octet_length("text") <= F.col("__longest"))) | (F.col("__h") == F.col("__first"))
    return met.where(chosen).select("text", "lang").distinct()


@dataclass
class Trained:
    """The models as a table (lang, model), and groups of languages, each small enough to be held at a time.

    measured: by language the mean and spread of its calibration texts' bits per character.
    """

    table: DataFrame | None
    groups: list[list[str]]
    measured: dict[str, tuple[float, float]] = field(default_factory=dict)
    reject_z: float = REJECT_Z

    def identifier(self, group: list[str]) -> Identifier:
        rows = self.table.where(F.col("lang").isin(group)).orderBy("lang").collect()
        models = [pickle.loads(r["model"]) for r in rows]
        for m in models:
            mean, spread = self.measured.get(m.lang, (4.0, 0.0))
            # floors keep the limit apart from clean texts where the calibration rows are few or all alike
            m.mean, m.spread, m.per_char = mean, max(spread, 0.03 * mean), max(1.0, 0.5 * mean)
        return Identifier(models, self.reject_z)


def train(labelled: DataFrame, order: int = ORDER, sample_rows: int = SAMPLE_ROWS, reject_z: float = REJECT_Z, model_bytes: int = MODEL_BYTES) -> Trained:
    """Fit on (text, lang), both non-null: one sample text in five calibrates, the others teach.

    The sample has about sample_rows texts and SAMPLE_BYTES per language, so a language's group does not grow with the
    table. Every language that has a letter in a text of its own has a model: where the fifth that calibrates would be all
    that it has, it teaches, and the language keeps the limits of one without calibration texts.
    """
    known = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    part = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(5))
    letters = F.col("text").rlike("\\p{L}")
    taught = F.max((part != 0) & letters).over(Window.partitionBy("lang"))
    rows = durable(_sample(known, sample_rows).withColumn("part", F.when(taught, part).otherwise(1)), "lang-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            found: Counter[tuple[str, str]] = Counter()
            for text, lang in zip(bytes_list(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                found.update((lang, w) for w in letter_runs(text))
            columns = [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])

    words = map_arrow(rows.where("part != 0").select("text", "lang"), count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word")
        model = fit_model(pdf["lang"].iloc[0], list(pdf["word"]), pdf["n"].to_numpy(), order)
        return pd.DataFrame({"lang": [model.lang], "model": [pickle.dumps(model)]})

    table = durable(words.groupBy("lang").applyInPandas(build, "lang string, model binary"), "lang-models")
    groups: list[list[str]] = []
    held = model_bytes
    for r in table.select("lang", F.octet_length("model").alias("size")).orderBy("lang").toLocalIterator():
        if held + r["size"] > model_bytes:
            groups.append([])
            held = 0
        groups[-1].append(r["lang"])
        held += r["size"]
    trained = Trained(table, groups, reject_z=reject_z)
    judged = identified(rows.where("part = 0").select("text", "lang"), trained)
    long_ = F.when(F.col("__n") >= 400, F.col("__entropy"))
    stats = judged.where("__lang = lang").groupBy("lang").agg(F.avg("__entropy").alias("mean"), F.stddev_pop(long_).alias("spread"))
    trained.measured = {r["lang"]: (r["mean"], r["spread"] or 0.0) for r in stats.collect()}
    return trained


def identified(docs: DataFrame, trained: Trained) -> DataFrame:
    """docs with the columns of STATE; a pass per group of languages, written out in between."""
    out = docs.drop(*[f.name for f in STATE])
    columns = out.columns
    at = columns.index("text")
    schema = T.StructType([*out.schema.fields, *STATE])
    for k, group in enumerate(trained.groups or [[]]):
        out = _one_pass(out if k == 0 else durable(out, "lang-pass"), trained.identifier(group) if group else Identifier([]), at, len(columns), schema)
    return out


def _one_pass(docs: DataFrame, identifier: Identifier, at: int, own: int, schema: T.StructType) -> DataFrame:
    key = uuid.uuid4().hex
    blob = docs.sparkSession.sparkContext.broadcast(pickle.dumps(identifier))
    again = len(docs.columns) > own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = worker_state(key, lambda: pickle.loads(blob.value))
        for batch in slices(batches, at):
            states = [State(*x) for x in zip(*[c.to_pylist() for c in batch.columns[own:]], strict=True)] if again else None
            got = mine.identify(bytes_list(batch.column(at)), states)
            made = [pa.array([g[i] for g in got], k) for i, k in enumerate(STATE_TYPES)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], *made], schema.names)

    return map_arrow(docs, run, schema)


def predict(docs: DataFrame, trained: Trained, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns of keep, then lang_pred, score, rejected and bits_per_char for every whole text; rows one for one."""
    columns = list(dict.fromkeys([*keep, "text"]))
    states = identified(docs.select(*columns), trained)
    n = F.least(F.col("__n"), F.lit(SCORE_CHARS))
    score = F.pow(F.lit(2.0), F.least(F.lit(0.0), -F.col("__entropy") * n - F.col("__total")))
    known = F.col("__lang").isNotNull()
    return states.select(
        *keep,
        F.coalesce("__lang", F.lit(UNDETERMINED)).alias("lang_pred"),
        F.when(known, score).otherwise(0.0).alias("score"),
        (~known | (F.col("__entropy") > F.col("__limit"))).alias("rejected"),
        F.when(known, F.col("__entropy")).alias("bits_per_char"),
    )


def train_on_fold(docs: DataFrame, learn_from: Column) -> Trained:
    return train(docs.where(learn_from))


def keep_known(docs: DataFrame, trained: Trained) -> DataFrame:
    """The documents that are not rejected, with their columns; a text without letters is rejected."""
    # numbered names, so that no column of docs can clash with the states
    inner = [c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    kept = identified(docs.toDF(*inner), trained).where("__lang IS NOT NULL AND __entropy <= __limit").select(*inner)
    return kept.toDF(*docs.columns)


def language_report(docs: DataFrame) -> DataFrame:
    """Contract rows: doc_id, held_out, lang_pred, score, rejected, bits_per_char; learns where held_out is false.

    A null text or one without letters is 'und' with score 0; a null lang teaches nothing; without any labelled row
    every text is 'und'.
    """
    out = held_out(F.col("doc_id"), 3, 1)
    return predict(docs, train_on_fold(docs, ~out)).select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected", "bits_per_char")
