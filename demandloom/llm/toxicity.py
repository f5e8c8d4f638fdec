"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases a word, takes homoglyphs to Latin letters, strips what surrounds it and reads digits and symbols
inside it as the letters they stand for. Patterns are whole words (" idiot ") or word beginnings (" idio"); phrases
that excuse a word (exceptions) are patterns too, and cancel the matches that they cover.

The lexicon is learnt from a bounded sample of labelled rows: beginnings and words that are more frequent in toxic
texts, counted in words and in documents, the best ones that do not contain each other. A pattern's weight is the
log of how rare it is in clean text. A text's evidence is the surprise at each pattern's count, k (log k + weight -
log words) less the excess: the count is held against clean text of the same length, so length alone never adds up. A logistic curve turns it into a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.common import bytes_list, durable, held_out, map_arrow, slices

#: Bound of the labelled sample, in rows of each class (in expectation), and of the lexicon.
SAMPLE_ROWS = 8_000
MOST_PATTERNS = 1_000
SHORTEST, LONGEST = 3, 10
#: Longer words are no patterns as a whole; their beginnings are.
LONGEST_WORD = 40
#: A pattern must be in so many toxic documents and so much more frequent there, by documents and by words.
LEAST_DOCS = 4
LEAST_LIFT = 4.0
LEAST_G = 18.0
THRESHOLD = 0.7
MEMO_WORDS = 150_000

#: Letters of other scripts that look like Latin ones, and digits and symbols that stand for letters.
HOMOGLYPHS = str.maketrans(
    "аеорсухіјѕһԁԛԝвкмнтгьӏѵґүАВЕКМНОРСТУХαοερτυνικηωβγσχօսհցոıɡɑɩʟɴʀ",
    "aeopcyxijshdqwbkmhtrblvryabekmhopctyxaoeptuvikhwbyoxouhgnigailnr",
)
STAND_INS = str.maketrans("013457@$!", "oieastasi")
#: Phrases in which a lexicon word means no harm; more are learnt.
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "sore loser", "pond scum")
#: A learnt exception is in so many clean documents of the sample and so much more frequent there.
EXCEPTION_DOCS = 5
EXCEPTION_LIFT = 8.0

_INNER = re.compile(r"[^\w@$!]+|_+")


def fold(word: str) -> list[str]:
    """The folded words of a run without spaces: mostly one, none for a run of symbols.

    Accents and invisible characters go, so that they do not split or hide a word.
    """
    if not word.isascii():
        kept = (c for c in unicodedata.normalize("NFKD", word) if unicodedata.category(c) not in ("Mn", "Cf"))
        word = unicodedata.normalize("NFKC", "".join(kept))
    word = word.lower().translate(HOMOGLYPHS)
    out = []
    for part in _INNER.split(word):
        part = part.rstrip("@$!")
        part = part.lstrip("@$!") if part[:2].strip("@$!") == "" else part
        if any(c.isalpha() for c in part):
            out.append(part.translate(STAND_INS) if not part.isalpha() else part)
    return out


class Folder:
    """fold() over whole texts, remembering words."""

    def __init__(self) -> None:
        self.memo: dict[bytes, str] = {}

    def __call__(self, text: bytes | None) -> str:
        """The folded text: words with single spaces around them."""
        out = []
        for w in (text or b"").split():
            got = self.memo.get(w)
            if got is None:
                got = " ".join(fold(w.decode("utf-8", "replace")))
                if len(self.memo) < MEMO_WORDS and len(w) < 64:
                    self.memo[w] = got
            if got:
                out.append(got)
        return " " + " ".join(out) + " " if out else " "


@dataclass
class Lexicon:
    """Patterns with their weights (-log of the rate per clean word); the curve's intercept and slope; exceptions."""

    patterns: list[str]
    weights: list[float]
    intercept: float = -10.0
    slope: float = 0.0
    exceptions: tuple[str, ...] = EXCEPTIONS
    _automaton: object = field(default=None, repr=False, compare=False)

    def automaton(self):
        import ahocorasick

        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for i, p in enumerate(self.patterns):
                self._automaton.add_word(p, (i, len(p)))
            for e in self.exceptions:
                phrase = " " + " ".join(x for w in e.split() for x in fold(w)) + " "
                self._automaton.add_word(phrase, (-1, len(phrase)))
            self._automaton.make_automaton()
        return self._automaton

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def matches(self, folded: str) -> list[tuple[int, int, int]]:
        """(pattern, start, end) of what no exception covers."""
        if not self.patterns:
            return []
        found, excused = [], []
        for last, (i, n) in self.automaton().iter(folded):
            (found if i >= 0 else excused).append((i, last - n + 1, last + 1))
        if not excused:
            return found
        # of the exceptions that begin no later than a match, does one reach its end? both lists are walked once
        excused.sort(key=itemgetter(1))
        out, at, reach = [], 0, -1
        for m in sorted(found, key=itemgetter(1)):
            while at < len(excused) and excused[at][1] <= m[1]:
                reach = max(reach, excused[at][2])
                at += 1
            if m[2] > reach:
                out.append(m)
        return out

    def evidence(self, folded: str) -> tuple[float, int]:
        """Weighted surprise at the counts, given the number of words; and the number of matches."""
        found = self.matches(folded)
        if not found:
            return 0.0, 0
        words, total = max(1, folded.count(" ") - 1), 0.0
        for i, k in Counter(m[0] for m in found).items():
            expected = words * math.exp(-self.weights[i])
            if k > expected:
                total += k * math.log(k / expected) - (k - expected)
        return total, len(found)

    def score(self, evidence: float) -> float:
        z = self.intercept + self.slope * math.log1p(evidence)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _surprise(k1: float, k0: float, n1: float, n0: float) -> float:
    """Log-likelihood ratio of two counts out of two totals."""
    e1 = (k1 + k0) * n1 / (n1 + n0)
    e0 = k1 + k0 - e1
    return 2 * ((k1 * math.log(k1 / e1) if k1 else 0.0) + (k0 * math.log(k0 / e0) if k0 else 0.0))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[DataFrame, dict[int, float]]:
    """(text, toxic) of about so many rows of each class, and the share of each class that it holds.

    The sample of labels is bounded, so it is what travels; texts are filtered where they lie. Repeated labels of one
    doc_id count as toxic if one is; null labels and null texts teach nothing.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    shares = {c: min(1.0, rows / n) for c, n in totals.items()}
    share = F.when(F.col("toxic") == 1, F.lit(shares.get(1, 0.0))).otherwise(F.lit(shares.get(0, 0.0)))
    some = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_003)) / F.lit(1_000_003.0) < share)
    some = durable(some, "toxic-labels")
    few = some.count() <= 4 * rows
    met = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(some) if few else some, "doc_id")
    return durable(met.select("text", "toxic"), "toxic-sample"), shares


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from the labelled rows of docs. Without rows of both classes it is empty and every score is near 0."""
    sample, shares = labelled_sample(docs, labels, sample_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder()
        words: list[Counter[str]] = [Counter(), Counter()]
        texts: list[Counter[str]] = [Counter(), Counter()]

        def flush() -> pa.RecordBatch:
            keys = list(texts[0].keys() | texts[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([c[k] for k in keys], pa.int64()) for c in (words[0], words[1], texts[0], texts[1])]], ["pattern", "k0", "k1", "d0", "d1"])
            for c in (*words, *texts):
                c.clear()
            return out

        for batch in slices(batches, 0):
            for text, toxic in zip(bytes_list(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                c: Counter[str] = Counter()
                for w, n in Counter(folder(text).split()).items():
                    c[""] += n
                    if len(w) <= LONGEST_WORD:  # a cut word with an end mark would match no text
                        c[f" {w} "] += n
                    for k in range(SHORTEST, min(len(w), LONGEST) + 1):
                        c[" " + w[:k]] += n
                words[toxic].update(c)
                texts[toxic].update(c.keys())
            if len(texts[0]) + len(texts[1]) > 400_000:
                yield flush()
        yield flush()

    counted = map_arrow(sample, count, "pattern string, k0 long, k1 long, d0 long, d1 long").groupBy("pattern").agg(*[F.sum(c).alias(c) for c in ("k0", "k1", "d0", "d1")])
    counted = durable(counted.where(F.col("d1") >= LEAST_DOCS), "toxic-counts")
    all_ = counted.where("pattern = ''").first()
    if all_ is None or not all_["k0"] or not all_["d0"]:
        return Lexicon([], [], exceptions=exceptions)
    n0, n1, docs0, docs1 = all_["k0"], all_["k1"], all_["d0"], all_["d1"]
    lift = ((F.col("k1") / n1) / ((F.col("k0") + 0.5) / n0) >= LEAST_LIFT) & ((F.col("d1") / docs1) / ((F.col("d0") + 0.5) / docs0) >= LEAST_LIFT)
    spread = F.col("d1") * F.log(F.col("d1") / docs1 * (docs0 + docs1) / (F.col("d0") + F.col("d1")))
    rows = counted.where((F.col("pattern") != "") & lift).orderBy(F.desc(spread), "pattern").limit(20 * MOST_PATTERNS).collect()
    ranked = sorted(((min(_surprise(r["k1"], r["k0"], n1, n0), _surprise(r["d1"], r["d0"], docs1, docs0)), r) for r in rows), key=lambda x: (-round(x[0], 6), -len(x[1]["pattern"]), x[1]["pattern"]))
    chosen, taken = [], set()
    for g, r in ranked:
        p = r["pattern"]
        if g < LEAST_G or len(chosen) >= MOST_PATTERNS:
            break
        starts = {p[:k] for k in range(2, len(p) + 1)}
        if starts & taken or any(q.startswith(p) for q in (x["pattern"] for x in chosen)):
            continue
        chosen.append(r)
        taken.add(p)
    lexicon = Lexicon([r["pattern"] for r in chosen], [-math.log((r["k0"] + 0.5) / (n0 + 1)) for r in chosen], exceptions=exceptions)

    lexicon.exceptions = (*exceptions, *learnt_exceptions(sample, lexicon, docs0, docs1))
    lexicon._automaton = None

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder()
        for batch in slices(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.evidence(folder(t))[0] for t in bytes_list(batch.column(0))], pa.float64()), batch.column(1)], ["g", "toxic"])

    points = map_arrow(sample, measure, "g double, toxic int").groupBy(F.round("g", 2).alias("g"), "toxic").count().toPandas()
    lexicon.intercept, lexicon.slope = _logistic(np.log1p(points["g"].to_numpy(float)), points["toxic"].to_numpy(float), points["count"].to_numpy(float) / points["toxic"].map(lambda c: shares[c]).to_numpy(float))
    return lexicon


def learnt_exceptions(sample: DataFrame, lexicon: Lexicon, docs0: int, docs1: int) -> list[str]:
    """Phrases of a matched word and its neighbour that are far more frequent in clean documents, by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder()
        found: list[Counter[str]] = [Counter(), Counter()]
        for batch in slices(batches, 0):
            for text, toxic in zip(bytes_list(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                found[toxic].update(phrases(lexicon, folder(text)))
        keys = list(found[0].keys() | found[1].keys())
        columns = [pa.array(keys, pa.string()), *[pa.array([c[k] for k in keys], pa.int64()) for c in found]]
        yield pa.RecordBatch.from_arrays(columns, ["phrase", "d0", "d1"])

    counted = map_arrow(sample, run, "phrase string, d0 long, d1 long").groupBy("phrase").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    lift = F.col("d0") / docs0 >= EXCEPTION_LIFT * (F.col("d1") + 0.5) / docs1
    rows = counted.where((F.col("d0") >= EXCEPTION_DOCS) & lift).orderBy(F.desc("d0"), "phrase").limit(MOST_PATTERNS).collect()
    return sorted(r["phrase"] for r in rows)


def phrases(lexicon: Lexicon, folded: str) -> set[str]:
    """Each matched word of a text with the word before it, and with the word after it."""
    out = set()
    for _, start, _ in lexicon.matches(folded):
        end = folded.index(" ", start + 1)
        if start:
            out.add(folded[folded.rindex(" ", 0, start) + 1 : end])
        if end + 1 < len(folded):
            out.add(folded[start + 1 : folded.index(" ", end + 1)])
    return out


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method, with a slight ridge so that separable data settle."""
    beta = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    ridge = np.array([1e-3, 1e-1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (n * (y - p)) - ridge * beta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def score_texts(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, predicted, n_matches and evidence for every whole text; rows one for one.

    A null, empty or wordless text has no evidence and the score of a text without matches.
    """
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder()
        for batch in slices(batches, 1):
            got = [lexicon.evidence(folder(t)) for t in bytes_list(batch.column(1))]
            scores = [lexicon.score(g) for g, _ in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array([k for _, k in got], pa.int64()), pa.array([g for g, _ in got], pa.float64())], ["doc_id", "score", "predicted", "n_matches", "evidence"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {doc_type}, score double, predicted int, n_matches long, evidence double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract rows; labels are learnt where crc32(doc_id as text) mod 3 is not 1."""
    out = held_out(F.col("doc_id"), 3, 1)
    lexicon = train(docs.where(~out), labels.where(~out))
    return score_texts(docs, lexicon).select("doc_id", out.alias("held_out"), "score", "predicted", "n_matches", "evidence")
