"""Language-model scores from a subword lattice.

A word's probability is the sum over all its segmentations into vocabulary pieces of the product of piece
probabilities; a text is its words, then an end. Since no piece reaches over the mark that begins a word, the lattice
of a text factors at word boundaries, and the marginal of a text is the sum of its words' log marginals: the forward
recursion runs once per different word, over many words at a time.

The vocabulary's own scores weight the segmentations of the training words; from these weights come the expected
uses of each piece (forward-backward), and from the uses the probabilities that score texts. A merge vocabulary's
scores are ranks; they enter as a Zipf law over ranks. Pieces, bytes and the end share one distribution, so the
model's probabilities of all texts sum to at most 1. Bytes that are no UTF-8 are scored as byte pieces.

Work is arranged around the words table (word, count in training): built with map-side sums and shuffled once by
word. The most frequent words, a fixed number, go to the workers as a dictionary; a document's other words are joined
by word. No word of that join is frequent, so the join has no hot key, and its rows grow with the documents.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.common import bytes_list, durable, held_out, lowered, map_arrow, slices, worker_state
from demandloom.llm.pieces import DEFAULT_MODEL, MARK, SuffixTable, Vocabulary, codes_of, read_model

#: Words in the dictionary of each worker, and how many counted words a task holds before it passes them on.
HEAD_WORDS = 100_000
#: Longer words are never among them, so that what is broadcast is bounded in bytes.
HEAD_BYTES = 64
FLUSH_WORDS = 300_000
#: Rounds of expected counts, and the weight of the vocabulary's own scores among them, in pieces.
ROUNDS = 2
PRIOR_PIECES = 2_000.0
#: Longer words go through the recursion one by one, in windows of so many characters.
LONG_WORD = 40
WINDOW = 1 << 15


@dataclass
class Arcs:
    """Arcs of some words' lattices: states they lead from and to, piece ids (-1 - c: character c as bytes), and the runs.

    Arcs of a run have different ends and different starts; an arc's start is the end of arcs in earlier runs only.
    """

    start: np.ndarray
    end: np.ndarray
    ids: np.ndarray
    runs: np.ndarray  # bounds of the runs


@dataclass
class Lattice:
    """The endings of the pieces and log probabilities by id; the last id is the end of a text."""

    table: SuffixTable
    first_byte: int
    logs: np.ndarray

    @classmethod
    def from_model(cls, proto: bytes) -> Lattice:
        vocabulary = Vocabulary.from_model(proto)
        n = len(vocabulary.pieces)
        usable = [(p, i) for p, i in vocabulary.ids.items() if p.count(MARK) <= 1]
        scores = np.array(vocabulary.scores, np.float64)
        bytes_ = sorted(vocabulary.byte_ids.values())
        logs = np.full(n + 1, -np.inf)
        own = np.array([i for _, i in usable])
        if vocabulary.kind == "bpe":
            order = np.argsort(-scores[own], kind="stable")
            rank = np.empty(len(own))
            rank[order] = np.arange(len(own))
            logs[own] = -np.log(rank + 3.0)
        else:
            logs[own] = scores[own]
        logs[bytes_] = logs[own].min()
        logs -= np.log(np.exp(logs[np.isfinite(logs)]).sum())
        # 256 byte pieces in order, or none: then a character outside the vocabulary has the lowest probability once per byte
        first_byte = bytes_[0] if len(bytes_) == 256 else -1
        return cls(SuffixTable(usable), first_byte, logs)

    def fitted(self, counts: np.ndarray, ends: float) -> Lattice:
        """With probabilities from expected counts by id, the number of texts, and the present ones as a prior."""
        prior = np.where(np.isfinite(self.logs), np.exp(self.logs), 0.0)
        prior[-1] = 0.0
        prior *= PRIOR_PIECES / max(prior.sum(), 1e-300)
        total = counts + prior
        total[-1] = ends + 1.0
        with np.errstate(divide="ignore"):
            return replace(self, logs=np.log(total) - np.log(total.sum()))

    def _bytes_of(self, char: int) -> list[int]:
        raw = chr(char).encode("utf-8", "surrogateescape")
        return [self.first_byte + b for b in raw] if self.first_byte >= 0 else [-1] * len(raw)

    def _weights(self, ids: np.ndarray) -> np.ndarray:
        out = self.logs[np.maximum(ids, 0)]
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):
            lowest = self.logs[np.isfinite(self.logs)].min()
            chars, which = np.unique(ids[unknown], return_inverse=True)
            each = [sum(self.logs[i] if i >= 0 else lowest for i in self._bytes_of(-1 - int(c))) for c in chars]
            out[unknown] = np.array(each)[which]
        return out

    def _arcs(self, codes: np.ndarray, depth: np.ndarray, at: np.ndarray, words: np.ndarray | int) -> Arcs:
        """Arcs that end at the places `at` of the characters: depth counts from the word's start, words is the number of words before."""
        place, length, id_ = self.table.pieces_at(codes, depth, at)
        end = place + 1 + (words[place] if isinstance(words, np.ndarray) else words)
        group = depth[place] * (self.table.longest + 1) + length
        order = np.argsort(group, kind="stable")
        runs = np.concatenate([[0], np.flatnonzero(np.diff(group[order])) + 1, [len(order)]])
        return Arcs((end - length)[order], end[order], id_[order], runs)

    def _short(self, words: list[str]) -> tuple[Arcs, np.ndarray, np.ndarray, int]:
        """Arcs over marked words of ordinary lengths, the first and last state of each, and the number of states."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        row = np.repeat(np.arange(len(words)), lengths)
        depth = np.arange(len(row)) - first[row] + 1
        arcs = self._arcs(codes_of(words), depth, np.arange(len(row)), row)
        return arcs, first + np.arange(len(words)), first + lengths + np.arange(len(words)), len(row) + len(words)

    @staticmethod
    def _forward(arcs: Arcs, weights: np.ndarray, first: np.ndarray, states: int) -> np.ndarray:
        alpha = np.full(states, -np.inf)
        alpha[first] = 0.0
        for a, b in zip(arcs.runs[:-1], arcs.runs[1:], strict=True):
            end = arcs.end[a:b]
            alpha[end] = np.logaddexp(alpha[end], alpha[arcs.start[a:b]] + weights[a:b])
        return alpha

    def marginals(self, words: list[str], *others: Lattice) -> list[np.ndarray]:
        """Natural log of the marginal probability of each word (without its mark in the argument).

        One array for this lattice and one for each of others, which differ in their probabilities only.
        """
        models = (self, *others)
        out = [np.empty(len(words)) for _ in models]
        short, long_ = _by_length(words)
        if len(short):
            arcs, first, last, states = self._short([MARK + words[i] for i in short])
            for m, scores in zip(models, out, strict=True):
                scores[short] = self._forward(arcs, m._weights(arcs.ids), first, states)[last]
        for i in long_:
            for m, scores in zip(models, out, strict=True):
                scores[i] = m._long(MARK + words[i])[-1]
        return out

    def _windows(self, codes: np.ndarray) -> Iterator[Arcs]:
        depth = np.arange(1, len(codes) + 1)
        for a in range(0, len(codes), WINDOW):
            yield self._arcs(codes, depth, np.arange(a, min(a + WINDOW, len(codes))), 0)

    def _long(self, word: str) -> np.ndarray:
        """Forward scores of one word by position; arcs are held for one window at a time."""
        alpha = [-math.inf] * (len(word) + 1)
        alpha[0] = 0.0
        for arcs in self._windows(codes_of([word])):
            for start, end, w in zip(arcs.start.tolist(), arcs.end.tolist(), self._weights(arcs.ids).tolist(), strict=True):
                alpha[end] = _add(alpha[end], alpha[start] + w)
        return np.array(alpha)

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece over words that occur so often."""
        total = np.zeros(len(self.logs))
        short, long_ = _by_length(words)
        if len(short):
            arcs, first, last, states = self._short([MARK + words[i] for i in short])
            weights = self._weights(arcs.ids)
            alpha = self._forward(arcs, weights, first, states)
            beta = np.full(states, -np.inf)
            # a state's number of uses: log of the count less the word's marginal
            beta[last] = np.log(counts[short]) - alpha[last]
            use = np.empty(len(weights))
            for a, b in zip(arcs.runs[-2::-1], arcs.runs[:0:-1], strict=True):
                start, through = arcs.start[a:b], beta[arcs.end[a:b]] + weights[a:b]
                use[a:b] = alpha[start] + through
                beta[start] = np.logaddexp(beta[start], through)
            self._count(total, arcs.ids, np.exp(use))
        for i in long_:
            codes = codes_of([MARK + words[i]])
            alpha = self._long(MARK + words[i])
            back = [-math.inf] * len(alpha)
            back[-1] = math.log(counts[i]) - alpha[-1]
            for arcs in reversed(list(self._windows(codes))):
                weights = self._weights(arcs.ids)
                through = np.empty(len(weights))
                for k in range(len(weights) - 1, -1, -1):
                    through[k] = back[arcs.end[k]] + weights[k]
                    back[arcs.start[k]] = _add(back[arcs.start[k]], through[k])
                self._count(total, arcs.ids, np.exp(alpha[arcs.start] + through))
        return total

    def _count(self, total: np.ndarray, ids: np.ndarray, uses: np.ndarray) -> None:
        known = ids >= 0
        total += np.bincount(ids[known], weights=uses[known], minlength=len(total))
        chars, which = np.unique(ids[~known], return_inverse=True)
        for c, n in zip(chars, np.bincount(which, weights=uses[~known], minlength=len(chars)), strict=True):
            for i in self._bytes_of(-1 - int(c)):
                if i >= 0:
                    total[i] += n


def _add(a: float, b: float) -> float:
    """Log of the sum of two exponentials."""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _by_length(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    long_ = np.fromiter((len(w) >= LONG_WORD for w in words), bool, len(words))
    return np.flatnonzero(~long_), np.flatnonzero(long_)


def word_table(docs: DataFrame) -> DataFrame:
    """(word binary, c long): every different word of text with its count where learn is true; c 0: only elsewhere."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(found: dict[bytes, int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "c"])

        learnt: Counter[bytes] = Counter()
        other: set[bytes] = set()
        for batch in slices(batches, 0):
            for text, learn in zip(bytes_list(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                (learnt if learn else other).update(lowered(text).split())
            if len(learnt) + len(other) > FLUSH_WORDS:
                yield batch_of(dict.fromkeys(other, 0) | learnt)
                learnt.clear()
                other.clear()
        if learnt or other:
            yield batch_of(dict.fromkeys(other, 0) | learnt)

    return map_arrow(docs.select("text", "learn"), count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _shown(words: pa.Array) -> list[str]:
    return [w.decode("utf-8", "surrogateescape") for w in words.to_pylist()]


def _expected_counts(words: DataFrame, lattice: Lattice) -> np.ndarray:
    """Summed over all tasks: one row per piece at most comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(lattice.logs))
        for batch in batches:
            if batch.num_rows:
                total += lattice.expected(_shown(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(float))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["piece", "uses"])

    uses = map_arrow(words.where("c > 0").select("word", "c"), run, "piece int, uses double")
    out = np.zeros(len(lattice.logs))
    for r in uses.groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
        out[r["piece"]] = r["uses"]
    return out


def _with_marginals(words: DataFrame, fitted: Lattice, own: Lattice) -> DataFrame:
    """lp and own_lp: log10 marginals under the fitted probabilities and under the vocabulary's own scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = [pa.array(x / math.log(10.0)) for x in fitted.marginals(_shown(batch.column(0)), own)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *scores], ["word", "c", "lp", "own_lp"])

    return map_arrow(words.select("word", "c"), run, "word binary, c long, lp double, own_lp double")


SUMS = ("n_tokens", "n_known", "base_score", "score", "own_score")


def score_texts(docs: DataFrame, learn: str = "learn", model: str | bytes = DEFAULT_MODEL, rounds: int = ROUNDS, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, then the contract's columns for every row of docs (doc_id, text, and the boolean column learn).

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, over whole texts; a null text is an empty one, so an end
    only. own_score is the log10 marginal under the vocabulary's own scores, with the same probability of an end.
    Rows are kept one for one: equal rows (doc_id and text) are summed and divided again. Without any training row,
    counts are 0, the base probability is 1 / (V + 1) with V = 0, and pieces keep the vocabulary's own scores. Words
    of any length and bytes that are no UTF-8 have a probability.
    """
    proto = model if isinstance(model, bytes) else read_model(model)
    rows = docs.select("doc_id", "text", F.coalesce(F.col(learn), F.lit(False)).alias("learn"))
    words = durable(word_table(rows), "lm-words")
    totals = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    ends = rows.where("learn").count()
    n_train = (totals["n"] or 0) + ends
    v = (totals["v"] or 0) + (1 if ends else 0)
    start = Lattice.from_model(proto)
    lattice = start
    for _ in range(rounds):
        lattice = lattice.fitted(_expected_counts(words, lattice), ends)
    if not rounds:
        lattice = lattice.fitted(np.zeros(len(lattice.logs)), ends)
    scored = durable(_with_marginals(words, lattice, start), "lm-scored")
    base_unit = math.log10(n_train + (v + 1))
    end_base, end_score = math.log10(ends + 1) - base_unit, float(lattice.logs[-1] / math.log(10.0))
    top = scored.where(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("c"), "word").limit(head_words).select("word", "c", "lp", "own_lp").toArrow()
    facts = np.stack([top.column("c").to_numpy() > 0, np.log10(top.column("c").to_numpy() + 1.0) - base_unit, top.column("lp").to_numpy(), top.column("own_lp").to_numpy()], 1)
    head = docs.sparkSession.sparkContext.broadcast(pickle.dumps((top.column("word").combine_chunks().to_pylist(), facts)))
    key = uuid.uuid4().hex

    def open_head() -> tuple[dict[bytes, int], np.ndarray]:
        names, known = pickle.loads(head.value)
        return {w: i for i, w in enumerate(names)}, known

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document one row that sums its frequent words, and one for each other word."""
        import xxhash

        number, known = worker_state(key, open_head)
        find = number.get
        seen = 0
        for batch in slices(batches, 1):
            texts = bytes_list(batch.column(1))
            sums = np.zeros((len(texts), len(SUMS)))
            marks = [xxhash.xxh3_128_digest(b"0" if t is None else b"1" + t) for t in texts]
            rest: list[bytes] = []
            times: list[int] = []
            per_doc = np.zeros(len(texts), np.int64)
            for d, text in enumerate(texts):
                split_ = lowered(text).split()
                before, at, k = len(rest), [], []
                for word, n in Counter(split_).items():
                    i = find(word)
                    if i is None:
                        rest.append(word)
                        times.append(n)
                    else:
                        at.append(i)
                        k.append(n)
                per_doc[d] = len(rest) - before
                sums[d, 0] = len(split_) + 1
                sums[d, 1:] = (int(ends > 0), end_base, end_score, end_score)
                sums[d, 1:] += np.array(k, np.float64) @ known[at] if at else 0.0
            of = np.concatenate([np.arange(len(texts)), np.repeat(np.arange(len(texts)), per_doc)])
            more = len(rest)
            # the key of a row's own sums is no word and meets nothing in the join; the row's number in its task spreads equal texts
            own = [b"d" + m + (seen + i).to_bytes(6) for i, m in enumerate(marks)]
            seen += len(texts)
            words_ = pa.concat_arrays([pa.array(own, pa.binary()), pa.array([b"w" + w for w in rest], pa.binary())])
            tail = [pa.array(np.concatenate([sums[:, j], np.zeros(more)])) for j in range(len(SUMS))]
            mark = pa.array(np.frombuffer(b"".join(m[:8] for m in marks), np.int64)).take(pa.array(of))
            flag = pa.array(np.concatenate([np.ones(len(texts), np.int64), np.zeros(more, np.int64)]))
            number_of = pa.array(np.concatenate([np.zeros(len(texts), np.int64), np.array(times, np.int64)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), mark, words_, number_of, flag, *tail], ["doc_id", "mark", "word", "times", "rows", *SUMS])

    doc_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, mark long, word binary, times long, rows long, " + ", ".join(f"{c} double" for c in SUMS)
    parts = map_arrow(rows.select("doc_id", "text"), split, schema)
    keyed = scored.select(F.concat(F.lit(b"w"), F.col("word")).alias("word"), "c", "lp", "own_lp")
    met = parts.join(keyed, "word", "left")
    more = {
        "n_tokens": F.lit(0.0),
        "n_known": F.when(F.col("c") > 0, F.col("times")).otherwise(0),
        "base_score": F.when(F.col("times") > 0, F.col("times") * (F.log10(F.col("c") + 1.0) - F.lit(base_unit))).otherwise(0.0),
        "score": F.when(F.col("times") > 0, F.col("times") * F.col("lp")).otherwise(0.0),
        "own_score": F.when(F.col("times") > 0, F.col("times") * F.col("own_lp")).otherwise(0.0),
    }
    summed = met.groupBy("doc_id", "mark").agg(*[F.sum(F.col(c) + x).alias(c) for c, x in more.items()], F.sum("rows").alias("rows"))
    one = summed.select("doc_id", *[(F.col(c) / F.col("rows")).alias(c) for c in SUMS], F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy"))
    whole = [F.round(c).cast("long").alias(c) for c in SUMS[:2]]
    return one.select("doc_id", *whole, F.lit(n_train).cast("long").alias("train_tokens"), *SUMS[2:])


def score_report(docs: DataFrame) -> DataFrame:
    """Contract rows and own_score; learns where crc32(doc_id as text) mod 7 is not 2."""
    out = held_out(F.col("doc_id"), 7, 2)
    scored = score_texts(docs.select("doc_id", "text", (~out).alias("learn")))
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "own_score")
