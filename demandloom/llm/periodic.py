"""Periodic runs of words, found by internal pattern matching, and texts with their repetitions collapsed.

A run is a stretch of words with smallest period q (words q apart are equal) of at least max(LEAST_LENGTH, 2 q) words
that no neighbouring word extends. The texts of a slice are searched at once:

1. Texts in which no four words in a row come twice have no run and are done.
2. Prefix doubling sorts the suffixes of the others and ranks every stretch of 4, 8, 16, ... words by document.
3. Each dyadic block asks for its own next occurrences in the windows behind it: the suffixes that begin with the block
   are a range of the suffix array, and a wavelet tree over the array finds the smallest (or largest) text position of
   that range beyond (or before) a given one. The first two and the last occurrence within a window no longer than the
   block fix all others, which are an arithmetic progression.
4. Each distance of a progression is a candidate period. Longest common extensions, read off the ranks of step 2, give
   the stretch that has it. Of equal stretches the smallest period counts.

A run of period q holds a block of length L <= (q + 1) / 2 that comes again q words on, so blocks of length L answer for
the periods 2 L - 1 to 4 L - 2, and those of 4 words, taken every third word, for all below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.common import WORD_SEPARATOR, WORD_SPACE, map_arrow, slices, word_count

LEAST_LENGTH = 12
SHORTEST_BLOCK = 4
SHORTEST_STEP = 3
#: Candidates whose extensions are measured together.
AT_ONCE = 1 << 18


class RangeSuccessor:
    """A wavelet tree over a permutation of 0..n-1: order statistics and neighbours of values in ranges of places.

    All methods take arrays of queries and answer them together, one level of the tree at a time.
    """

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values)).bit_length())
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate(([0], np.cumsum(~one))))
            values = np.concatenate((values[~one], values[one]))

    def below(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values at places left <= i < right are smaller than the bound."""
        count = np.zeros(len(left), np.int64)
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            l0, r0 = zeros[left], zeros[right]
            one = (bound >> bit & 1).astype(bool)
            count += np.where(one, r0 - l0, 0)
            left, right = np.where(one, zeros[-1] + left - l0, l0), np.where(one, zeros[-1] + right - r0, r0)
        return count

    def nth(self, left: np.ndarray, right: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th smallest value, from 0, at places left <= i < right."""
        value = np.zeros(len(left), np.int64)
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            l0, r0 = zeros[left], zeros[right]
            one = n >= r0 - l0
            n = np.where(one, n - (r0 - l0), n)
            value |= one.astype(np.int64) << bit
            left, right = np.where(one, zeros[-1] + left - l0, l0), np.where(one, zeros[-1] + right - r0, r0)
        return value

    def window(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the values from low to high at these places: how many, the first, the second and the last (where there are)."""
        before, upto = self.below(left, right, low), self.below(left, right, high + 1)
        n, last = upto - before, right - left - 1
        pick = (lambda k: self.nth(left, right, np.clip(k, 0, last)))
        return n, pick(before), pick(before + 1), pick(upto - 1)


def stretches(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks): ranks[k][i] names the 2 ** k words from i by the first place of its suffixes in the array.

    ids: the words of all texts in a row; starts: where each text begins, with the end. A stretch that leaves its text
    equals no other; the last level has no equal stretches.
    """
    n = len(ids)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    end = starts[text + 1]
    key = text * (int(ids.max()) + 1) + ids
    ranks: list[np.ndarray] = []
    step = 1
    while True:
        order = np.argsort(key, kind="stable")
        held = key[order]
        new = np.concatenate(([True], held[1:] != held[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        ranks.append(rank)
        if new.all():
            return order, ranks
        ahead = np.arange(n) + step
        inside = ahead < end
        key = rank * (n + 1) + np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        step *= 2


def extensions(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words from i and j on are equal, and how many before them."""
    n = len(ranks[0])
    right, left = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        rank, length = ranks[k], 1 << k
        a, b = i + right, j + right
        same = (b < n) & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
        right += np.where(same, length, 0)
        a, b = i - left - length, j - left - length
        same = (a >= 0) & (rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)])
        left += np.where(same, length, 0)
    return right, left


def runs_of(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows (start, length, period), by start and period, of all runs of these texts; starts count over all of them."""
    found = [np.zeros((0, 3), np.int64)]
    if not len(ids):
        return found[0]
    order, ranks = stretches(ids, starts)
    tree = RangeSuccessor(order)
    text_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    end_of = starts[text_of + 1]
    place = np.arange(len(ids)) - starts[text_of]
    for k, rank in enumerate(ranks):
        size = 1 << k
        if size < SHORTEST_BLOCK:
            continue
        smallest = size == SHORTEST_BLOCK
        often = np.bincount(rank, minlength=len(ids))
        at = np.flatnonzero((place % (SHORTEST_STEP if smallest else size) == 0) & (often[rank] > 1))
        near = 1 if smallest else 2 * size - 1
        for low in range(near, 4 * size - 1, size):
            block = at[at + low + size <= end_of[at]]
            left = rank[block]
            first_place = block + low
            last_place = np.minimum(block + np.minimum(low + size - 1, 4 * size - 2), end_of[block] - size)
            n, first, second, last = tree.window(left, left + often[left], first_place, last_place)
            n = np.where(n > 1, (last - first) // np.maximum(np.where(n > 1, second - first, 1), 1) + 1, n)
            apart = np.where(n > 1, second - first, 0)
            total = np.cumsum(n)
            for cut in range(0, int(total[-1]) if len(total) else 0, AT_ONCE):
                member = np.arange(cut, min(cut + AT_ONCE, int(total[-1])))
                of = np.searchsorted(total, member, side="right")
                there = first[of] + apart[of] * (member - (total[of] - n[of]))
                right, before = extensions(ranks, block[of], there)
                period = there - block[of]
                keep = (right + before >= period) & (right + before + period >= LEAST_LENGTH)
                found.append(np.unique(np.stack((block[of] - before, right + before + period, period), 1)[keep], axis=0))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    smallest_period = np.concatenate((np.ones(min(1, len(rows)), bool), (rows[1:, :2] != rows[:-1, :2]).any(1)))
    rows = rows[smallest_period]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _may_repeat(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each text has some SHORTEST_BLOCK words in a row twice (by hash: now and then a text without them passes)."""
    text = np.repeat(np.arange(len(starts) - 1, dtype=np.uint64), np.diff(starts))
    out = np.zeros(len(starts) - 1, bool)
    if len(ids) < SHORTEST_BLOCK:
        return out
    n = len(ids) - SHORTEST_BLOCK + 1
    value = text[:n].copy()
    with np.errstate(over="ignore"):
        for k in range(SHORTEST_BLOCK):
            value = (value + ids[k : n + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
    inside = text[:n] == text[SHORTEST_BLOCK - 1 :]
    value, owner = value[inside], text[:n][inside]
    order = np.argsort(value)
    twice = value[order][1:] == value[order][:-1]
    out[owner[order[1:][twice]].astype(np.int64)] = True
    return out


def _search(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(starts, runs, words, kept, text of each run) of the texts; runs count words over all texts, kept is by word."""
    trimmed = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    split = pc.ascii_split_whitespace(trimmed)
    sizes = np.where(pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False), 0, pc.list_value_length(split).to_numpy(zero_copy_only=False))
    words = pc.list_flatten(split)
    words = words.filter(pc.greater(pc.binary_length(words), 0))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    some = np.flatnonzero(_may_repeat(ids, starts))
    kept = np.ones(len(ids), bool)
    if not len(some):
        return starts, np.zeros((0, 3), np.int64), words, kept, np.zeros(0, np.int64)
    asked = np.concatenate([np.arange(starts[t], starts[t + 1]) for t in some])
    inner = np.concatenate(([0], np.cumsum(sizes[some])))
    runs = runs_of(ids[asked], inner)
    runs[:, 0] = asked[runs[:, 0]] if len(runs) else runs[:, 0]
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(change)[:-1] == 0
    return starts, runs, words, kept, np.searchsorted(starts, runs[:, 0], side="right") - 1


RUNS = "runs array<struct<start: long, length: long, period: long>>, collapsed string, n_words long"


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length and period, by start and period) and collapsed of each row of docs.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text. collapsed: the words that no run contains after its first period
    of words, joined by one space. A null, empty or blank text has no words, no runs and an empty collapsed text; a
    text is searched whole, in memory in proportion to its words times the logarithm of their number. Rows that repeat
    and rows without a doc_id are answered like any other; other columns of docs play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            starts, runs, words, kept, owner = _search(batch.column(1))
            if not kept.all():
                words = words.filter(pa.array(kept))
            counts = np.concatenate(([0], np.cumsum(kept)))[starts]
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(counts, pa.int32()), words), " ")
            fields = pa.StructArray.from_arrays([pa.array(runs[:, 0] - starts[owner], pa.int64()), pa.array(runs[:, 1]), pa.array(runs[:, 2])], ["start", "length", "period"])
            edges = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            listed = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), fields)
            yield pa.RecordBatch.from_arrays([batch.column(0), listed, collapsed, pa.array(np.diff(starts), pa.int64())], ["doc_id", "runs", "collapsed", "n_words"])

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {doc_type}, {RUNS}")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which every tenth document by the hash of its id repeats a stretch of its words to its end.

    With h = crc32(doc_id as text), g = h div 10 and n words: where h mod 10 = 0 and n > 0, word i >= a = g mod n becomes
    word a + (i - a) mod p with p = 1 + (n - a) div (3 + g mod 8). A null doc_id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.split(F.btrim("text", F.lit(WORD_SPACE)), WORD_SEPARATOR)
    some = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), word_count(F.col("text")).alias("n"))
    chosen = F.coalesce((F.col("h") % 10 == 0) & (F.col("n") > 0), F.lit(False))
    some = some.withColumn("w", F.when(chosen, words)).withColumn("a", F.when(chosen, F.col("g") % F.col("n")))
    some = some.withColumn("p", F.when(chosen, 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))))
    head = F.slice("w", F.lit(1), F.col("a").cast("int"))
    place = F.sequence(F.lit(0).cast("long"), F.col("n") - F.col("a") - 1)
    tail = F.transform(place, lambda i: F.get("w", (F.col("a") + i % F.col("p")).cast("int")))
    return some.select("doc_id", F.when(chosen, F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text")).alias("text"))


def runs_report(docs: DataFrame) -> DataFrame:
    """Contract rows over the planted texts: the longest run of each document and digests of all runs and of its collapsed text."""
    found = periodic_runs(planted(docs))
    ranked = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    best = F.array_min(ranked)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.array_join(line, "").alias("lines"), "collapsed", "n_words")
    return out.select(
        "doc_id", "n_runs", F.col("b.s").alias("start"), (-F.col("b.l")).alias("length"), F.col("b.p").alias("period"),
        F.floor(-1000 * F.col("b.l") / F.col("b.p")).alias("exponent_milli"), F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )
