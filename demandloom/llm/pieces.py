"""SentencePiece encoding and decoding by a shared-prefix lattice.

Texts are cut into marked words (a run of spaces with the characters that follow), since no piece reaches over such
a cut. The distinct marked words of a slice that are not known yet are sorted, which lays them out as a trie in
depth-first order: going from one word to the next keeps the forward states of their common prefix and computes
those of the remaining characters only.

A forward state at a position is the last piece of the best way to get there. For a unigram vocabulary best is the
highest sum of scores (Viterbi). For a merge (BPE) vocabulary, whose scores are merge ranks, sums of scores would
not give SentencePiece's pieces; there an arc into a position survives only if its piece and the last piece of the
position it starts from would stay apart when merged on their own. Each prefix then has one surviving path, and it
is the one that merging yields, so the recursion, the trie and the reuse are the same for both kinds.

Characters outside the vocabulary become byte pieces. A literal U+2581 in a text is written as bytes too, so that
decoding gives every text back unchanged (the library would turn it into a space).
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.llm.common import bytes_list, map_arrow, slices, worker_state

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Marked words that a worker remembers; longer ones than MEMO_CHARS are encoded each time.
MEMO_WORDS = 200_000
MEMO_CHARS = 48
#: Pairs of pieces whose merging a worker remembers.
APART_PAIRS = 600_000
#: Characters whose pieces are looked up at a time.
LOOKUP_CHARS = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class SuffixTable:
    """Hashes of all endings of the pieces: whether an ending is a piece, and whether a longer piece ends in it.

    Open addressing over two flat arrays; a code is 2 * (piece id + 1) plus 1 if a longer piece has this ending.
    """

    def __init__(self, pieces: list[tuple[str, int]]):
        self.longest = max((len(p) for p, _ in pieces), default=1)
        codes: dict[int, int] = {}
        for piece, i in pieces:
            value = 0
            for n, c in enumerate(reversed(piece), 1):
                value = (value + ord(c) + 1) * int(_MIX) & (1 << 64) - 1
                value ^= value >> 29
                codes[value] = codes.get(value, 0) | (2 * (i + 1) if n == len(piece) else 1)
        bits = max(4, (4 * len(codes)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.codes = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        for key, code in codes.items():
            at = key >> 64 - bits
            while self.codes[at]:
                at = (at + 1) & self.mask
            self.keys[at], self.codes[at] = key, code

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Codes by hash; 0: no piece ends so."""
        at = (hashes >> self.shift).astype(np.int64)
        out = self.codes[at]
        wrong = np.flatnonzero((self.keys[at] != hashes) & (out != 0))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            out[wrong] = self.codes[at[wrong]]
            wrong = wrong[(self.keys[at[wrong]] != hashes[wrong]) & (out[wrong] != 0)]
        return out

    def pieces_at(self, codes: np.ndarray, depth: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, piece id) of every piece that ends at the places `at` of some words' characters.

        depth counts a word's characters from 1. A character that is no piece has the id -1 - its code point.
        """
        places, lengths, ids = [], [], []
        value = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, self.longest + 1):
                value = (value + codes[at - n + 1] + np.uint64(1)) * _MIX
                value ^= value >> np.uint64(29)
                code = self(value)
                piece = (code >> 1) - 1
                if n == 1:
                    piece = np.where(piece >= 0, piece, -1 - codes[at].astype(np.int64))
                    hit = np.arange(len(at))
                else:
                    hit = np.flatnonzero(piece >= 0)
                places.append(at[hit])
                lengths.append(np.full(len(hit), n, np.int64))
                ids.append(piece[hit].astype(np.int64))
                longer = (code & 1 == 1) & (depth[at] > n)
                at, value = at[longer], value[longer]
                if not len(at):
                    break
        return np.concatenate(places), np.concatenate(lengths), np.concatenate(ids)


def codes_of(words: list[str]) -> np.ndarray:
    """Code points of all words; a byte that is no UTF-8 is a lone surrogate."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Vocabulary:
    """Pieces with scores; kind is 'bpe' or 'unigram'. special and byte pieces never match text directly."""

    def __init__(self, pieces: list[str], scores: list[float], kind: str, byte_ids: dict[int, int], special: Iterable[int] = ()):
        self.pieces, self.scores, self.kind, self.byte_ids = pieces, scores, kind, byte_ids
        hidden = {*special, *byte_ids.values()}
        self.ids = {p: i for i, p in enumerate(pieces) if i not in hidden}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a mark after its start: words can't be encoded apart")
        self.table = SuffixTable(list(self.ids.items()))
        self.surface = [p.replace(MARK, " ").encode() for p in pieces]
        for byte, i in byte_ids.items():
            self.surface[i] = bytes([byte])
        for i in special:
            self.surface[i] = b""
        #: By left piece (the last row: no piece before): whether a right piece stays apart from it.
        self._apart: list[dict[int, bool]] = [{} for _ in range(len(pieces) + 1)]
        self._pairs = 0
        self.unknown_score = min(scores, default=0.0) - 10.0

    @classmethod
    def from_model(cls, proto: bytes) -> Vocabulary:
        """Read a SentencePiece model; its trainer type is told from its scores (merge ranks are whole negative numbers)."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        pieces, scores = [sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)]
        byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        special = [i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)]
        return cls(pieces, scores, "bpe" if all(x == round(x) for x in scores) else "unigram", byte_ids, special)

    def merged(self, text: str) -> list[int]:
        """Plain merging of a short string: the best-scored adjacent pair first, the leftmost among equals."""
        find, scores, parts = self.ids.get, self.scores, list(text)
        pairs = [find(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, k = -math.inf, -1
            for at, i in enumerate(pairs):
                if i is not None and scores[i] > best:
                    best, k = scores[i], at
            if k < 0:
                return [find(p, -1) for p in parts]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            pairs[k : k + 1] = []
            if k:
                pairs[k - 1] = find(parts[k - 1] + parts[k])
            if k < len(pairs):
                pairs[k] = find(parts[k] + parts[k + 1])

    def apart(self, left: int, right: int) -> bool:
        """Whether two neighbouring pieces stay as they are when their characters are merged on their own.

        With -1 for left: whether merging the characters of right yields it.
        """
        row = self._apart[left]
        if (got := row.get(right)) is None:
            before = [] if left < 0 else [left]
            got = self.merged("".join(self.pieces[i] for i in (*before, right))) == [*before, right]
            if self._pairs < APART_PAIRS:
                self._pairs += 1
                row[right] = got
        return got

    def unknown(self, char: str) -> list[int]:
        """The byte pieces of a character outside the vocabulary (id 0 without byte pieces)."""
        raw = char.encode("utf-8", "surrogateescape")
        return [self.byte_ids[b] for b in raw] if self.byte_ids else [0]


def encode_words(vocabulary: Vocabulary, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
    """Piece ids of distinct marked words, in sorted order, forward states shared between neighbours."""
    extend = _extend_merged if vocabulary.kind == "bpe" else _extend_scored
    last: list[int] = [-1]  # the piece that ends at each depth; -1: a character outside the vocabulary
    back: list[int] = [0]  # the depth it starts from
    total: list[float] = [0.0]
    for word, shared, arcs in _candidates(vocabulary.table, sorted(set(words))):
        del last[shared + 1 :], back[shared + 1 :], total[shared + 1 :]
        extend(vocabulary, len(word), arcs, last, back, total)
        out: list[int] = []
        at = len(word)
        while at:
            if (piece := last[at]) >= 0:
                out.append(piece)
            else:
                out += vocabulary.unknown(word[at - 1])[::-1]
            at = back[at]
        out.reverse()
        yield word, out


def _candidates(table: SuffixTable, words: list[str]) -> Iterator[tuple[str, int, Iterator[tuple[int, int]]]]:
    """Per sorted word: how many characters it shares with the one before, and (length, id) of the pieces that may end after these.

    They come position by position, longest first, down to length 1, which each position has (id -1: no piece). Pieces
    are looked up for many words at a time, and for no more than LOOKUP_CHARS characters.
    """
    before, at = "", 0
    while at < len(words):
        some: list[str] = []
        shares: list[int] = []
        size = 0
        while at < len(words) and (not some or size + len(words[at]) <= LOOKUP_CHARS):
            word = words[at]
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            some.append(word)
            shares.append(shared)
            size += len(word)
            before = word
            at += 1
        lengths = np.fromiter(map(len, some), np.int64, len(some))
        codes = codes_of(some)
        depth = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
        new = np.flatnonzero(depth > np.repeat(shares, lengths))

        arcs = _arcs_at(table, codes, depth, new)
        for word, shared in zip(some, shares, strict=True):
            yield word, shared, arcs


def _arcs_at(table: SuffixTable, codes: np.ndarray, depth: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int]]:
    def some(a: int) -> Iterator[tuple[int, int]]:
        place, length, piece = table.pieces_at(codes, depth, places[a : a + LOOKUP_CHARS])
        order = np.lexsort((-length, place))
        return zip(length[order].tolist(), np.maximum(piece[order], -1).tolist(), strict=True)

    return chain.from_iterable(map(some, range(0, len(places), LOOKUP_CHARS)))


def _extend_merged(vocabulary: Vocabulary, size: int, arcs: Iterator[tuple[int, int]], last: list[int], back: list[int], total: list[float]) -> None:
    """Forward states of a merge vocabulary up to size: the longest piece that stays apart from what precedes it."""
    known, apart = vocabulary._apart, vocabulary.apart
    end, open_ = len(last), True
    for length, i in arcs:
        if open_ and i >= 0:
            left = last[end - length]
            if (fits := known[left].get(i)) is None:
                fits = apart(left, i)
            if fits:
                last.append(i)
                back.append(end - length)
                open_ = False
        if length == 1:
            if open_:
                last.append(-1)
                back.append(end - 1)
            if end == size:
                return
            end, open_ = end + 1, True


def _extend_scored(vocabulary: Vocabulary, size: int, arcs: Iterator[tuple[int, int]], last: list[int], back: list[int], total: list[float]) -> None:
    """Forward states of a unigram vocabulary up to size: the highest sum of scores."""
    scores, unknown = vocabulary.scores, vocabulary.unknown_score
    end, piece, start, best = len(last), -1, len(last) - 1, -math.inf
    for length, i in arcs:
        if i >= 0 and total[end - length] + scores[i] > best:
            piece, start, best = i, end - length, total[end - length] + scores[i]
        if length == 1:
            last.append(piece)
            back.append(start)
            total.append(total[start] + unknown if piece < 0 else best)
            if end == size:
                return
            end, piece, start, best = end + 1, -1, end, -math.inf


#: A newline or a literal mark on its own, a run of spaces with what follows it, or the rest.
_SEGMENT = re.compile(f"[\n{MARK}]|  *[^ \n{MARK}]*|[^ \n{MARK}]+")


class Encoder:
    """Encodes texts, remembering the marked words it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.memo: dict[str, bytes] = {}

    def encode_batch(self, texts: list[bytes | None]) -> list[bytes | None]:
        """The ids of each text as int32 bytes; None stays None, an empty text has no ids."""
        cut = [None if t is None else _SEGMENT.findall(" " + t.decode("utf-8", "surrogateescape")) if t else [] for t in texts]
        memo = self.memo
        new = {w for segments in cut if segments for w in segments}
        new.difference_update(memo)
        fresh: dict[str, bytes] = {}
        for name in ("\n", MARK):
            if name in new:
                new.discard(name)
                plain = name != MARK and name in self.vocabulary.ids
                fresh[name] = array("i", [self.vocabulary.ids[name]] if plain else self.vocabulary.unknown(name)).tobytes()
        for word, got in encode_words(self.vocabulary, [w.replace(" ", MARK) for w in new]):
            fresh[word.replace(MARK, " ")] = array("i", got).tobytes()
        room = MEMO_WORDS - len(memo)
        memo.update(islice(((w, x) for w, x in fresh.items() if len(w) <= MEMO_CHARS), max(0, room)))
        return [None if segments is None else b"".join([memo.get(w) or fresh[w] for w in segments]) for segments in cut]

    def decode(self, ids: Iterable[int]) -> bytes:
        return decode_ids(self.vocabulary, ids)


def decode_ids(vocabulary: Vocabulary, ids: Iterable[int]) -> bytes:
    """The text of piece ids: surfaces and bytes joined, without the leading space that encoding adds."""
    text = b"".join(map(vocabulary.surface.__getitem__, ids))
    return text[1:] if text[:1] == b" " else text


def encoder_for(proto: bytes) -> Encoder:
    """One encoder per model and worker process."""
    return worker_state(("pieces", proto), lambda: Encoder(Vocabulary.from_model(proto)))


def read_model(path: str = DEFAULT_MODEL) -> bytes:
    """The model file (some 100 kB, fixed by the vocabulary); its bytes travel with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str | bytes = DEFAULT_MODEL, check: bool = False) -> DataFrame:
    """docs with token_ids (array<int>, null for a null text) and, with check, round_trip.

    round_trip says whether the decoded ids give the text back, byte for byte; it is true for null and empty texts.
    Whole texts are encoded. Rows, repeated ones too, are kept one for one, with all their columns; a column of docs
    with the name of a new one gives way to it.
    """
    proto = model if isinstance(model, bytes) else read_model(model)
    made = ("token_ids", "round_trip") if check else ("token_ids",)
    columns = [c for c in docs.columns if c not in made]
    schema = docs.select(*columns).schema.add("token_ids", T.ArrayType(T.IntegerType()))
    if check:
        schema = schema.add("round_trip", "boolean")
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(proto)
        for batch in slices(batches, at):
            texts = bytes_list(batch.column(at))
            got = encoder.encode_batch(texts)
            offsets = np.zeros(len(got) + 1, np.int32)
            np.cumsum([len(x or b"") // 4 for x in got], out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(x or b"" for x in got), "<i4"))
            mask = pa.array([x is None for x in got])
            arrays = [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), values, mask=mask)]
            if check:
                same = [t is None or encoder.decode(np.frombuffer(x, "<i4").tolist()) == t for t, x in zip(texts, got, strict=True)]
                arrays.append(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays(arrays, [*columns, *made])

    return map_arrow(docs.select(*columns), run, schema)


def decode(encoded: DataFrame, model: str | bytes = DEFAULT_MODEL) -> DataFrame:
    """encoded with decoded (string) from token_ids; null ids give null, ids outside the vocabulary nothing."""
    proto = model if isinstance(model, bytes) else read_model(model)
    columns = [c for c in encoded.columns if c != "decoded"]
    schema = encoded.select(*columns).schema.add("decoded", "string")
    at = columns.index("token_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder_for(proto).vocabulary
        n = len(vocabulary.pieces)
        for batch in batches:
            ids = batch.column(at).to_pylist()
            texts = [None if x is None else decode_ids(vocabulary, (i for i in x if i is not None and 0 <= i < n)).decode("utf-8", "replace") for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*columns, "decoded"])

    return map_arrow(encoded.select(*columns), run, schema)


def encode_report(docs: DataFrame, model: str | bytes = DEFAULT_MODEL) -> DataFrame:
    """Per document: doc_id, n_tokens, n_byte_tokens, token_digest (xxhash64 of the ids), round_trip."""
    proto = model if isinstance(model, bytes) else read_model(model)
    low, high = (min(x), max(x)) if (x := Vocabulary.from_model(proto).byte_ids.values()) else (-1, -1)
    ids = F.coalesce(F.col("token_ids"), F.array().cast("array<int>"))
    byte_ids = F.filter(ids, lambda i: (i >= low) & (i <= high))
    return encode(docs.select("doc_id", "text"), proto, check=True).select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.size(byte_ids).cast("long").alias("n_byte_tokens"), F.xxhash64(ids).alias("token_digest"), "round_trip")
