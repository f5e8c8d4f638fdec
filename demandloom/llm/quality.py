"""Quality rules from tokeniser fertility.

Two public vocabularies split every word of a text: pieces with byte fallback, and byte-level pieces for many
languages. Three measures follow: characters per token (low where a vocabulary does not know the language or the text
is noise), the share of byte tokens (characters outside the vocabulary), and the entropy of the tokens (low where a
text repeats itself). Each must lie within the band of the text's main script. The second vocabulary is asked about
texts that the first one does not know well enough: one of them must. Words repeat much more than texts do, so a
worker splits a word once and then gathers its pieces from a table; a text's measures are a few array operations.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from demandloom.llm.common import bytes_list, map_arrow, slices, words_of, worker_state
from demandloom.llm.pieces import DEFAULT_MODEL, read_model

#: Characters that mark up rather than write.
SYMBOLS = b"#*$%&|<>"
#: The second vocabulary (ranks of byte strings), and how texts are cut for it: the public pattern it was made with, a fixed value.
SECOND_MODEL = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SECOND_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that the second vocabulary takes at a time.
SECOND_CHARS = 100_000
#: A worker forgets its words when it holds so many.
MEMO_WORDS = 120_000


@dataclass(frozen=True)
class Band:
    """What a text of one script may measure.

    min_chars, max_chars: characters per token; max_bytes: share of byte pieces; min_entropy: entropy of the tokens
    over that of as many different ones, up to 256 (both in bits); max_symbols: share of characters in SYMBOLS.
    """

    min_chars: float
    max_chars: float
    max_bytes: float
    min_entropy: float
    max_symbols: float = 0.05


#: Alphabetic scripts that the vocabulary covers, other alphabets, scripts written without spaces, and no letters at all.
BANDS = {
    "LATIN": Band(1.25, 8.0, 0.25, 0.40),
    "CYRILLIC": Band(1.10, 8.0, 0.30, 0.40),
    "GREEK": Band(0.80, 6.0, 0.50, 0.40),
    "CJK": Band(0.30, 3.0, 0.90, 0.40),
    "HEBREW": Band(0.60, 6.0, 0.85, 0.40),
    "ARABIC": Band(0.60, 6.0, 0.85, 0.40),
    "DEVANAGARI": Band(0.40, 6.0, 0.90, 0.40),
    "THAI": Band(0.30, 6.0, 0.90, 0.40),
    "OTHER": Band(0.25, 6.0, 0.98, 0.30),
    "NONE": Band(0.70, 6.0, 0.60, 0.40, 0.30),
}
SCRIPTS = list(BANDS)


_NO_SCRIPT = SCRIPTS.index("NONE")


def script_of(word: str) -> int:
    """Index in SCRIPTS of a word's first letter."""
    if word.isascii():
        return SCRIPTS.index("LATIN") if word.lower() != word.upper() else _NO_SCRIPT
    for c in word:
        if c.isalpha():
            name = unicodedata.name(c, "").split(" ")[0]
            if name in BANDS:
                return SCRIPTS.index(name)
            return SCRIPTS.index("CJK" if name in ("HIRAGANA", "KATAKANA", "HANGUL") else "OTHER")
    return _NO_SCRIPT


class ByteVocabulary:
    """A byte-level vocabulary; a token that is no whole characters counts as bytes."""

    def __init__(self, ranks: bytes):
        import tiktoken

        pieces = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encode = tiktoken.Encoding("bytes", pat_str=SECOND_PATTERN, mergeable_ranks=pieces, special_tokens={}).encode_ordinary
        self.broken = np.zeros(max(pieces.values(), default=0) + 1, bool)
        self.broken[[i for p, i in pieces.items() if not p.isascii() and "\ufffd" in p.decode("utf-8", "replace")]] = True

    def measure(self, words: list[bytes]) -> tuple[float, float]:
        """Characters per token and the share of byte tokens, over the words of a text with single spaces between them."""
        shown = b" ".join(words).decode("utf-8", "replace")
        ids = [i for k in range(0, len(shown), SECOND_CHARS) for i in self.encode(shown[k : k + SECOND_CHARS])]
        return (len(shown) - len(words) + 1) / len(ids), float(self.broken[ids].mean())


class WordTable:
    """Words met so far, by number: characters, symbols, script and pieces."""

    def __init__(self, proto: bytes, second: bytes | None = None):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = self.sp.get_piece_size()
        self.is_byte = np.fromiter((self.sp.is_byte(i) or self.sp.is_unknown(i) for i in range(n)), bool, n)
        self.second = ByteVocabulary(second) if second else None
        self.forget()

    def forget(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.facts = np.zeros((0, 4), np.int64)  # characters, symbols, script, number of pieces
        self.starts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def learn(self, texts: list[list[bytes]]) -> None:
        """Take in the words of some texts."""
        if len(self.ids) > MEMO_WORDS:
            self.forget()
        new = list(set(chain.from_iterable(texts)).difference(self.ids))
        if not new:
            return
        shown = [w.decode("utf-8", "replace") for w in new]
        pieces = self.sp.encode(shown, num_threads=1)
        counts = np.fromiter(map(len, pieces), np.int64, len(new))
        facts = np.empty((len(new), 4), np.int64)
        facts[:, 0] = np.fromiter(map(len, shown), np.int64, len(new))
        facts[:, 1] = [len(w) - len(w.translate(None, SYMBOLS)) for w in new]
        facts[:, 2] = np.fromiter(map(script_of, shown), np.int64, len(new))
        facts[:, 3] = counts
        self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(pieces), np.int32, int(counts.sum()))])
        self.facts = np.concatenate([self.facts, facts])

    def measure(self, text: bytes | None, words: list[bytes]) -> Measures:
        """What one text measures; its words are known."""
        n = len(words)
        duplicates = duplicate_lines(text)
        if not n:
            return Measures(0, 0, 0, duplicates, 0, "NONE")
        at = np.fromiter(map(self.ids.__getitem__, words), np.int64, n)
        facts = self.facts[at]
        chars, symbols, _, tokens = facts.sum(0).tolist()
        counts = facts[:, 3]
        first = np.repeat(self.starts[at] - np.cumsum(counts) + counts, counts)
        ids = self.flat[first + np.arange(tokens)]
        times = np.bincount(ids)
        share = times[times > 0] / max(1, tokens)
        entropy = float(-(share * np.log2(share)).sum()) + 0.0
        by_script = np.bincount(facts[:, 2], weights=facts[:, 0], minlength=len(SCRIPTS))
        by_script[_NO_SCRIPT] = 0
        script = SCRIPTS[int(np.argmax(by_script))] if by_script.any() else "NONE"
        most = np.log2(min(max(tokens, 2), 256))
        bytes_ = float(self.is_byte[ids].mean()) if tokens else 0.0
        return Measures(n, chars, symbols, duplicates, repeated_words(at), script, chars / max(1, tokens), bytes_, entropy / most)


class Measures(NamedTuple):
    """Base counts, main script, and by vocabulary the characters per token and the share of byte tokens; entropy by the first."""

    n: int
    chars: int
    symbols: int
    dup_lines: int
    repeated: int
    script: str
    per_token: float | None = None
    byte_share: float | None = None
    entropy: float | None = None
    per_token_second: float | None = None
    byte_share_second: float | None = None

    def base_failed(self, least_words: int = 50) -> bool:
        return self.n < max(1, least_words) or 100 * self.repeated > 50 * self.n

    def known(self, band: Band) -> bool:
        """Whether one of the vocabularies that were asked knows the text."""
        asked = ((self.per_token, self.byte_share), (self.per_token_second, self.byte_share_second))
        return any(t is not None and band.min_chars <= t <= band.max_chars and b <= band.max_bytes for t, b in asked)

    def kept(self, band: Band, least_words: int = 50) -> bool:
        return not self.base_failed(least_words) and self.known(band) and self.entropy >= band.min_entropy and self.symbols <= band.max_symbols * self.chars


def duplicate_lines(text: bytes | None) -> int:
    r"""Lines (split at \n) with a word that equal an earlier line."""
    if not text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def repeated_words(ids: np.ndarray, width: int = 3) -> int:
    """Words that lie in a window of so many words found twice or more in the text, the first time included."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    base = int(ids.max()) + 1
    if base**width < 2**63:
        keys = np.zeros(n, np.int64)
        for k in range(width):
            keys = keys * base + ids[k : k + n]
        _, keys = np.unique(keys, return_inverse=True)
    else:
        # renumbering after each step keeps the keys exact, however many different words there are
        _, dense = np.unique(ids, return_inverse=True)
        base, keys = int(dense.max()) + 1, np.zeros(n, np.int64)
        for k in range(width):
            _, keys = np.unique(keys * base + dense[k : k + n], return_inverse=True)
    often = np.bincount(keys)[keys] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(width):
        covered[k : k + n] |= often
    return int(covered.sum())


def _table(proto: bytes, second: bytes | None) -> WordTable:
    return worker_state(("quality", proto, second), lambda: WordTable(proto, second))


def _models(model: str | bytes, second: str | bytes | None) -> tuple[bytes, bytes | None]:
    return tuple(x if x is None or isinstance(x, bytes) else read_model(x) for x in (model, second))


REPORT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "script string, chars_per_token double, byte_share double, token_entropy double, chars_per_token_second double, byte_share_second double"
)


def _measured(table: WordTable, texts: list[bytes | None], bands: dict[str, Band], least_words: int = 50) -> Iterator[tuple[Measures, Band]]:
    """Measures of each text, and its band; the second vocabulary's where the base is sound and the first does not know the text."""
    words = [words_of(t) for t in texts]
    table.learn(words)
    for text, mine in zip(texts, words, strict=True):
        m = table.measure(text, mine)
        band = bands.get(m.script, bands["OTHER"])
        if table.second and not m.base_failed(least_words) and not m.known(band):
            m = m._replace(**dict(zip(("per_token_second", "byte_share_second"), table.second.measure(mine), strict=True)))
        yield m, band


def quality_report(docs: DataFrame, model: str | bytes = DEFAULT_MODEL, bands: dict[str, Band] = BANDS, second: str | bytes | None = SECOND_MODEL) -> DataFrame:
    """One row per document: the base counts, base_failed, kept, and the measures behind the verdict.

    token_entropy is relative to the highest possible, see Band. The second vocabulary's measures are null where the
    first one's verdict stands; without a second vocabulary the first one judges alone. A null or blank text has no
    words, fails the base and has null measures; rows that repeat are judged one for one; a null doc_id stays null.
    Whole texts are read.
    """
    proto, ranks = _models(model, second)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(proto, ranks)
        for batch in slices(batches, 1):
            found = _measured(table, bytes_list(batch.column(1)), bands)
            rows = [(*m[:5], m.base_failed(), m.kept(band), *m[5:]) for m, band in found]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()] + [pa.float64()] * 5
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *arrays], [x.split()[0] for x in REPORT.split(", ")])

    return map_arrow(docs.select("doc_id", "text"), run, REPORT)


def keep_good(docs: DataFrame, model: str | bytes = DEFAULT_MODEL, bands: dict[str, Band] = BANDS, second: str | bytes | None = SECOND_MODEL, least_words: int = 50) -> DataFrame:
    """The documents that pass, with all their columns; judged row by row, so no join brings the verdict back.

    With least_words 1, short but sound texts stay.
    """
    proto, ranks = _models(model, second)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(proto, ranks)
        for batch in slices(batches, at):
            found = _measured(table, bytes_list(batch.column(at)), bands, least_words)
            yield batch.filter(pa.array([m.kept(band, least_words) for m, band in found], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
