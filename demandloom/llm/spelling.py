"""Spelling variants of corpus words by permuterm rotations.

Every word, closed by a terminator, has one rotation for each of its places. The rotation that begins behind place i
ends with the code point at i: without it, it is a prefix that skips that code point. Words that differ at i alone share
this prefix, and a word that lacks the code point has the prefix itself as a rotation. So all rotations, and all
prefixes, are dealt and sorted by their text, and each group of equal ones is scanned once:

* words with the prefix are replacements of each other; a group has at most as many of them as there are letters,
* a word whose whole rotation equals the prefix is each one's deletion, and they are its insertions. Of a stretch of
  equal code points only the first is skipped for that, so a pair is met in one group only.

A scan emits, for each of the group's words, how many others it met and the best of them; sums and minima by word follow.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.common import bytes_list, durable, map_arrow, slices

TERMINATOR = "\x00"
LEAST_LETTERS = 5
LEAST_COUNT = 3
#: A near word of at least so many times a word's count is its form.
FORM_RATIO = 2
#: Words that a task holds before it passes its counts on.
HELD_WORDS = 200_000
#: A doubling of steps each: forms at least double the count, so no chain of forms is longer than 63.
MOST_ROUNDS = 7


def word_counts(docs: DataFrame, typo_one_in: int | None = None, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(word, n) of the maximal runs `[A-Za-z\\u00C0-\\u00FF]+` of whole texts with only A-Z lower-cased.

    typo_one_in: with h = crc32(`<doc_id>:<word>`), a word whose h this divides loses its code point h mod length in
    that document (a null id counts as empty). Words shorter than least_letters are left out. Null and empty texts have
    no words; rows that repeat count again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a run of at least so many letters is matched whole, and deletions make no word longer
        letters = re.compile("[a-zÀ-ÿ]{%d,}" % least_letters)
        counts: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return made

        for batch in slices(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), bytes_list(batch.column(1)), strict=True):
                if not text:
                    continue
                start = zlib.crc32(f"{doc_id}:".encode())
                for word, k in Counter(letters.findall(text.lower().decode("utf-8", "replace"))).items():
                    if typo_one_in:
                        h = zlib.crc32(word.encode(), start)
                        if h % typo_one_in == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_letters:
                                continue
                    counts[word] = counts.get(word, 0) + k
            if len(counts) > HELD_WORDS:
                yield out()
        yield out()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return map_arrow(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best: less, near) of the words of (word, n) that have near words: one code point inserted, deleted or replaced.

    best is the near word of largest n (less: its negative), ties to the smallest in code-point order.
    """
    placed = words.select("word", "n", F.char_length("word").alias("size")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("size"))))
    head = F.expr("substring(word, 1, i)")
    member = F.struct((-F.col("n")).alias("less"), F.col("word").alias("near"))
    whole = placed.select(F.concat(F.expr("substring(word, i + 1)"), F.lit(TERMINATOR), head).alias("key"), member.alias("m"), F.lit(None).cast("boolean").alias("first"))
    first = F.expr("i = 0 OR substring(word, i + 1, 1) != substring(word, i, 1)")
    skips = placed.where("i < size").select(F.concat(F.expr("substring(word, i + 2)"), F.lit(TERMINATOR), head).alias("key"), member.alias("m"), first.alias("first"))
    skipped = F.when(F.col("first").isNotNull(), F.struct("m", "first"))
    groups = whole.unionByName(skips).groupBy("key").agg(F.sort_array(F.collect_list(skipped)).alias("skips"), F.min(F.when(F.col("first").isNull(), F.col("m"))).alias("whole"))
    groups = groups.where("size(skips) > 1 OR (size(skips) = 1 AND whole IS NOT NULL AND skips[0].first)")

    def met(s):
        """What a skipping word meets: the other skipping words and, where it is the first of a stretch, the whole one."""
        other = F.when(F.get("skips", F.lit(0))["m"] != s["m"], F.get("skips", F.lit(0))["m"]).otherwise(F.get("skips", F.lit(1))["m"])
        shorter = F.when(s["first"], F.col("whole"))
        return F.struct(s["m"]["near"].alias("word"), (F.size("skips") - 1 + shorter.isNotNull().cast("int")).alias("k"), F.least(other, shorter).alias("best"))

    longer = F.filter("skips", lambda s: s["first"])
    of_whole = F.struct(F.col("whole.near").alias("word"), F.size(longer).alias("k"), F.get(longer, F.lit(0))["m"].alias("best"))
    each = F.concat(F.transform("skips", met), F.when(F.col("whole").isNotNull(), F.array(of_whole)).otherwise(F.array()))
    found = groups.select(F.explode(each).alias("e")).where("e.k > 0").select("e.word", "e.k", "e.best")
    return found.groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of (word, n); one row per word.

    form: the near word of largest n, ties to the smallest in code-point order, if that n is FORM_RATIO times the word's;
    root: where the forms lead, the word itself without one. Words hold no TERMINATOR. No words give no rows.
    """
    words = durable(words, "spell-words")
    near = near_words(words).select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    taken = F.col("form_n") >= FORM_RATIO * F.col("n")
    judged = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("form")).alias("form"), F.when(taken, F.col("form_n")).alias("form_n"))
    judged = durable(judged, "spell-forms")
    links = judged.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(MOST_ROUNDS):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = durable(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spell-roots")
        if links.where("moved").isEmpty():
            break
    out = judged.join(links.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_report(docs: DataFrame) -> DataFrame:
    """Contract rows: words of five letters and three occurrences, one in 97 misspelt in its document."""
    return variants(word_counts(docs, typo_one_in=97).where(F.col("n") >= LEAST_COUNT))


def _crc32(data: str) -> str:
    """SQL of the crc32 of a list of bytes; its table of 256 steps is made by the polynomial's rule."""
    table = []
    for step in range(256):
        for _ in range(8):
            step = step >> 1 ^ 0xEDB88320 * (step & 1)
        table.append(step)
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c >> 8, list_extract({table}::BIGINT[], (xor(c, b) & 255) + 1))), 4294967295)"


ORACLE = f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
per_doc AS (SELECT doc_id, w, count(*) AS k FROM runs GROUP BY doc_id, w HAVING length(w) >= 5),
hashed AS MATERIALIZED (SELECT w, k, {_crc32("flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END))")} AS h FROM per_doc),
spelt AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cuts AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS MATERIALIZED (SELECT x.word, y.word AS near, y.n FROM cuts x JOIN cuts y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word != y.word
  UNION SELECT x.word, y.word, y.n FROM cuts x JOIN words y ON x.a || x.b = y.word UNION SELECT y.word, x.word, x.n FROM cuts x JOIN words y ON x.a || x.b = y.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS n FROM pairs GROUP BY word),
named AS (SELECT b.word, any_value(b.n_near) AS n_near, any_value(b.n) AS near_n, min(p.near) AS near FROM best b JOIN pairs p ON b.word = p.word AND b.n = p.n GROUP BY b.word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(m.n_near, 0) AS n_near, CASE WHEN m.near_n >= 2 * w.n THEN m.near END AS form, CASE WHEN m.near_n >= 2 * w.n THEN m.near_n END AS form_n FROM words w LEFT JOIN named m ON w.word = m.word),
walk AS (SELECT word, word AS root, 0 AS steps FROM forms UNION ALL SELECT k.word, f.form, k.steps + 1 FROM walk k JOIN forms f ON k.root = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT word, max_by(root, steps) AS root FROM walk GROUP BY word)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r ON f.word = r.word
"""
