"""Exact Jaccard join of documents on word n-grams, by size-banded tiles of hashed bitmap signatures.

1. Sets that are linked are of like size, so each document stands in the band of its size (a factor of two) and, if the
   band below reaches up to it, there too. Equal sets are one class from here on.
2. A set has a bitmap as wide as its band asks for: one bit per hash value, switched by each n-gram that has it. Sets that
   differ in d n-grams differ in at most d bits, so the bits that differ bound the overlap from above. A bitmap folds onto
   half its width for the band below.
3. A tile is what one band has under one n-gram. Linked sets share one of the first `n - least overlap + 1` n-grams of each
   side in any common order, so only these lead to tiles; n-grams of very many documents come last in the order. Tiles of
   the same members are one. Large tiles are cut into blocks that meet two by two.
4. In a tile the sizes and then the bits are compared, all at once. Pairs whose bound reaches the threshold pass as a
   spanning forest; the clusters that it makes are confirmed on the sorted arrays of full sets, blocks of a cluster two by
   two, and the components of confirmed links are the result.

Nothing is dropped on the way: order, bands, tiles and bitmaps only decide which pairs need an exact intersection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm import neardup
from demandloom.llm.common import bytes_list, durable, map_arrow, slices, spread_join
from demandloom.llm.components import components
from demandloom.llm.neardup import Shingler

#: Bits of the first band, which has sets of up to twice as many n-grams; each further band doubles both.
FIRST_BITS = 64
#: N-grams ordered last are at most so many: those in more documents than a share of one in so many of all n-grams.
MOST_COMMON = 1_000_000
#: N-grams in no more documents than this make small tiles and need no place in that order.
RARE_DOCS = 1_000
#: N-grams that a task counts before it forgets those met once per such stretch.
STRETCH = 1 << 20
#: Set bits of two sides that are compared at a time.
COMPARED_WORDS = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def band_of(n: int) -> int:
    """The band of a set of n n-grams: the smallest whose bits are at least half of n."""
    return max(0, (-(-n // 2) - 1).bit_length() - (FIRST_BITS - 1).bit_length())


def least_overlap(n: int, percent: int) -> int:
    """What a set of n n-grams shares with any that it is linked with."""
    return -(-percent * n // 100)


def bitmap(shingles: np.ndarray, band: int) -> np.ndarray:
    """The bitmap of a set in a band, as 64-bit words: bit h mod width of it is the parity of the n-grams with that hash."""
    width = FIRST_BITS << band
    at = (shingles * _MIX >> np.uint64(20)) % np.uint64(width)
    odd = np.bincount(at.astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def overlap_bound(sizes: np.ndarray, bits: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """An upper bound of the overlaps, left by right: (sum of sizes - bits that differ) / 2, and neither size."""
    width = bits.shape[1]
    out = np.empty((len(left), len(right)), np.int64)
    step = max(1, COMPARED_WORDS // max(1, width * len(right)))
    for at in range(0, len(left), step):
        some = left[at : at + step]
        apart = np.bitwise_count(bits[some][:, None, :] ^ bits[right][None, :, :]).sum(2, dtype=np.int64)
        out[at : at + step] = (sizes[some][:, None] + sizes[right][None, :] - apart) // 2
    return np.minimum(out, np.minimum(sizes[left][:, None], sizes[right][None, :]))


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of very many documents, sorted, and a class of each that grows with the number of them.

    At most MOST_COMMON. Each task counts all of its documents, stretch by stretch, and forgets after a stretch what it has
    not met more often than there were stretches; so a count falls short by the number of stretches at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        size = total = past = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, k = np.unique(np.concatenate(held), return_counts=True)
            both, at = np.unique(np.concatenate((keys, new[k > 1])), return_inverse=True)
            n = np.bincount(at, np.concatenate((counts, k[k > 1])), len(both)).astype(np.int64)
            return both[n > past + 1], n[n > past + 1]

        for batch in slices(batches, 0):
            for text in bytes_list(batch.column(0)):
                held.append(shingler.sets(text))
                size += len(held[-1])
            if size >= STRETCH:
                keys, counts = merged()
                held, total, size, past = [], total + size, 0, past + 1
        if held:
            keys, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array([None, *keys.view(np.int64).tolist()], pa.int64()), pa.array([total + size, *counts.tolist()], pa.int64())], ["h", "n"])

    counted = durable(map_arrow(docs.select("text"), count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "ngram-counts")
    limit = max(RARE_DOCS, (counted.where("h IS NULL").agg(F.sum("n")).first()[0] or 0) // MOST_COMMON)
    often = counted.where((F.col("n") > limit) & F.col("h").isNotNull()).toPandas()
    hashes = often["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.log2(often["n"].to_numpy(np.float64)[order]).astype(np.uint8)


def first_shingles(shingles: np.ndarray, common: np.ndarray, classes: np.ndarray, k: int) -> np.ndarray:
    """The first k of a sorted set: by hash, those of the common table last, by their class."""
    if not len(common):
        return shingles[:k]
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    known = common[at] == shingles
    rare = shingles[~known]
    if len(rare) >= k:
        return rare[:k]
    last = shingles[known][np.lexsort((shingles[known], classes[at[known]]))]
    return np.concatenate((rare, last))[:k]


SIGNED = "doc_id long, n_shingles long, digest binary, own boolean, band int, bits binary, tiles array<long>"


def _signed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """A row per document and band, with its tiles and its bitmap there; own: the band of its size. Empty sets have no tiles."""
    table = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler(width)
        types = (pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
        for batch in slices(batches, 1):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), bytes_list(batch.column(1)), strict=True):
                s = shingler.sets(text)
                if not len(s):
                    rows.append((doc_id, 0, None, True, 0, None, None))
                    continue
                least = least_overlap(len(s), percent)
                first = first_shingles(s, *table.value, len(s) - least + 1)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                # the smallest set that this one can be linked with may stand in a band below
                for band in range(band_of(least), band_of(len(s)) + 1):
                    keys = (first ^ np.uint64((band + 1) << 56)) * _MIX
                    rows.append((doc_id, len(s), digest, band == band_of(len(s)), band, bitmap(s, band).tobytes(), keys.view(np.int64)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "own", "band", "bits", "tiles"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SIGNED)


def _candidates(classes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect whatever pairs of classes the bitmaps of their tiles leave possible."""
    posts = classes.select("class_id", "band", F.explode("tiles").alias("tile"))
    members = F.struct(F.bit_xor(F.xxhash64("class_id")).alias("one"), F.bit_xor(F.xxhash64("class_id", F.lit(5))).alias("two"))
    tiles = posts.groupBy("tile").agg(F.count("*").alias("n"), members.alias("members")).where("n > 1")
    tiles = durable(tiles.groupBy("n", "members").agg(F.min("tile").alias("tile")).select("tile", "n"), "ngram-tiles")
    parts = F.ceil(F.col("n") / F.lit(float(neardup.POST_BLOCK))).cast("int")
    met = neardup._blocks(spread_join(posts, tiles, ["tile"], "n"), "tile", neardup._dealt("class_id", parts), parts)
    tasks = met.select("class_id", "band", "task", "side").join(classes.select("class_id", "band", "n_shingles", "bits"), ["class_id", "band"])

    def compare(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        left, right = neardup._sides(rows, 1)
        if len(rows) < 2 or not len(left) or not len(right):
            return
        sizes = np.fromiter((r[3] for r in rows), np.int64, len(rows))
        bits = np.frombuffer(b"".join(r[4] for r in rows), np.uint64).reshape(len(rows), -1)
        bound = overlap_bound(sizes, bits, left, right)
        possible = 100 * bound >= percent * (sizes[left][:, None] + sizes[right][None, :] - bound)
        yield from neardup._forest([r[2] for r in rows], possible, left, right)

    return neardup._runs(tasks.select("task", "side", "class_id", "n_shingles", "bits"), "task", compare)


def ngram_join(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    Sets hold different shingles of `width` words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased); a text with fewer words
    has its whole sequence as one; a null or blank text has an empty set and is linked with nothing. Documents are
    linked if 100 * intersection >= percent * union. Rows with one doc_id count as one document; a document with a null
    doc_id is linked with nothing and has a null component_id. Other columns of docs play no part.
    """
    signed = durable(_signed(docs, width, percent), "ngram-signed")
    known = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = durable(known.groupBy("digest", "band").agg(F.min("doc_id").alias("class_id"), *[F.first(c).alias(c) for c in ("own", "n_shingles", "bits", "tiles")]), "ngram-classes")
    clusters = durable(components(_candidates(classes, percent)), "ngram-clusters")
    own = classes.where("own").select("digest", "class_id", "n_shingles")
    found = components(neardup._confirmed(docs, clusters, own, width, percent))
    of_class = own.join(found.withColumnRenamed("node", "class_id"), "class_id", "left").select("digest", F.coalesce("component", "class_id").alias("component"))
    out = signed.where("own").select("doc_id", "n_shingles", "digest").join(durable(of_class, "ngram-result"), "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def join_report(docs: DataFrame) -> DataFrame:
    """Contract rows: three words, 90 percent."""
    return ngram_join(docs, 3, 90)


ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
flat AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM sets),
pairs AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
links AS MATERIALIZED (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
reach AS (SELECT x AS doc_id, x AS other FROM links UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x),
least_one AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id FROM sets s LEFT JOIN least_one l ON s.doc_id = l.doc_id
"""
