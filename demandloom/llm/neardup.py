"""Near-duplicate documents by a signature-coordinate inverted join.

1. One pass over the texts gives each document its number of shingles, a digest of its shingle set and a MinHash
   signature. Documents with equal digests are one class from here on: copies meet in a sum and are never paired.
2. Classes are posted under each (coordinate, value) of their signature and the postings are counted. A pair that
   reaches the shingle threshold agrees on at least `agree` of the coordinates, but for a chance under MISS. So it
   meets under one of the `coordinates - agree + 1` rarest values of either side (prefix): only these are posted, and
   the long lists of common values are skipped.
3. Under one value, signatures are compared in blocks; pairs that agree on `agree` coordinates count as candidates.
   A block passes on a spanning forest of them, not the pairs, and the components of these are candidate clusters.
4. Clusters are verified on full shingle sets: intersections of two blocks are one sparse product, and each passes on
   a spanning forest of its confirmed links. A cluster that is one block is verified at once. In a larger one each
   member first meets the cluster's representative; those it confirms are one component already. Only the rest is
   then held against all, block by block. Components of the links, with the copies put back, are the result.

Lists and clusters of any size are cut into blocks by a hash of the member, clusters also by the size of the members,
so no task key holds more than two blocks. Values and clusters with very many members are joined without a shuffle.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm.common import bytes_list, durable, lowered, map_arrow, slices, spread_join
from demandloom.llm.components import components

COORDINATES = 40
#: A pair at the threshold is missed with at most this probability.
MISS = 1e-8
POST_BLOCK = 256
#: Members of a block of a cluster, and their shingles: fewer members where these are large.
SET_BLOCK = 192
SET_SHINGLES = 1_000_000
#: Cluster members and removed documents up to this many are broadcast (some 40 bytes each) instead of shuffling texts.
BROADCAST_IDS = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xD6E8FEB86659FD93)


def least_agreement(similarity: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest count of agreeing coordinates that a pair of this similarity falls short of with probability under miss."""
    below = 0.0
    for k in range(coordinates + 1):
        below += math.comb(coordinates, k) * similarity**k * (1 - similarity) ** (coordinates - k)
        if below >= miss:
            return max(1, k)
    return coordinates


class Shingler:
    """Shingle sets of texts as sorted different 64-bit hashes; remembers word hashes."""

    def __init__(self, width: int):
        self.width = width
        self.memo: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        import xxhash

        got = xxhash.xxh3_64_intdigest(word)
        if len(self.memo) < 150_000 and len(word) < 64:
            self.memo[word] = got
        return got

    def sets(self, text: bytes | None) -> np.ndarray:
        """Empty for a text without words; one element for a text with fewer words than the width."""
        words = lowered(text).split()
        if not words:
            return np.zeros(0, np.uint64)
        memo, word = self.memo, self._word
        hashes = np.fromiter((memo.get(w) or word(w) for w in words), np.uint64, len(words))
        width = min(self.width, len(words))
        n = len(words) - width + 1
        value = np.full(n, width, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                value = (value + hashes[k : k + n]) * _MIX
                value ^= value >> np.uint64(31)
        return np.unique(value)


def signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The smallest of each of so many hash functions over a non-empty set, as uint32."""
    salts = np.arange(1, coordinates + 1, dtype=np.uint64)
    out = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        salts = (salts * _MIX2) ^ (salts * _MIX >> np.uint64(17))
        for at in range(0, len(shingles), 4096):
            v = (shingles[at : at + 4096, None] ^ salts[None, :]) * _MIX2
            v ^= v >> np.uint64(32)
            v *= _MIX
            out = np.minimum(out, v.min(0))
    return (out >> np.uint64(32)).astype(np.uint32)


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler(width)
        for batch in slices(batches, 1):
            n, digests, sigs = [], [], []
            for text in bytes_list(batch.column(1)):
                s = shingler.sets(text)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).view(np.int32) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))], ["doc_id", "n_shingles", "digest", "sig"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_shingles long, digest binary, sig array<int>")


def _runs(df: DataFrame, key: str, fn: Callable[[list[tuple]], Iterator[tuple[int, int]]]) -> DataFrame:
    """Edges (a, b) from fn over the rows of each key (the first column), which a shuffle and a sort bring together.

    A task passes on an edge only if its ends are not connected by those before it: the same members meet under many
    keys, and what leaves a task is a forest over all of its keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := above.get(x, x)) != x:
                above[x] = above.get(up, up)
                x = up
            return x

        a: list[int] = []
        b: list[int] = []
        for _, group in itertools.groupby(rows, itemgetter(0)):
            for x, y in fn(list(group)):
                p, q = root(x), root(y)
                if p == q:
                    continue
                above[max(p, q)] = min(p, q)
                a.append(x)
                b.append(y)
            if len(a) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return map_arrow(df.repartition(key).sortWithinPartitions(key), run, "a long, b long")


def _blocks(df: DataFrame, of: str, own: Column, others: Column) -> DataFrame:
    """df with a row per pair of blocks that its row takes part in: task (the pair's key) and side (0 or 1; 2: one block).

    of: the key whose members are cut into blocks; own: the row's block; others: how many blocks, from 0, it meets.
    """
    spread = df.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    side = F.when(F.col("other") == F.col("own"), F.lit(2)).otherwise((F.col("own") > F.col("other")).cast("int"))
    task = F.concat_ws(":", of, F.least("own", "other"), F.greatest("own", "other"))
    return spread.withColumn("task", task).withColumn("side", side).drop("own", "other")


def _dealt(member: str, parts: Column) -> Column:
    """The block, of so many, that a member is in."""
    return F.pmod(F.xxhash64(member, F.lit(11)), parts).cast("int")


def _cut(members: Column, size: Column) -> Column:
    """How many blocks so many members, and so many shingles of theirs, make."""
    return F.greatest(F.ceil(members / F.lit(float(SET_BLOCK))), F.ceil(size / F.lit(float(SET_SHINGLES)))).cast("int")


def _forest(ids: list[int], linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of each member to the smallest id of its component, from a matrix of links between two lists of places."""
    order = np.argsort(np.array(ids, np.int64), kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    label = rank.copy()
    if not linked.any():
        return
    big = len(ids)
    while True:
        before = label.copy()
        from_right = np.where(linked, label[right][None, :], big).min(1)
        label[left] = np.minimum(label[left], from_right)
        from_left = np.where(linked, label[left][:, None], big).min(0)
        label[right] = np.minimum(label[right], from_left)
        label = np.minimum(label, label[order[label]])
        if (label == before).all():
            break
    for i, own in enumerate(label):
        if own != rank[i]:
            yield ids[i], ids[order[own]]


def _sides(rows: list[tuple], side: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two sides; a block against itself is both."""
    sides = np.fromiter((r[side] for r in rows), np.int64, len(rows))
    if (sides == 2).all():
        every = np.arange(len(rows))
        return every, every
    return np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)


def _candidates(posts: DataFrame, agree: int) -> DataFrame:
    """posts: item, class_id, low (the signature's lower 16 bits by coordinate)."""
    sizes = durable(posts.groupBy("item").agg(F.count("*").alias("n")).where("n > 1"), "near-lists")
    parts = F.ceil(F.col("n") / F.lit(float(POST_BLOCK))).cast("int")
    tasks = _blocks(spread_join(posts, sizes, ["item"], "n"), "item", _dealt("class_id", parts), parts).select("task", "side", "class_id", "low")

    def compare(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        left, right = _sides(rows, 1)
        if len(rows) < 2 or not len(left) or not len(right):
            return
        low = np.frombuffer(b"".join(r[3] for r in rows), np.uint16).reshape(len(rows), -1).T
        same = np.zeros((len(left), len(right)), np.uint8)
        for coordinate in low:
            same += coordinate[left][:, None] == coordinate[right][None, :]
        yield from _forest([r[2] for r in rows], same >= agree, left, right)

    return _runs(tasks, "task", compare)


def _confirmed(docs: DataFrame, clusters: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between the members of each cluster (node, component) that hold on their full shingle sets, as a forest.

    A cluster's representative is its smallest member, whose id names it.
    """
    sized = clusters.select(F.col("node").alias("class_id"), F.col("component").alias("cluster")).join(classes.select("class_id", "n_shingles").dropDuplicates(["class_id"]), "class_id")
    sized = durable(sized, "near-sized")
    sizes = sized.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    sizes = durable(sizes.withColumn("parts", _cut(F.col("n"), F.col("size"))), "near-sizes")
    members = durable(spread_join(sized, sizes, ["cluster"], "n"), "near-members")
    texts = docs.select(F.col("doc_id").cast("long").alias("class_id"), F.col("text").cast("binary").alias("text"))
    shinglers: dict[int, Shingler] = {}

    def verify(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        left, right = _sides(rows, 1)
        if len(rows) < 2 or not len(left) or not len(right):
            return
        shingler = shinglers.setdefault(width, Shingler(width))
        sets = [shingler.sets(r[3]) for r in rows]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        shared = intersections(sets, left, right)
        union = sizes[left][:, None] + sizes[right][None, :] - shared
        yield from _forest([r[2] for r in rows], (100 * shared >= percent * union) & (shared > 0), left, right)

    def links(tasks: DataFrame) -> DataFrame:
        """tasks: (class_id, task, side); the texts come last, so that they are shipped to their tasks and nowhere else."""
        met = texts.join(F.broadcast(tasks) if tasks.count() <= BROADCAST_IDS else tasks, "class_id")
        return _runs(met.select("task", "side", "class_id", "text"), "task", verify)

    # a cluster of one block against itself; in others the representative (side 0) meets every block
    is_first = F.col("class_id") == F.col("cluster")
    own = F.when(F.col("parts") == 1, F.array(F.lit(0))).when(is_first, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(_dealt("class_id", F.col("parts"))))
    side = F.when(F.col("parts") == 1, F.lit(2)).when(is_first, F.lit(0)).otherwise(F.lit(1))
    first = members.select("class_id", "cluster", side.alias("side"), F.explode(own).alias("own"))
    found = durable(links(durable(first.select("class_id", F.concat_ws(":", "cluster", "own").alias("task"), "side"), "near-tasks")), "near-links")

    large = members.where("parts > 1 AND class_id != cluster").select("class_id", "cluster", "n_shingles")
    confirmed = found.select(F.col("a").alias("class_id"), F.lit(True).alias("confirmed")).distinct()
    large = durable(large.join(confirmed, "class_id", "left").withColumn("rest", F.col("confirmed").isNull()), "near-large")
    if large.where("rest").isEmpty():
        return found
    rest, other = F.col("rest"), ~F.col("rest")
    parts = large.groupBy("cluster").agg(
        F.count("*").alias("n"),
        _cut(F.count_if(rest), F.sum(F.when(rest, F.col("n_shingles")).otherwise(0))).alias("parts_rest"),
        _cut(F.count_if(other), F.sum(F.when(other, F.col("n_shingles")).otherwise(0))).alias("parts_other"),
    )
    parts = durable(parts.where("parts_rest > 0 AND n > 1"), "near-parts")
    # blocks of the rest come first and meet all blocks; the others meet those of the rest only
    block = F.when(rest, _dealt("class_id", F.col("parts_rest"))).otherwise(F.col("parts_rest") + _dealt("class_id", F.greatest(F.col("parts_other"), F.lit(1))))
    meets = F.when(rest, F.col("parts_rest") + F.col("parts_other")).otherwise(F.col("parts_rest"))
    second = _blocks(spread_join(large, parts, ["cluster"], "n"), "cluster", block, meets).select("class_id", "task", "side")
    return found.union(durable(links(durable(second, "near-tasks")), "near-links"))


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sorted different hashes, left by right; exact."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keys, column = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(column, minlength=len(keys)) > 1
    number = np.cumsum(often) - 1
    use = often[column]
    owner, column = owner[use], number[column[use]]
    out = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    for at in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, (at, at + width))
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        out += m[left] @ m[right].T
    return np.rint(out).astype(np.int64)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable), kept.

    Sets hold different shingles of `width` words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased); a text with fewer words
    has its whole sequence as one; a null or blank text has an empty set and is linked with nothing. Documents are
    linked if 100 * intersection >= percent * union. Rows with one doc_id count as one document. A document with a
    null doc_id is linked with nothing and not kept; its component_id is null.
    """
    agree = least_agreement(percent / 100)
    signed = durable(_signatures(docs, width), "near-signed")
    classes = durable(signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")), "near-classes")
    items = classes.select("digest", F.posexplode("sig").alias("coordinate", "value"))
    often = durable(items.groupBy("coordinate", "value").agg(F.count("*").alias("df")).where("df > 1"), "near-items")
    shared = spread_join(items, often, ["coordinate", "value"], "df")
    rest = F.lit(COORDINATES - agree + 1) - (F.lit(COORDINATES) - F.size("found"))
    prefix = shared.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("df", "coordinate", "value"))).alias("found")).where(rest > 0).select("digest", F.slice("found", F.lit(1), F.least(rest, F.size("found"))).alias("found"))
    low = F.unhex(F.concat_ws("", F.transform("sig", lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFF))), 4, "0"))))
    posts = durable(prefix.join(classes.select("digest", "class_id", low.alias("low")), "digest").select("class_id", "low", F.explode("found").alias("f")).select(F.concat_ws(".", "f.coordinate", "f.value").alias("item"), "class_id", "low"), "near-posts")
    clusters = components(_candidates(posts, agree))
    found = components(_confirmed(docs, durable(clusters, "near-clusters"), classes, width, percent))
    of_class = classes.join(found.withColumnRenamed("node", "class_id"), "class_id", "left").select("digest", F.coalesce("component", "class_id").alias("component"))
    of_class = durable(of_class, "near-result")
    out = signed.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group: the one with the smallest doc_id, with all its columns.

    Of rows that share a doc_id one stays. Documents with a null doc_id stay: nothing links them.
    """
    judged = durable(near_duplicates(docs, width, percent).where("doc_id IS NOT NULL").select("doc_id", "kept"), "near-kept")
    removed = judged.where("NOT kept").select("doc_id").distinct()
    bounded = removed.count() <= BROADCAST_IDS
    left = docs.join(F.broadcast(removed) if bounded else removed, "doc_id", "left_anti").select(*docs.columns)
    again = judged.where("kept").groupBy("doc_id").count().where("count > 1")
    if again.isEmpty():
        return left
    repeated = left.join(again.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return left.join(again.select("doc_id"), "doc_id", "left_anti").select(*docs.columns).union(repeated)


def near_report(docs: DataFrame) -> DataFrame:
    """Contract rows: three words, 85 percent."""
    return near_duplicates(docs, 3, 85)


ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
flat AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM sets),
pairs AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS MATERIALIZED (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
reach AS (SELECT x AS doc_id, x AS other FROM links UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x),
least_one AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(l.component_id, s.doc_id) AS kept FROM sets s LEFT JOIN least_one l ON s.doc_id = l.doc_id
"""
