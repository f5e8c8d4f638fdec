"""Exact top-k by inner product over norm buckets.

Vectors are grouped by length: a level holds lengths within a few percent of each other, and a full level is cut into
buckets by a hash of the id. A query starts with a threshold: its k-th best score among a bounded number of the
longest vectors. For a bucket the threshold divided by the query's and the bucket's lengths is the cosine that a
member must have. Above 1, the bucket is skipped. A high cosine selects members by coordinate: along the query's
strongest coordinates a member's direction must lie in a narrow interval. Otherwise members are selected by length.
What is left is verified by exact integer products. A task walks its buckets from long to short, and the thresholds
of its queries rise with the best scores of each bucket.

Queries of similar needs make a block. Blocks and buckets meet as tiles: so many buckets in a row, from long to short,
are a shelf, so many blocks a stack, and a task has one shelf and one stack. A block is sent once per shelf that it needs
and a bucket once per stack that needs it, so what is shuffled is blocks x shelves + buckets x stacks and not blocks x
buckets, and no bucket or level, however wanted, ends in one task. What the driver holds is one row per level, and the
number of levels is bounded by the range of floating-point numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.llm.common import durable, map_arrow

#: Levels per doubling of the length.
LEVELS = 16
#: Most vectors and bytes of a bucket, most queries of a block, bytes of a stack of blocks, which a task holds, and most
#: buckets of a shelf, which it reads one by one.
BUCKET = 4096
BUCKET_BYTES = 2 << 20
QUERY_BLOCK = 512
STACK_BYTES = 64 << 20
SHELF = 256
#: Longest vectors that give the first thresholds: at most so many, and so many bytes.
SEEDS = 8192
SEED_BYTES = 16 << 20
#: From this cosine on, members are selected by coordinate, along so many coordinates.
HIGH_COSINE = 0.7
COORDINATES = 4
LARGEST = float(np.finfo(np.float64).max)
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def whole_vectors(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """(row, vec_id, v array<double>, level) of every row: components floor(scale * x), x as double; row numbers the rows.

    Components are whole numbers of any size a double holds; one that leaves its range by the scale counts as the largest
    double of its sign. A vector that is null or empty, or has a null or non-finite component, and a null vec_id take no
    part. Rows that repeat a vec_id, with whatever vectors, all count.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    scaled = F.transform("x", lambda c: F.greatest(F.least(c * F.lit(scale), F.lit(LARGEST)), F.lit(-LARGEST)))
    whole = F.transform("x", lambda c: F.when(F.abs(c) < F.lit(float(1 << 52)), F.floor(c).cast("double")).otherwise(c))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & finite).withColumn("x", scaled)
    one = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", whole.alias("v"))
    # the level of a length, in logarithms, so that squares of very large components stay finite
    most = F.array_max(F.transform("v", lambda c: F.abs(c)))
    squares = F.aggregate("v", F.lit(0.0), lambda a, c: a + F.pow(c / F.col("most"), F.lit(2.0)))
    level = F.when(F.col("most") > 0, F.floor(F.lit(float(LEVELS)) * (F.log2("most") + F.log2(squares) / 2))).otherwise(F.lit(-1))
    return one.withColumn("most", most).select("row", "vec_id", "v", level.cast("int").alias("level"))


def _need(thresholds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The lowest level that may hold a member for each query; -1: all."""
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(thresholds > 0, thresholds / lengths, 0.0)
        level = np.floor(LEVELS * np.log2(least)) - 1
    return np.where(np.isfinite(level), level, -1).astype(np.int32)


def _lengths(m: np.ndarray) -> np.ndarray:
    most = np.abs(m).max(1, initial=0.0)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        return np.where(most > 0, most * np.sqrt(((m / most[:, None]) ** 2).sum(1)), 0.0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, shorter ones padded with zeros."""
    offsets = column.offsets.to_numpy()
    flat, lengths = column.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat[offsets[0] : offsets[-1]]
    return out


def _wide(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer products of whole-numbered rows; one outside the range of a long counts as the nearest long.

    One product in floating point as long as no partial sum can leave the exact range; else products of limbs of 20
    bits, whose sums stay exact, put together as longs or, where they could overflow, as unbounded integers.
    """
    bound = float(np.abs(q).sum(1).max(initial=0.0)) * float(np.abs(p).max(initial=0.0))
    if bound < 2**53:
        return np.rint(q @ p.T).astype(np.int64)
    fits = bound < 2**62
    total = np.zeros((len(q), len(p)), np.int64 if fits else object)
    for i, a in _limbs(q):
        for j, b in _limbs(p):
            part = np.rint(a @ b.T).astype(np.int64)
            with np.errstate(over="ignore"):
                total = total + (part << min(20 * (i + j), 63) if fits else part.astype(object) * (1 << 20 * (i + j)))
    return total if fits else np.clip(total, LOWEST, HIGHEST).astype(np.int64)


def _limbs(m: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """m = sum of limb * 2**(20 * number): whole limbs below 2**20 in absolute value, with the sign of the component."""
    i = 0
    while m.any():
        rest = np.trunc(m / (1 << 20))
        yield i, m - rest * (1 << 20)
        m, i = rest, i + 1


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to smaller ids."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
        return at[_best_first(scores[at], ids[at])][:k]
    return _best_first(scores, ids)[:k]


def _best_first(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, ~scores))  # ~s = -1 - s turns the order round without overflow


def bucket_best(q_rows: np.ndarray, q: np.ndarray, thresholds: np.ndarray, rows_of: np.ndarray, ids: np.ndarray, p: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of query, ids, scores) of each query's k best members, but its own row, that reach its threshold."""
    norms, lengths = _lengths(p), _lengths(q)
    longest = float(norms.max(initial=0.0))
    slack = 1 - 1e-9
    with np.errstate(divide="ignore", invalid="ignore"):
        needed = np.where(thresholds > 0, thresholds / lengths, -np.inf) * slack  # the length a member must have
        cosine = needed / longest
    needed = np.where(np.isnan(needed), -np.inf, needed)
    cosine = np.where(np.isnan(cosine), -np.inf, cosine)
    by_coordinate = cosine >= HIGH_COSINE
    by_length = ~by_coordinate
    if by_length.any():
        rows = np.flatnonzero(by_length)
        use = np.flatnonzero(norms >= needed[rows].min())
        if len(use):
            scores = _products(q[rows], p[use])
            for i, s in zip(rows, scores, strict=True):
                yield from _reached(i, q_rows[i], thresholds[i], s, rows_of[use], ids[use], k)
    if by_coordinate.any():
        unit = p / np.maximum(norms, 1e-300)[:, None]
        for i in np.flatnonzero(by_coordinate & (cosine <= 1 + 1e-9)):
            t = min(1.0, float(cosine[i])) * slack
            direction = q[i] / lengths[i]
            keep = norms >= needed[i]
            for c in np.argsort(-np.abs(direction))[:COORDINATES]:
                middle, reach = direction[c] * t, np.sqrt(max(0.0, (1 - t * t) * (1 - direction[c] ** 2))) + 1e-9
                # a cosine of at least t allows the cap around the query; its extent along c ends at 1 where the cap holds the axis
                low, high = middle - reach, middle + reach
                if direction[c] >= t:
                    high = 1.0 + 1e-9
                if -direction[c] >= t:
                    low = -1.0 - 1e-9
                keep &= (unit[:, c] >= low) & (unit[:, c] <= high)
            use = np.flatnonzero(keep)
            if len(use):
                yield from _reached(i, q_rows[i], thresholds[i], _products(q[i : i + 1], p[use])[0], rows_of[use], ids[use], k)


def _reached(i: int, own: int, threshold: float, scores: np.ndarray, rows_of: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    at = np.flatnonzero((scores >= threshold) & (rows_of != own))
    if len(at):
        at = at[_best(scores[at], ids[at], k)]
        yield i, ids[at], scores[at]


PAYLOAD = "rows_of binary, ids binary, matrix binary, dim int, thresholds binary"
ROUTED = f"shelf int, stack int, bucket int, need int, {PAYLOAD}"


def _packed(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(key, rows, ids, matrix, thresholds) of each run of rows with one key: so many key columns, then row, vec_id, v and perhaps threshold."""
    held: list[pa.RecordBatch] = []
    key: tuple | None = None

    def whole() -> tuple[tuple, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        part = pa.Table.from_batches(held).combine_chunks()
        thresholds = part.column(keys + 3).to_numpy() if part.num_columns > keys + 3 else None
        rows_of, ids = (part.column(keys + i).to_numpy().astype(np.int64) for i in (0, 1))
        return key, rows_of, ids, _matrix(part.column(keys + 2).chunk(0)), thresholds

    for batch in batches:
        of = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], 1) if batch.num_rows else np.zeros((0, keys))
        cuts = [0, *(np.flatnonzero((of[1:] != of[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            mine = tuple(int(x) for x in of[a])
            if held and mine != key:
                yield whole()
                held.clear()
            key = mine
            held.append(batch.slice(a, b - a))
    if held:
        yield whole()


def _row(shelf: int, stack: int, bucket: int, need: int, rows_of: np.ndarray, ids: np.ndarray, m: np.ndarray, thresholds: np.ndarray | None) -> pa.RecordBatch:
    payload = (rows_of.tobytes(), ids.tobytes(), np.ascontiguousarray(m).tobytes(), m.shape[1], None if thresholds is None else thresholds.tobytes())
    kinds = (*[pa.int32()] * 4, pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
    names = [c.split()[0] for c in ROUTED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((shelf, stack, bucket, need, *payload), kinds, strict=True)], names)


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return np.frombuffer(row["rows_of"], np.int64), ids, np.frombuffer(row["matrix"]).reshape(len(ids), row["dim"])


def _counts(rows: DataFrame, level: str) -> dict[int, tuple[int, int]]:
    """By level, of which there are some thousands at most: number of rows and most components."""
    found = rows.groupBy(level).agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).collect()
    return {r[level]: (r["n"], r["dim"]) for r in found}


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k highest integer inner products over all other rows.

    Rows that repeat a vec_id are candidates, and queries, of their own. Ties go to the smaller vec_id; a query with fewer others gets them all; shorter vectors count as padded with
    zeros. A product outside the range of a long counts as the nearest long. An empty table, or one without queries,
    gives no rows.
    """
    spark = vectors.sparkSession
    whole = durable(whole_vectors(vectors, scale), "mips-whole")
    sizes = _counts(whole, "level")
    dim = max((d for _, d in sizes.values()), default=1)
    capacity = max(64, min(BUCKET, BUCKET_BYTES // (8 * dim)))
    parts = {level: -(-n // capacity) for level, (n, _) in sizes.items()}

    seeds = whole.orderBy(F.desc("level"), "row").limit(max(k + 1, min(SEEDS, SEED_BYTES // (8 * dim)))).select("row", "v").toArrow()
    seed_ids = seeds.column("row").to_numpy().astype(np.int64)
    seed = _matrix(seeds.column("v").combine_chunks()) if len(seed_ids) else np.zeros((0, 1))
    sent = spark.sparkContext.broadcast((seed_ids, seed))

    def first_thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = sent.value
        for big in batches:
            for at in range(0, big.num_rows, QUERY_BLOCK):
                batch = big.slice(at, QUERY_BLOCK)
                q_rows, q = batch.column(0).to_numpy(), _matrix(batch.column(2))
                width = max(q.shape[1], m.shape[1])
                scores = _products(_wide(q, width), _wide(m, width))
                found = np.full(len(q), -np.inf)
                for i, s in enumerate(scores):
                    s = s[ids != q_rows[i]]
                    if len(s) >= k:
                        found[i] = np.partition(s, len(s) - k)[len(s) - k]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array(_need(found, _lengths(q)))], ["row", "vec_id", "v", "threshold", "need"])

    asked = map_arrow(whole.where(is_query).select("row", "vec_id", "v"), first_thresholds, "row long, vec_id long, v array<double>, threshold double, need int")
    asked = durable(asked, "mips-queries")
    needs = {need: -(-n // QUERY_BLOCK) for need, (n, _) in sorted(_counts(asked, "need").items())}
    first = dict(zip(needs, np.concatenate([[0], np.cumsum(list(needs.values()))]).tolist(), strict=False))
    # buckets are numbered from long to short, blocks by need: a shelf is needed by the blocks before some number
    place, total = {}, 0
    for level in sorted(parts, reverse=True):
        place[level], total = total, total + parts[level]
    stack_size = max(1, STACK_BYTES // (QUERY_BLOCK * 8 * dim))
    stacks = -(-sum(needs.values()) // stack_size)
    shelf_size = max(1, min(SHELF, total * stacks // max(1, 4 * spark.sparkContext.defaultParallelism)))
    starts_at = np.searchsorted(list(place.values()), np.arange(0, total, shelf_size), side="right") - 1
    top = np.array(list(place), np.int64)[starts_at].tolist()
    wanted = [-(-sum(n for need, n in needs.items() if need <= level) // stack_size) for level in top]

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (level, part), rows_of, ids, m, _ in _packed(batches, 2):
            bucket = place[level] + part
            for stack in range(wanted[bucket // shelf_size]):
                yield _row(bucket // shelf_size, stack, bucket, level, rows_of, ids, m, None)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (need, part), rows_of, ids, m, thresholds in _packed(batches, 2):
            for shelf, level in enumerate(top):
                if level >= need:
                    yield _row(shelf, (first[need] + part) // stack_size, -1, need, rows_of, ids, m, thresholds)

    def dealt(df: DataFrame, key: str, of: dict[int, int]) -> DataFrame:
        table = spark.createDataFrame(sorted(of.items()), f"{key} int, parts int")
        part = F.pmod(F.xxhash64("row", F.lit(3)), F.col("parts")).cast("int").alias("part")
        rows = df.join(F.broadcast(table), key).select(key, part, *[c for c in df.columns if c != key])
        return rows.repartition(key, "part").sortWithinPartitions(key, "part", "row")

    routed = map_arrow(dealt(whole, "level", parts), buckets, ROUTED).union(map_arrow(dealt(asked, "need", needs).select("need", "part", "row", "vec_id", "v", "threshold"), blocks, ROUTED))
    walked = routed.repartition("shelf", "stack").sortWithinPartitions("shelf", "stack", "bucket")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks of a stack come first and stay; then its buckets pass by, and thresholds rise on the way."""
        held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        tile = None
        rows = (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows))
        for row in rows:
            if tile != (row["shelf"], row["stack"]):
                tile = (row["shelf"], row["stack"])
                held = []
            if row["bucket"] < 0:
                held.append((row["need"], *_opened(row), np.frombuffer(row["thresholds"]).copy()))
                continue
            rows_of, ids, p = _opened(row)
            for need, q_rows, q_ids, q, thresholds in held:
                if need > row["need"]:
                    continue
                width = max(q.shape[1], p.shape[1])
                got = list(bucket_best(q_rows, _wide(q, width), thresholds, rows_of, ids, _wide(p, width), k))
                if not got:
                    continue
                for i, _, scores in got:
                    if len(scores) == k:
                        thresholds[i] = max(thresholds[i], float(scores[-1]))
                sizes = [len(x) for _, x, _ in got]
                at = np.repeat([i for i, *_ in got], sizes)
                columns = (q_rows[at], q_ids[at], np.concatenate([x for _, x, _ in got]), np.concatenate([s for *_, s in got]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_row", "query_id", "vec_id", "score"])

    found = map_arrow(walked, search, "query_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_report(vectors: DataFrame) -> DataFrame:
    """Contract rows: queries are the vectors whose vec_id is divisible by 20."""
    return top_k(vectors, F.col("vec_id") % 20 == 0)


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.rid != c.rid WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
