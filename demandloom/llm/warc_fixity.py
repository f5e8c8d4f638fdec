"""Merkle fixity audit of WARC replicas.

Every record is hashed; the records of one offset range of a file, in order, give a leaf, and so many neighbouring
nodes a node of the next level, up to one root per file. Two replicas are compared from the roots down: only children
of nodes that differ are looked at, so what is read of the trees is in proportion to the damage. In the leaves that
differ, records are told apart: changed, missing or extra.

Leaves and nodes are grouped by file and offset range, never by file alone, so a file of any size spreads out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.llm.common import durable

RANGE_BYTES = 1 << 16
FANOUT = 16
RECORDS_PER_FILE = 256
INDEX = ("file", "offset", "length", "record_id", "hash")


def sha(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def warc_records(pages: DataFrame, records_per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """(file, record_id, record): pages as response records, so many page ids to a file.

    A null url or html is empty; a page without an id has no record.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    page = F.col("page_id").cast("string")
    lines = (
        F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), page),
        F.concat(F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col("url"), F.lit(""))),
        F.concat(F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")),
    )
    file = F.floor(F.col("page_id") / records_per_file).cast("long")
    rows = pages.where("page_id IS NOT NULL")
    return rows.select(file.alias("file"), F.col("page_id").cast("long").alias("record_id"), F.concat(*lines, body, F.lit("\r\n\r\n")).alias("record"))


def placed(rows: DataFrame) -> DataFrame:
    """Rows (file, record_id, length, hash, ...) with the offset that each record has when its file holds them in id order.

    Rows that repeat an id follow each other by hash. Bodies have no part in this: what is shuffled by file are the
    lengths and hashes of its records.
    """
    before = Window.partitionBy("file").orderBy("record_id", "hash").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def index_of(records: DataFrame) -> DataFrame:
    """The index (file, offset, length, record_id, hash) of records; their hash is taken of record where there is no hash yet.

    This comes before any shuffle. A null record counts as empty.
    """
    if "hash" not in records.columns:
        records = records.withColumn("hash", sha(F.coalesce(F.col("record").cast("binary"), F.lit(b""))))
    return records.select(*INDEX)


def leaves(index: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, node, hash, records): a row per offset range that a record begins in; rows that repeat count once."""
    node = F.floor(F.col("offset") / range_bytes).cast("long").alias("node")
    records = F.sort_array(F.collect_set(F.struct("offset", "length", "record_id", "hash"))).alias("records")
    line = F.transform("records", lambda r: F.concat_ws(":", r["offset"], r["length"], r["hash"]))
    return index.groupBy("file", node).agg(records).select("file", "node", sha(F.array_join(line, ",")).alias("hash"), "records")


def parents(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The next level: (file, node, hash) over so many children each."""
    children = F.sort_array(F.collect_list(F.struct("node", "hash")))
    up = level.groupBy("file", F.floor(F.col("node") / fanout).cast("long").alias("node")).agg(children.alias("c"))
    line = F.transform("c", lambda c: F.concat_ws(":", c["node"], c["hash"]))
    return up.select("file", "node", sha(F.array_join(line, ",")).alias("hash"))


def merkle_tree(index: DataFrame, depth: int, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT, name: str = "merkle") -> list[DataFrame]:
    """Levels from leaves to roots, written out; depth levels above the leaves."""
    levels = [durable(leaves(index, range_bytes), f"{name}-0")]
    for k in range(depth):
        levels.append(durable(parents(levels[-1], fanout), f"{name}-{k + 1}"))
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes (file, node) whose hashes differ or that only one side has."""
    met = a.select("file", "node", F.col("hash").alias("ha")).join(b.select("file", "node", F.col("hash").alias("hb")), ["file", "node"], "full")
    return met.where(~F.col("ha").eqNullSafe(F.col("hb"))).select("file", "node")


def audit(primary: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """file, offset, length, record_id, status ('changed', 'missing' or 'extra' in the replica), primary_hash, replica_hash.

    Both sides have file, offset, length, record_id and hash or record; other columns are ignored. A null file is a
    file of its own; rows with a null offset are left out; repeated rows count once. Where a side has several records
    at one offset, equal ones meet first and the others by record_id and hash. Equal replicas, and two empty ones,
    give no rows. A range holds as many records as begin in its bytes, so a leaf is small as long as records have
    a length.
    """
    file_type = primary.schema["file"].dataType
    name = F.when(F.col("file").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("file").cast("string")))
    primary, replica = (index_of(x.where("offset IS NOT NULL")).withColumn("file", name) for x in (primary, replica))
    last = primary.select("offset").union(replica.select("offset")).agg(F.max("offset")).first()[0] or 0
    depth, reach = 0, last // range_bytes + 1
    while reach > 1:
        depth, reach = depth + 1, -(-reach // fanout)
    a, b = (merkle_tree(x, depth, range_bytes, fanout, n) for x, n in ((primary, "merkle-a"), (replica, "merkle-b")))
    bad = _differing(a[depth], b[depth])
    for k in range(depth - 1, -1, -1):
        bad = durable(bad, "merkle-bad").withColumnRenamed("node", "up")
        up = F.floor(F.col("node") / fanout).cast("long").alias("up")
        below = [level.select("file", "node", "hash", up).join(bad, ["file", "up"], "left_semi") for level in (a[k], b[k])]
        bad = _differing(*below)
    bad = durable(bad, "merkle-bad")
    p, q = (x[0].join(bad, ["file", "node"], "left_semi").select("file", F.explode("records").alias("r")).select("file", "r.*") for x in (a, b))
    p, q = durable(p, "merkle-p"), durable(q, "merkle-q")

    def alone(x: DataFrame, y: DataFrame, side: str) -> DataFrame:
        """Records of x that y does not have, numbered at their offset."""
        mine, other = x.alias("x"), y.alias("y")
        same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in INDEX]
        number = F.row_number().over(Window.partitionBy("file", "offset").orderBy("record_id", "hash")).alias("number")
        return mine.join(other, same, "left_anti").select("file", "offset", number, F.struct("length", "record_id", "hash").alias(side))

    met = alone(p, q, "p").join(alone(q, p, "q"), ["file", "offset", "number"], "full")
    status = F.when(F.col("q").isNull(), F.lit("missing")).when(F.col("p").isNull(), F.lit("extra")).otherwise(F.lit("changed"))
    file = F.when(F.col("file") != "null", F.expr("substring(file, 2)")).cast(file_type).alias("file")
    of = lambda c: F.when(F.col("p").isNotNull(), F.col(f"p.{c}")).otherwise(F.col(f"q.{c}")).alias(c)
    return met.select(file, "offset", of("length"), of("record_id"), status.alias("status"), F.col("p.hash").alias("primary_hash"), F.col("q.hash").alias("replica_hash"))


def audit_report(pages: DataFrame) -> DataFrame:
    """The audit of all pages as WARC records against a damaged copy; page_id instead of record_id.

    In the copy 2 records in 256, chosen by a hash of the id, have their last characters overwritten, and 1 in 256 is
    lost. Both replicas are hashed where the pages lie.
    """
    fate = F.substring(F.md5(F.col("record_id").cast("string").cast("binary")), 1, 2)
    spoilt = F.concat(F.expr("substring(record, 1, length(record) - 4)"), F.lit("\0\0\0\0"))
    copied = F.when(fate.isin("07", "d3"), sha(spoilt)).when(fate != "2a", sha(F.col("record")))
    rows = warc_records(pages).select("file", "record_id", F.octet_length("record").cast("long").alias("length"), sha(F.col("record")).alias("hash"), copied.alias("copied"))
    both = durable(placed(rows), "warc-index")
    replica = both.where("copied IS NOT NULL").select("file", "offset", "length", "record_id", F.col("copied").alias("hash"))
    return audit(both, replica).withColumnRenamed("record_id", "page_id")


ORACLE = r"""
WITH parts AS (SELECT page_id, floor(page_id / 256)::BIGINT AS file, coalesce(html, '') AS body, coalesce(url, '') AS url FROM pages WHERE page_id IS NOT NULL),
records AS (SELECT page_id, file, concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10), 'Content-Length: ', strlen(body), chr(13), chr(10), chr(13), chr(10), body, chr(13), chr(10), chr(13), chr(10)) AS record FROM parts),
placed AS (SELECT *, strlen(record) AS length, coalesce(sum(strlen(record)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, substr(md5(page_id::VARCHAR), 1, 2) AS fate FROM records)
SELECT file, pos::BIGINT AS "offset", length::BIGINT AS length, page_id, CASE WHEN fate = '2a' THEN 'missing' ELSE 'changed' END AS status, sha256(record) AS primary_hash,
  CASE WHEN fate != '2a' THEN sha256(encode(substr(record, 1, length(record) - 4)) || '\x00\x00\x00\x00'::BLOB) END AS replica_hash
FROM placed WHERE fate IN ('07', 'd3', '2a')
"""
