"""Helpers shared by the training-data operators: words, hold-outs, Arrow maps, durable intermediates."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, for trims; WORD_SEPARATOR is the same set as a Java regex.
WORD_SPACE = " \t\n\x0b\x0c\r"
WORD_SEPARATOR = "[\\x20\\x09-\\x0D]+"

#: Texts are handled in slices of about this many bytes, so that one Arrow batch of long texts stays small in Python.
SLICE_BYTES = 2 << 20

#: The JVM hands workers Arrow batches of about this many bytes, unless the session says otherwise.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

#: A key with no more rows than this is never a hot one.
HOT_ROWS = 10_000

_resident: dict[object, object] = {}


def words_of(text: bytes | None) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of a UTF-8 text: bytes.split() separates at exactly these six bytes."""
    return text.split() if text else []


def lowered(text: bytes | None) -> bytes:
    """A-Z lower-cased, nothing else: bytes.lower() touches ASCII letters only."""
    return text.lower() if text else b""


def word_count(text: Column) -> Column:
    """Number of words of a text column, JVM-side; null counts 0."""
    trimmed = F.btrim(text, F.lit(WORD_SPACE))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, WORD_SEPARATOR))).cast("long")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True for rows whose crc32(doc_id as text) mod modulus is the remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in small batches; a worker gives freed memory back when its task ends, since it lives on beside those of later stages."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text column (by position) of each holds about SLICE_BYTES."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * SLICE_BYTES / max(1, batch.column(text).nbytes)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def bytes_list(column: pa.Array) -> list[bytes | None]:
    """Python bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


#: The folder of local runs that name none, by application: nothing is set in the caller's session.
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediates that all executors see: spark.checkpoint.dir, else (local runs) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
        return spark.conf.get("spark.sql.warehouse.dir") + "/_intermediate"
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-")
    return _local_dirs[app]


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut and a lost executor loses nothing.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def worker_state(key: object, make: Callable[[], object]) -> object:
    """What later tasks in the same Python worker can use again (tables of words met, models); another key takes its place.

    Workers outlive stages, so only one such object is kept: stages of a pipeline do not pile theirs up.
    """
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def bounded_rows(df: DataFrame, limit: int) -> list | None:
    """The rows of df if there are at most limit, else None: the size check before every broadcast here."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """rows joined (inner) with table, which has one row per key; weight: the column of table that counts the key's rows.

    Keys with more than a thousandth of all rows are fewer than a thousand: their part of table is broadcast, and
    their rows stay where they are. The others are shuffled. rows is read twice if there are such keys.
    """
    found = table.agg(F.sum(weight).alias("all"), F.max(weight).alias("most")).first()
    limit = max(HOT_ROWS, (found["all"] or 0) // 1000)
    if (found["most"] or 0) <= limit:
        return rows.join(table, keys)
    hot = table.where(F.col(weight) > limit)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col(weight) <= limit), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)
