"""Tables that are built once and read by many: versions, a manifest of what they were built from, an atomic pointer.

    <root>/artifacts/<name>-<digest of the parameters>/v-<uuid>/   the versions, Parquet
    <root>/artifacts/<name>-<digest of the parameters>/current     one line of JSON: version, schema, inputs

A writer writes a new version, then renames a new pointer over the old one; a reader reads the pointer once and keeps the
version that it names, whatever is published meanwhile. Inputs are known by path, length and time of change of their files;
where these differ from the manifest the table is built anew.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from demandloom.sources.store import work_root

#: Versions kept when a new one is published: readers of the one before may still be at work.
KEPT = 2


def _files(spark: SparkSession):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path, lambda p: p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the names, lengths and times of change of the files at these paths."""
    make, system = _files(spark)
    seen = []
    for p in sorted(paths):
        target = make(p)
        for s in system(target).listStatus(target):
            seen.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(seen)).encode()).hexdigest()


def folder(spark: SparkSession, name: str, parameters: dict) -> str:
    digest = hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]
    return f"{work_root(spark)}/artifacts/{name}-{digest}"


def _read_pointer(spark: SparkSession, at: str) -> dict | None:
    make, system = _files(spark)
    pointer = make(f"{at}/current")
    if not system(pointer).exists(pointer):
        return None
    return json.loads(spark.read.text(f"{at}/current", wholetext=True).first()[0])


def publish(df: DataFrame, at: str, inputs: str = "", keys: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """df as the new current version of the artifact in folder `at`; read back from there.

    keys: bucketed by these columns, one file per bucket, and sorted by them and order, so that joins, windows and sums by
    the keys exchange nothing.
    """
    spark = df.sparkSession
    make, system = _files(spark)
    version = f"{at}/v-{uuid.uuid4().hex}"
    layout = None
    if keys:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        layout = {"keys": keys, "order": (*keys, *order), "buckets": buckets}
        df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*layout["order"]).option("path", version).saveAsTable(_table_name(version))
    else:
        df.write.parquet(version)
    fresh, pointer = make(f"{at}/.current-{uuid.uuid4().hex}"), make(f"{at}/current")
    fs = system(pointer)
    out = fs.create(fresh)
    out.write(bytearray(json.dumps({"version": version, "schema": df.schema.json(), "inputs": inputs, "layout": layout}).encode()))
    out.close()
    if not fs.rename(fresh, pointer):
        # stores that do not rename over a file: the old pointer goes first, and a reader in between builds for itself
        fs.delete(pointer, False)
        fs.rename(fresh, pointer)
    old = sorted((s for s in fs.listStatus(make(at)) if s.getPath().getName().startswith("v-")), key=lambda s: -s.getModificationTime())
    for s in old[KEPT:]:
        fs.delete(s.getPath(), True)
    return _opened(spark, version, df.schema, layout)


def _table_name(version: str) -> str:
    return "artifact_" + version.rsplit("v-", 1)[1]


def _opened(spark: SparkSession, version: str, schema: T.StructType, layout: dict | None) -> DataFrame:
    if layout is None:
        return spark.read.schema(schema).parquet(version)
    name = _table_name(version)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        by, order = (", ".join(f"`{c}`" for c in layout[k]) for k in ("keys", "order"))
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({order}) INTO {layout['buckets']} BUCKETS LOCATION '{version}'")
    return spark.table(name)


def current(spark: SparkSession, at: str, inputs: str | None = None) -> DataFrame | None:
    """The version that is current now, pinned; None if there is none, or if it was built from other inputs."""
    found = _read_pointer(spark, at)
    if found is None or (inputs is not None and found["inputs"] != inputs):
        return None
    return _opened(spark, found["version"], T.StructType.fromJson(json.loads(found["schema"])), found["layout"])


def stored(
    spark: SparkSession, name: str, paths: list[str], parameters: dict, build: Callable[[], DataFrame], keys: tuple[str, ...] = (), order: tuple[str, ...] = ()
) -> DataFrame:
    """The current version of `name` with these parameters if it was built from these very inputs, else a new one."""
    at, inputs = folder(spark, name, {**parameters, "paths": sorted(paths)}), fingerprint(spark, paths)
    found = current(spark, at, inputs)
    return publish(build(), at, inputs, keys, order) if found is None else found
