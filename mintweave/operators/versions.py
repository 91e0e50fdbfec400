"""Stored tables as numbered versions: a write is seen whole or not at all, whatever happens to its writer.

A table is a folder.  Rows lie in ``data/<run>/bucket=<k>`` and never change once written.  ``versions/<n>.json`` lists, for each bucket, the
folders that make it up, and is put in place by one rename that fails if another writer was first.  So a writer that dies leaves
only folders that no version names, and a reader sees the version that it has read.  A write reads and rewrites the
buckets that its rows touch and no others.  A run that is repeated under its id (a retried job) finds itself committed and
changes nothing.

The list has at most ``buckets`` entries of at most ``PIECES`` folders, so it stays small however large the table grows: a bucket appended to more
often than that is rewritten as one folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mintweave.operators.store import insert_new, upsert_by_key

BUCKETS = 256
#: Appended folders of a bucket before it is rewritten as one.
PIECES = 16
#: Latest runs that are known by their id.
RUNS = 1000


class Conflict(RuntimeError):
    """Another writer committed the version that this one was about to; run again on top of it."""


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _latest(spark: SparkSession, path: str) -> int:
    files, place = _files(spark, f"{path}/versions")
    if not files.exists(place):
        return 0
    names = [s.getPath().getName() for s in files.listStatus(place)]
    return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit()), default=0)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """What a version is made of; version 0 is the empty table."""
    n = _latest(spark, path) if version is None else version
    if n == 0:
        return {"version": 0, "runs": [], "buckets": {}, "schema": None}
    files, place = _files(spark, f"{path}/versions/{n}.json")
    stream = files.open(place)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, content: dict) -> None:
    jvm = spark._jvm
    files, temporary = _files(spark, f"{path}/versions/.{uuid.uuid4().hex}.tmp")
    stream = files.create(temporary, False)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(files.makeQualified(temporary), files.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{content['version']}.json")), plain)
    except Exception as why:
        files.delete(temporary, False)
        raise Conflict(f"version {content['version']} of {path} exists") from why


def _rows(spark: SparkSession, path: str, held: dict, buckets: list[str] | None = None) -> DataFrame | None:
    folders = [f"{path}/{f}" for k, fs in held["buckets"].items() if buckets is None or k in buckets for f in fs]
    return spark.read.schema(held["schema"]).parquet(*folders) if folders else None


def read_version(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The rows of a version (the latest by default); a table that was never written has none, with ``schema``."""
    found = _rows(spark, path, manifest(spark, path, version))
    return spark.createDataFrame([], schema) if found is None else found


def write_version(
    spark: SparkSession, path: str, new: DataFrame, keys: list[str], run: str,
    merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, buckets: int = BUCKETS,
) -> int:
    """Store ``new`` and return the version that holds it.

    Rows are dealt to buckets by ``keys``.  ``merge(old, new)`` gives a touched bucket's rows from its old and new ones; without it rows are
    appended.  An empty ``new`` makes a version without a change.  ``run`` names this write: a repetition returns the latest version.
    """
    held = manifest(spark, path)
    if run in held["runs"]:
        return held["version"]
    place = f"data/{uuid.uuid4().hex}"
    schema = ", ".join(f"`{name}` {kind}" for name, kind in new.dtypes)
    if held["schema"] not in (None, schema):
        raise ValueError(f"{path} has columns {held['schema']}, not {schema}")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    full = [k for k, folders in held["buckets"].items() if len(folders) >= PIECES]
    rows = new
    touched: set[str] = set()
    if merge is not None or full:
        touched = {str(r[0]) for r in new.select(bucket.alias("bucket")).distinct().collect()}
        again = sorted(touched & set(held["buckets"] if merge is not None else full))
        old = _rows(spark, path, held, again)
        if old is not None and merge is not None:
            rows = merge(old, new).select(*new.columns)
        elif old is not None:
            rows = old.unionByName(new)
        touched = set(again)
    rows.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{place}")
    files, written = _files(spark, f"{path}/{place}")
    made = {s.getPath().getName().removeprefix("bucket="): f"{place}/{s.getPath().getName()}" for s in files.listStatus(written) if s.isDirectory() and s.getPath().getName().startswith("bucket=")}
    now = {k: v for k, v in held["buckets"].items() if k not in touched}
    for k, folder in made.items():
        now[k] = [*now.get(k, []), folder]
    files.mkdirs(_files(spark, f"{path}/versions")[1])
    _commit(spark, path, {"version": held["version"] + 1, "runs": [*held["runs"], run][-RUNS:], "buckets": now, "schema": schema})
    return held["version"] + 1


def upsert_version(spark: SparkSession, path: str, new: DataFrame, keys: list[str], newest: str, run: str, buckets: int = BUCKETS) -> int:
    """Store the newest row per key by ``newest``."""
    latest = upsert_by_key(new.limit(0), new, keys, newest).select(*new.columns)
    return write_version(spark, path, latest, keys, run, lambda old, rows: upsert_by_key(old, rows, keys, newest), buckets)


def insert_version(spark: SparkSession, path: str, new: DataFrame, keys: list[str], run: str, buckets: int = BUCKETS) -> int:
    """Store the rows whose key is not stored yet; stored rows stay as they are."""
    fresh = new.dropDuplicates(keys)
    return write_version(spark, path, fresh, keys, run, lambda old, rows: old.unionByName(insert_new(old, rows, keys)), buckets)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove versions before the last ``keep`` and the folders that no kept version names; returns how many folders went.

    Not to be run while a write is under way: its folders have no version yet.
    """
    last = _latest(spark, path)
    kept = range(max(1, last - keep + 1), last + 1)
    used = {folder for n in kept for folders in manifest(spark, path, n)["buckets"].values() for folder in folders}
    gone = 0
    files, data = _files(spark, f"{path}/data")
    for run in files.listStatus(data) if files.exists(data) else []:
        for one in files.listStatus(run.getPath()):
            name = f"data/{run.getPath().getName()}/{one.getPath().getName()}"
            if one.isDirectory() and name not in used:
                gone += files.delete(one.getPath(), True)
    files, versions = _files(spark, f"{path}/versions")
    for one in files.listStatus(versions) if files.exists(versions) else []:
        n = one.getPath().getName().removesuffix(".json")
        if n.isdigit() and int(n) not in kept:
            files.delete(one.getPath(), False)
    return gone
