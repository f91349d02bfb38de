"""Tables in key folders: a merge rewrites the folders it touches and no others.

A row lies in the folder of its key's hash. Every merge writes the touched folders
under its own version and then one small manifest that names the version of each
folder; that manifest is the commit. Readers take the newest manifest, so they see
a merge whole or not at all, and a merge that failed half way leaves nothing they
would read. A batch that is committed already is not merged again.

The folder of a key is its place in a hash exchange by the key, modulo the folders.
Exchanges run in a multiple of that number, so what a join or a window by the key
leaves in a task lies in few folders and is written without another exchange.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import children, remove, scratch_dir

FOLDERS = 64
PACKED = {"compression": "zstd"}  # a merge writes whole folders: fewer bytes are worth the time
MANIFEST = "folder INT, version BIGINT, folders INT, key ARRAY<STRING>, hash STRING"
HASH, OLD_HASH = "murmur3", "xxhash64"  # manifests without a hash are of tables in the old one
PARTITIONS = "spark.sql.shuffle.partitions"


def folder_of(key: list[str], folders: int, by: str = HASH) -> Column:
    digest = {HASH: F.hash, OLD_HASH: F.xxhash64}[by](*key)
    return F.pmod(digest, F.lit(folders)).cast("int")


@contextmanager
def _exchanges_by_folder(spark: SparkSession, folders: int):
    """Exchanges in a multiple of ``folders``."""
    before = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, str(-(-int(before) // folders) * folders))
    try:
        yield
    finally:
        spark.conf.set(PARTITIONS, before)


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    return sorted(int(c.split("=")[1]) for c in children(spark, path) if c.startswith(f"{name}="))


def committed(spark: SparkSession, path: str) -> int:
    """The number of the newest committed batch, -1 without one."""
    done = [n for n in _numbers(spark, f"{path}/manifest", "batch") if "_SUCCESS" in children(spark, f"{path}/manifest/batch={n}")]
    return max(done, default=-1)


def _manifest(spark: SparkSession, path: str, batch: int) -> list:
    """One row per folder that holds rows: as many as the table has folders."""
    return spark.read.schema(MANIFEST).json(f"{path}/manifest/batch={batch}").collect()


def _folders(spark: SparkSession, path: str, rows: list, schema) -> DataFrame:
    data = f"{path}/data"
    paths = [f"{data}/version={r.version}/folder={r.folder}" for r in rows]
    if not paths:
        return spark.read.schema(schema).parquet(data).filter(F.lit(False)).drop("version", "folder")
    return spark.read.schema(schema).option("basePath", data).parquet(*paths).drop("version", "folder")


def _schema(spark: SparkSession, path: str):
    return spark.read.parquet(f"{path}/schema").schema


def _write(rows: DataFrame, path: str, key: list[str], folders: int, batch: int, by: str = HASH, dealt: bool = True) -> list[int]:
    """Rows under their version and folder; the folders that hold any. Rows that are not
    ``dealt`` to tasks by key are dealt by folder."""
    spark = rows.sparkSession
    at = f"{path}/data/version={batch}"
    spread = rows.withColumn("folder", folder_of(key, folders, by))
    if not dealt:
        spread = spread.hint("rebalance", "folder")
    spread.write.mode("overwrite").options(**PACKED).partitionBy("folder").parquet(at)
    return _numbers(spark, at, "folder")


def _commit(
    spark: SparkSession, path: str, versions: dict[int, int], key: list[str], folders: int, batch: int, by: str = HASH
) -> None:
    rows = [(folder, version, folders, key, by) for folder, version in sorted(versions.items())]
    rows = rows or [(-1, -1, folders, key, by)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest/batch={batch}")


def write_dealt(rows: DataFrame, path: str, key: list[str], folders: int = FOLDERS) -> None:
    """Rows in files by key, each with the rows of few folders: what is read there can be
    written into a table, or merged into one, without another exchange."""
    with _exchanges_by_folder(rows.sparkSession, folders):
        rows.repartition(*key).write.options(**PACKED).parquet(path)


def write_keyed(
    rows: DataFrame, path: str, key: list[str], folders: int = FOLDERS, batch: int = 0, dealt: bool = False
) -> None:
    """A new table. Keys are taken to be unique; a null is a key like any other. Rows that
    are ``dealt`` come out of files by key and are written where they are."""
    spark = rows.sparkSession
    if committed(spark, path) >= 0:
        raise ValueError(f"{path} is a table already; merge into it")
    rows.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
    with _exchanges_by_folder(spark, folders):
        # no exchange where the rows come out of one by the same key
        held = _write(rows if dealt else rows.repartition(*key), path, key, folders, batch)
    _commit(spark, path, dict.fromkeys(held, batch), key, folders, batch)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The table as of its newest commit."""
    batch = committed(spark, path)
    if batch < 0:
        raise ValueError(f"no table in {path}")
    rows = [r for r in _manifest(spark, path, batch) if r.folder >= 0]
    return _folders(spark, path, rows, _schema(spark, path))


def merge_keyed(
    spark: SparkSession, path: str, updates: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: int,
    by_key: bool = False, stored: bool = False,
) -> list[int]:
    """Merge ``updates`` by ``merge(target, updates)``; the folders that were rewritten.

    ``merge`` sees the target rows of the touched folders alone and must keep rows
    of other keys as they are. A ``batch`` that is not above the newest committed one
    was merged before and changes nothing. The rows of a merge ``by_key`` lie as a join
    by the key of the table, or files by it, leave them, and are written where they are;
    others are dealt to their folders first. Updates that are ``stored`` in files are read there,
    others are written first.
    """
    last = committed(spark, path)
    if last < 0:
        raise ValueError(f"no table in {path}")
    if batch <= last:
        return []
    manifest = _manifest(spark, path, last)
    folders, key, by = manifest[0].folders, list(manifest[0].key), manifest[0].hash or OLD_HASH
    schema = _schema(spark, path)
    held = None
    if not stored:  # the updates are read twice, and both reads must see the same rows
        held = scratch_dir(spark, "updates")
        updates.write.options(**PACKED).parquet(held)
        updates = spark.read.parquet(held)
    try:
        # as many as folders at most
        touched = sorted(r[0] for r in updates.select(folder_of(key, folders, by)).distinct().collect())
        target = _folders(spark, path, [r for r in manifest if r.folder in touched], schema)
        merged = merge(target, updates).select(*schema.names)
        with _exchanges_by_folder(spark, folders):
            written = _write(merged, path, key, folders, batch, by, by_key and by == HASH) if touched else []
        versions = {r.folder: r.version for r in manifest if r.folder >= 0 and r.folder not in touched}
        _commit(spark, path, versions | dict.fromkeys(written, batch), key, folders, batch, by)
    finally:
        if held:
            remove(spark, held)
    return touched


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove folder versions and manifests that the newest ``keep`` commits do not
    name; the number of folders removed. Readers of older commits must be done."""
    kept = [n for n in _numbers(spark, f"{path}/manifest", "batch") if n <= committed(spark, path)][-keep:]
    named = {(r.version, r.folder) for n in kept for r in _manifest(spark, path, n)}
    removed = 0
    for version in _numbers(spark, f"{path}/data", "version"):
        if version > kept[-1]:  # a merge under way
            continue
        for folder in _numbers(spark, f"{path}/data/version={version}", "folder"):
            if (version, folder) not in named:
                removed += remove(spark, f"{path}/data/version={version}/folder={folder}")
    for n in _numbers(spark, f"{path}/manifest", "batch"):
        if n < kept[0]:
            remove(spark, f"{path}/manifest/batch={n}")
    return removed
