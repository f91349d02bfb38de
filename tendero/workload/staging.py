"""What is written from the given tables once, to be read as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_dir
from ..sources import sinks

_STAGED: dict[tuple, str] = {}


def version(t) -> tuple:
    """What tells one state of the given tables from another: their files' names, times and sizes."""
    listed = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(t.directory)
    row = listed.agg(F.count("*"), F.max("modificationTime"), F.sum("length"), F.sum(F.crc32("path"))).first()
    return tuple(row)


def staged(t, label: str, write) -> str:
    """Path of something derived from the given tables, written once for each state of them."""
    key = (t.spark.sparkContext.applicationId, t.directory, label, version(t))
    if key not in _STAGED:
        path = scratch_dir(t.spark, label)
        write(path)
        _STAGED[key] = path
    return _STAGED[key]


def snapshot_folder(t) -> str:
    return staged(t, "snapshots", lambda p: sinks.write_snapshots(t.snapshot_rows, p))
