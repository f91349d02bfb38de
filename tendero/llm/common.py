"""Small helpers the text operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_dir, tune

# Rows of one Arrow batch: texts are long, and a batch must fit beside the JVM heap.
BATCH_ROWS = 512
# What one broadcast may take: the driver builds it beside its heap's other contents.
BROADCAST_BYTES = 64 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings of the text jobs."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text) of a table, a null text as an empty one.

    Whatever other columns the table has cannot clash with result columns.
    """
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fold(id_col: str | Column, folds: int) -> Column:
    """Fold of a row: crc32 of its id as text (null: empty), modulo ``folds``."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.encode(F.coalesce(column.cast("string"), F.lit("")), "utf-8")) % folds


def staged(df: DataFrame, label: str, **options: str) -> DataFrame:
    """The rows written to the shared folder and read back, lineage cut."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """A written table, marked for broadcast if it has at most so many rows and they take
    at most ``BROADCAST_BYTES`` there."""
    n = df.count()
    return F.broadcast(df) if n <= rows and n * row_bytes(df) <= BROADCAST_BYTES else df


def row_bytes(df: DataFrame) -> int:
    """What a row of numbers takes in a hashed relation, about: its fields, and the row's
    and the table's own."""

    def width(kind: T.DataType) -> int:
        return 8 + sum(width(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else 8

    return 48 + width(df.schema)


class Generations(dict):
    """A cache of bounded size. When the young half is full it becomes the old
    half, and what is asked for again moves back up."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def turn(self) -> None:
        """What is called before keys are asked for."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()

    def get_all(self, keys: Iterable) -> list:
        """Values of all keys, in order."""
        self.turn()
        return list(map(self.__getitem__, keys))
