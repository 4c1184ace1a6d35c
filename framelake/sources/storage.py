"""Tables between the steps of a query, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one only in local mode without it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="framelake-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _written(df: DataFrame, label: str) -> str:
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    store, where = _file_system(df.sparkSession, path)
    store.deleteOnExit(where)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back. Removed when the driver ends."""
    return df.sparkSession.read.schema(df.schema).parquet(_written(df, label))


class Scratch:
    """Tables of one operator, removed together once its result is written and no plan needs them any more."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        path = _written(df, label)
        self.paths.append((df.sparkSession, path))
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        while self.paths:
            store, where = _file_system(*self.paths.pop())
            store.delete(where, True)


BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Send rows to Python in batches of a few MB: a worker's memory then follows its longest row, not 10,000 rows. A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


#: Rows of a batch that a task puts together: of records, and of pieces of columns.
BATCH_RECORDS, BATCH_ROWS = 1024, 1 << 16


def record_batches(records: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Records in batches of a few MB: a batch for every short record costs more than its work."""
    held, size = [], 0
    for r in records:
        held.append(r)
        size += sum(len(v) for v in r.values() if isinstance(v, bytes))
        if size >= BATCH_BYTES or len(held) >= BATCH_RECORDS:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def column_batches(pieces: Iterator[tuple[np.ndarray, ...]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pieces of equally long columns put together to batches; a piece that is longer by itself stays whole."""
    held, n = [], 0

    def whole() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    for p in pieces:
        held.append(p)
        n += len(p[0])
        if n >= BATCH_ROWS:
            yield whole()
            held, n = [], 0
    if held:
        yield whole()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by keys to as many tasks as the session shuffles to. With the number given, adaptive execution doesn't merge
    them: it goes by bytes, and short rows that cost much work (a palette, a file) would end up in one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)
