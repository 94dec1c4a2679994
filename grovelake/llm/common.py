"""What the operators of this subpackage share: shared-folder tables, row keys, global order."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value of the contracts: a run of ASCII white space, and a word between such runs.
WHITE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the cluster names none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='grovelake-')}")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def repeats(df: DataFrame, id_col: str) -> bool:
    """Whether some id is null or stands on several rows; reads that column alone."""
    seen = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    return not seen.where((F.col("n") > 1) | F.col(id_col).isNull()).isEmpty()


def numbered(df: DataFrame, order: Sequence[Column], to: str) -> DataFrame:
    """df with `to` = 0, 1, 2, ... in ascending order (nulls first), without bringing all rows to one task.

    Rows are range-partitioned and sorted; only one count per partition is gathered to make the offsets.
    """
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.select("*", *[c.alias(n) for c, n in zip(order, names, strict=True)])
    placed = stored(keyed.repartitionByRange(*[F.col(n) for n in names]).withColumn("_part", F.spark_partition_id()), "order")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*names)) - 1
    return placed.withColumn("_at", at).join(F.broadcast(before), "_part").withColumn(to, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before", *names)


def keyed_or_numbered(df: DataFrame, id_col: str, text_col: str, to: str = "_rk") -> tuple[DataFrame, bool]:
    """df with a unique long key per row, and whether that is the id itself; else it is the place in (id, text) order.

    Ids serve where they are integers, unique and not null. Null ids come last. Rows equal in both are interchangeable, so
    either may get either key.
    """
    if isinstance(df.schema[id_col].dataType, T.IntegralType) and not repeats(df, id_col):
        return df.withColumn(to, F.col(id_col).cast("long")), True
    return stored(numbered(df, [F.col(id_col).isNull(), F.col(id_col), F.col(text_col)], to), "keyed"), False


def keyed(df: DataFrame, id_col: str, text_col: str, to: str = "_rk") -> DataFrame:
    return keyed_or_numbered(df, id_col, text_col, to)[0]


#: Bytes of text and rows that a Python worker turns into objects at a time.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 2048


def sliced(batches: Iterator[pa.RecordBatch], column: int | str) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of at most SLICE_BYTES of the column and SLICE_ROWS rows; a longer value stands alone.

    A batch of long texts is many times its size as Python objects, so a worker holds those of one slice only.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            before = ends[start] - sizes[start]
            stop = min(max(int(np.searchsorted(ends, before + SLICE_BYTES, "right")), start + 1), start + SLICE_ROWS)
            yield batch.slice(start, stop - start)
            start = stop
        del batch
        pa.default_memory_pool().release_unused()


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after which the worker gives freed memory back where the C library can: Spark keeps it for later stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return whole
