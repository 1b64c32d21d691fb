"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stands for a null id inside joins; BIGINT's smallest value, turned back into null at the end.
NULL_ID = -(2**63)
#: Arrow batches handed to Python stay below these; long texts can't pile up in one batch.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20
#: Bits (as a power of two) of the set that says which rows may be among some keys: half a megabyte at any input size.
ROW_BITS = 22


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes, so that a Python worker's memory doesn't follow text lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow that gives freed memory back at its end: workers live on, beside those of other stages."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidied


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; without one, a folder of this machine where Spark runs within it alone."""
    context = spark.sparkContext
    if named := context.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="pixelweir-")


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder. Its files go with it if spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def row_key(id_column: str = "doc_id", text_column: str = "text") -> list:
    """(_d, _h): a null-safe join key for a document. Rows that share id and text share it, and so share their result."""
    return [
        F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("_d"),
        F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("_h"),
    ]


def fresh(docs: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of docs has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def may_hold(keys: DataFrame, d: str = "_d", h: str = "_h") -> Column:
    """Whether the row key (d, h) may be among those of keys (_d, _h): a test against a bit set of fixed size, so that
    only rows that pass it need a join, and the texts of all others no shuffle. More keys only make more rows pass."""
    spark = keys.sparkSession
    words = 1 << (ROW_BITS - 6)
    own = keys.select(F.expr(f"pmod(xxhash64(_d, _h), {1 << ROW_BITS})").alias("bit")).selectExpr("bit div 64 AS w", "shiftleft(1L, int(bit % 64)) AS m")
    every = own.union(spark.range(words).selectExpr("id AS w", "0L AS m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    bits = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "m"))), lambda x: x["m"]).alias("bits")).scalar()  # `words` rows
    bit = F.pmod(F.xxhash64(F.col(d), F.col(h)), F.lit(1 << ROW_BITS))
    return F.call_function("shiftright", F.get(bits, F.floor(bit / 64).cast("int")), F.pmod(bit, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) != 0


def columns(docs: DataFrame) -> list[Column]:
    """The columns of docs, whatever characters are in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def keep_rows(docs: DataFrame, gone: DataFrame, once: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without those of the keys `gone` (_d, _h), and of the keys `once` only one row each.

    With `once`, rows that may be among the keys are sorted behind the marks of their key and read in that order, so that
    docs are scanned twice and these rows shuffled once, whatever the keys; joins would scan docs again for each branch.
    """
    d, h = fresh(docs, "_d"), fresh(docs, "_h")
    own = docs.select("*", *[k.alias(n) for k, n in zip(row_key(doc_id, text), (d, h), strict=True)])
    if once is None:
        some = may_hold(durable(gone.select("_d", "_h")), d, h)
        parts = [own.filter(~some), own.filter(some).join(gone.select(F.col("_d").alias(d), F.col("_h").alias(h)), [d, h], "left_anti")]
    else:
        mark, row = fresh(own, "_mark"), fresh(own, "_row")
        marks = durable(gone.select("_d", "_h", F.lit(1).alias(mark)).union(once.select("_d", "_h", F.lit(2))))
        some = may_hold(marks, d, h)
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields]
        every = marks.select(*blank, "_d", "_h", mark, F.lit(0).alias(row)).union(own.filter(some).select("*", F.lit(None).cast("int"), F.lit(1)))
        so_far = Window.partitionBy(d, h).orderBy(row).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        every = every.toDF(*docs.columns, d, h, mark, row)
        marked = every.select("*", F.min(mark).over(so_far).alias(fate := fresh(every, "_fate")), F.sum(row).over(so_far).alias(nth := fresh(every, "_nth")))
        parts = [own.filter(~some), marked.filter((F.col(row) == 1) & (F.col(fate).isNull() | (F.col(fate) == 2) & (F.col(nth) == 1)))]
    return reduce(DataFrame.union, [p.select(*columns(docs)) for p in parts])


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each piece holds about `limit` bytes of text, and one row at least."""
    sizes = [len(x) if x is not None else 0 for x in batch.column(column).to_pylist()]
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)
