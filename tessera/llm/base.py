"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session.

    Only where the session names none and the master is local (tests) a temporary one is made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: The tables of the scratch() blocks that are open.
OPEN: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """What stored() makes in this block is deleted at its end, but for the tables given to the function it yields.

    So an operator leaves no more than the tables that its lazy result reads.
    """
    mine, kept = [], []
    OPEN.append(mine)
    try:
        yield kept.append
    finally:
        OPEN.remove(mine)
        for df in mine:
            if not any(df is k for k in kept):
                forget(df)
        if OPEN:
            OPEN[-1].extend(kept)


def stored(df: DataFrame, name: str, clean: bool = True) -> DataFrame:
    """Write df to the shared folder and read it again: lineage is cut and lost executors cost nothing.

    clean: shuffle files of steps that are over go at once; without it they go with a later table. That suits small steps.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if clean:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if OPEN:
        OPEN[-1].append(out)
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by stored() that no later step reads."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Long texts go to Python in Arrow batches of few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives its memory back: workers live on between tasks and stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def append_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]]) -> DataFrame:
    """df with new columns, computed batch by batch in one Arrow pass without a shuffle.

    make() runs once a task and returns the function from a batch to the new columns.
    A column of df with the name of a new one is replaced.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in new]
    positions = [i for i, c in enumerate(df.columns) if c.lower() not in new]
    schema = T.StructType([df.schema[c] for c in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            columns = [batch.column(i) for i in positions] + work(batch)
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *(f.name for f in fields)])

    small_batches(df.sparkSession)
    return df.mapInArrow(trimmed(run), schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: White space of the Unicode standard, which is what str.split() takes but for U+001C to U+001F.
GAP = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def parts_of(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A text in parts of about size characters that end behind white space; a longer word is not cut."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + size)
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
