"""Rows with their file and place: whole files, or the first rows of each file's first row group."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.footer import file_summary, footers


#: So many files' bounds at most are sent to all tasks.
FILES = 1000


def same_path(file: str | Column, encoded: bool = False) -> Column:
    """A file's full path without scheme, so that names from a scan (which are encoded) and from a listing agree."""
    column = F.col(file) if isinstance(file, str) else file
    bare = F.regexp_replace(F.regexp_replace(column, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*(?=/))?", ""), "^/+", "/")
    return F.url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))) if encoded else bare


def whole(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All rows of all files, with __file (as the scan names it, so that no text is made for each row) and __row."""
    data = spark.read.parquet(path)
    wanted = columns if columns is not None else data.columns
    return data.select(*(F.col(f"`{c}`") for c in wanted), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def numbered(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """whole(), with __row counted on from file to file, by name."""
    rows = whole(spark, path, columns)
    if len(spark.read.parquet(path).inputFiles()) < 2:
        return rows
    sizes = rows.groupBy("__file").agg((F.max("__row") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(same_path("__file", True)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__file", before.alias("__before"))  # one row per file
    return rows.join(F.broadcast(offsets), "__file").withColumn("__row", F.col("__row") + F.col("__before")).drop("__before")


def sample(spark: SparkSession, path: str, columns: list[str] | None = None, max_rows: int = 2_000_000, footer: DataFrame | None = None) -> DataFrame:
    """Rows below max_rows of row group 0 of each file, with __file and __row.

    The bound is a predicate on the file's row index, which the scan takes; a plain limit would lose the order.
    Files' own bounds are joined by full path, so equal names in different folders stay apart.
    """
    rows = whole(spark, path, columns).where(F.col("__row") < max_rows)
    limits = file_summary(footer if footer is not None else footers(spark, path)).select(same_path("file").alias("__place"), F.get("rg_rows", F.lit(0)).alias("__first"))
    some = limits.limit(FILES + 1).collect()
    if len(some) == 1:
        return rows.where(F.col("__row") < some[0][1])
    if len(some) <= FILES:
        limits = F.broadcast(spark.createDataFrame(some, limits.schema))
    within = rows.withColumn("__place", same_path("__file", True)).join(limits, "__place").where(F.col("__row") < F.col("__first")).drop("__place", "__first")
    # A join that moves the rows loses their order.
    return within if len(some) <= FILES else within.repartition("__file").sortWithinPartitions("__file", "__row")


def sample_bytes(spark: SparkSession, content: bytes, columns: list[str] | None = None, max_rows: int = 2_000_000) -> DataFrame:
    """sample() of a file's content, which is put into the session's shared folder (spark.checkpoint.dir)."""
    return sample(spark, spooled(spark, content), columns, max_rows)


def spooled(spark: SparkSession, content: bytes) -> str:
    """The path of a file with this content that the driver and all executors see. Without a shared folder the master must be local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        folder = "file:///tmp/tessera"
    path = f"{folder.rstrip('/')}/content-{uuid.uuid4().hex}.parquet"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    with_stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    try:
        with_stream.write(bytearray(content))
    finally:
        with_stream.close()
    return path
