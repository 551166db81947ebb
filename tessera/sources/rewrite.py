"""Rewriting Parquet data as recommended.

exact: pyarrow writes each file in a task of its own, with encoding, codec and level per column; a row group is read and written in
parts of PART rows at most, and the new file takes its name at the end.
native: Spark's writer, for data of any size; one codec for all columns, dictionaries per column, version 2 pages.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import writer_codec, writer_encoding
from tessera.operators.sample import spooled
from tessera.report import APPLY_ROWS, tune
from tessera.sources.footer import column_summary, footers, place_of

PART = 1 << 20


def writer_plan(columns: list[dict]) -> dict:
    """pyarrow's arguments: dictionary, encoding, codec and level by column path."""
    encodings = {c["column"]: writer_encoding(c["encoding"]) for c in columns}
    codecs = {c["column"]: writer_codec(c["rec_codec"], c["rec_level"]) for c in columns}
    levels = {c: n for c, (_, n) in codecs.items() if n is not None}
    return {
        "use_dictionary": [c for c, e in encodings.items() if e == "RLE_DICTIONARY"],
        "column_encoding": {c: e for c, e in encodings.items() if e != "RLE_DICTIONARY"},
        "compression": {c: "NONE" if n == "UNCOMPRESSED" else n for c, (n, _) in codecs.items()},
    } | ({"compression_level": levels} if levels else {})


def size_of(path: str) -> int:
    """Bytes of a file, or of the Parquet files below a folder; -1 if there is nothing."""
    system, at = place_of(path)
    info = system.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        return -1
    if info.type == pafs.FileType.File:
        return info.size
    return sum(f.size for f in system.get_file_info(pafs.FileSelector(at, recursive=True)) if f.is_file and f.path.endswith(".parquet"))


def same_file(a: str, b: str) -> bool:
    """Whether two paths name one file, links and relative parts resolved where the file system is local."""
    import os

    (x, at), (y, to) = place_of(a), place_of(b)
    local = isinstance(x, pafs.LocalFileSystem) and isinstance(y, pafs.LocalFileSystem)
    return os.path.realpath(at) == os.path.realpath(to) if local else (x, at) == (y, to)


def rewrite(spark: SparkSession, source: str, target: str, engine: str = "unknown", priority: str = "balanced", sample_rows: int = APPLY_ROWS, in_place: bool = False, mode: str = "exact") -> dict:
    """Write source to target as recommended; a dict of bytes before and after, rows and the report."""
    if not in_place:
        if same_file(source, target):
            raise FileExistsError(f"{target} is the input")
        if size_of(target) >= 0:
            raise FileExistsError(target)
    report = tune(spark, source, engine, priority, sample_rows)
    before = size_of(source)
    rows = exact(spark, [(source, target)], report["columns"]) if mode == "exact" else native(spark, source, target, report)
    after = size_of(target)
    return {"input_bytes": before, "output_bytes": after, "rows": rows, "reduction_pct": (1 - after / before) * 100 if before else 0.0, "report": report}


def exact(spark: SparkSession, files: list[tuple[str, str]], columns: list[dict]) -> int:
    """Write each source to its target, a task per file; the number of rows. Paths are such that all executors see them."""
    plan = writer_plan(columns)

    def run(batches):
        for batch in batches:
            rows = [written(source, target, plan) for source, target in zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64())], names=["n"])

    pairs = spark.createDataFrame([(*f, i) for i, f in enumerate(files)], "source string, target string, i int")
    return pairs.repartitionByRange(len(files), "i").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def written(source: str, target: str, plan: dict) -> int:
    """Rows copied from source to a temporary file beside target, which then takes its name."""
    (system, at), (home, to) = place_of(source), place_of(target)
    temporary, rows = f"{to}.{uuid.uuid4().hex}.tmp", 0
    try:
        with system.open_input_file(at) as data, home.open_output_stream(temporary) as sink:
            reader = pq.ParquetFile(data)
            with pq.ParquetWriter(sink, reader.schema_arrow, **plan) as writer:
                for g in range(reader.num_row_groups):
                    if reader.metadata.row_group(g).num_rows == 0:
                        continue
                    held, n = [], 0
                    for part in reader.iter_batches(batch_size=min(PART, 1 << 16), row_groups=[g]):
                        held.append(part)
                        n += part.num_rows
                        if n >= PART:
                            writer.write_table(pa.Table.from_batches(held), row_group_size=n)
                            rows, held, n = rows + n, [], 0
                    if held:
                        writer.write_table(pa.Table.from_batches(held), row_group_size=n)
                        rows += n
        home.move(temporary, to)
    except BaseException:
        if home.get_file_info(temporary).type != pafs.FileType.NotFound:
            home.delete_file(temporary)
        raise
    return rows


def read_exact(spark: SparkSession, path: str, columns: list[str], schema: str) -> DataFrame:
    """Columns of a file as pyarrow reads them, for encodings that Spark's vectorized reader lacks."""

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, at = place_of(file)
                with system.open_input_file(at) as data:
                    yield from pq.ParquetFile(data).iter_batches(columns=columns)

    return spark.createDataFrame([(path,)], "path string").mapInArrow(run, schema)


def native(spark: SparkSession, source: str, target: str, report: dict) -> int:
    names = {"UNCOMPRESSED": "none", "LZ4": "lz4_raw"}
    codec = report["file_codec"]
    data = spark.read.parquet(source)
    writer = data.write.mode("errorifexists").option("compression", names.get(codec, codec.lower())).option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false")
    if codec == "ZSTD" and report["file_level"] is not None:
        writer = writer.option("parquet.compression.codec.zstd.level", str(report["file_level"]))
    for c in report["columns"]:
        if c["encoding"] == "RLE_DICTIONARY":
            writer = writer.option(f"parquet.enable.dictionary#{c['column']}", "true")
    writer.parquet(target)
    return spark.read.parquet(target).count()


def rewrite_bytes(spark: SparkSession, content: bytes, engine: str = "unknown", priority: str = "balanced", sample_rows: int = APPLY_ROWS) -> tuple[bytes, dict]:
    """rewrite() of a file's content, with the sizes of its columns before and after."""
    source = spooled(spark, content)
    target = source.replace("content-", "rewritten-")
    result = rewrite(spark, source, target, engine, priority, sample_rows)
    result["columns"] = [r.asDict() for r in size_deltas(footers(spark, source), footers(spark, target)).orderBy("position").collect()]
    system, at = place_of(target)
    with system.open_input_stream(at) as f:
        made = f.read()
    for path in (source, target):
        system, at = place_of(path)
        system.delete_file(at)
    return made, result


def size_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(position, column, before_bytes, after_bytes, reduction_pct) by column name."""
    old = column_summary(before).select("position", "column", F.col("compressed").alias("before_bytes"))
    new = column_summary(after).select("column", F.col("compressed").alias("after_bytes"))
    pct = F.when(F.col("before_bytes") > 0, (1 - F.col("after_bytes") / F.col("before_bytes")) * 100).otherwise(0.0)
    return old.join(new, "column").withColumn("reduction_pct", pct)
