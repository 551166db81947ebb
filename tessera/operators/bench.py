"""Measured sizes and times of every encoding and codec on a column's sample."""

from __future__ import annotations

import io
import time

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import DEFAULT_GRID, parse_codec, parse_encoding, valid_encodings, writer_codec
from tessera.operators.sample import sample
from tessera.sources.footer import column_summary, footers

SAMPLE_ROWS = 500_000
SMALL_SAMPLE = 10_000


def written(table: pa.Table, encoding: str, codec: str, level: int | None) -> bytes:
    name = table.column_names[0]
    how = {"use_dictionary": [name]} if encoding == "RLE_DICTIONARY" else {"use_dictionary": False, "column_encoding": {name: encoding}}
    sink = io.BytesIO()
    pq.write_table(table, sink, compression="NONE" if codec == "UNCOMPRESSED" else codec, compression_level=level, row_group_size=max(1, table.num_rows), **how)
    return sink.getvalue()


def bench(spark: SparkSession, path: str, column: str, encodings: list[str] | None = None, codecs: list[tuple[str, int | None]] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(column, encoding, codec, level, bytes, ratio, write_ms, read_ms, note), least bytes first.

    ratio is against a plain, uncompressed file without a dictionary. The grid is a product of two small
    lists, run as one task per pair on a broadcast sample of at most sample_rows values of one column.
    """
    found = column_summary(footers(spark, path)).where((F.col("column") == column) | (F.col("leaf") == column)).orderBy("position").first()
    if found is None:
        raise ValueError(f"no column {column} in {path}")
    encodings = [parse_encoding(e) for e in encodings or valid_encodings(found.physical)]
    codecs = [parse_codec(*c) for c in codecs or DEFAULT_GRID]
    values = sample(spark, path, [column], sample_rows).orderBy("__row").select(column).toArrow()
    table = pa.table({column: values.column(0).combine_chunks()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    sent = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    grid = spark.createDataFrame([(i, e) for i, e in enumerate(encodings)], "i int, encoding string").crossJoin(F.broadcast(spark.createDataFrame([(j, c, n) for j, (c, n) in enumerate(codecs)], "j int, codec string, level int")))

    def measure(batches):
        own = pa.ipc.open_stream(sent.value).read_all()
        base = len(written(own, "PLAIN", "UNCOMPRESSED", None))
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                codec, level = writer_codec(r["codec"], r["level"])
                at = time.perf_counter()
                try:
                    data = written(own, r["encoding"], codec, level)
                except (pa.ArrowException, OSError) as e:
                    rows.append(r | {"bytes": None, "ratio": None, "write_ms": None, "read_ms": None, "note": str(e)[:200]})
                    continue
                mid = time.perf_counter()
                pq.read_table(io.BytesIO(data))
                end = time.perf_counter()
                note = "small sample: ratios of larger files may differ" if own.num_rows < SMALL_SAMPLE else None
                rows.append(r | {"bytes": len(data), "ratio": base / len(data), "write_ms": (mid - at) * 1e3, "read_ms": (end - mid) * 1e3, "note": note})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("i", pa.int32()), ("encoding", pa.string()), ("j", pa.int32()), ("codec", pa.string()), ("level", pa.int32()), ("bytes", pa.int64()), ("ratio", pa.float64()), ("write_ms", pa.float64()), ("read_ms", pa.float64()), ("note", pa.string())]))

    made = grid.repartition(len(encodings) * len(codecs), "i", "j").mapInArrow(measure, "i int, encoding string, j int, codec string, level int, bytes long, ratio double, write_ms double, read_ms double, note string")
    return made.orderBy(F.col("bytes").asc_nulls_last(), "i", "j").select(F.lit(column).alias("column"), "encoding", "codec", "level", "bytes", "ratio", "write_ms", "read_ms", "note")
