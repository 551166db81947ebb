"""Parquet footers as a DataFrame: one row per file, row group and leaf column.

Format "parquet_footer" reads footers only, one task per file; footers_of_bytes() takes files' content.
Columns are named by their dotted path, so equal leaf names of different structs stay apart.
"""

from __future__ import annotations

import io
import json
import math

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = """file string, file_size long, version string, file_rows long, row_groups int, created_by string, row_group int, rg_rows long,
position int, column string, leaf string, physical string, logical string, codec string, encodings array<string>, compressed long, uncompressed long,
dict_bytes long, has_stats boolean, nulls long, min_number double, max_number double, min_text string, max_text string"""
NAMES = [part.split()[0] for part in SCHEMA.replace("\n", " ").split(", ")]

#: The level a footer's codec stands for, as footers hold none.
DEFAULT_LEVEL = {"ZSTD": 1, "GZIP": 6, "BROTLI": 1}
CODEC_NAMES = {"LZ4": "LZ4_RAW", "LZ4_HADOOP": "LZ4", "NONE": "UNCOMPRESSED"}


def codec_label(name: str) -> str:
    name = CODEC_NAMES.get(name.upper(), name.upper())
    return f"{name}:{DEFAULT_LEVEL[name]}" if name in DEFAULT_LEVEL else name


def logical_label(column) -> str | None:
    """STRING, TIMESTAMP(MICROS, UTC), DECIMAL(p, s), INT(8, true) and the like; None without one."""
    kind = json.loads(column.logical_type.to_json())
    name = kind.get("Type", "None").upper()
    if name in ("NONE", "UNKNOWN", "NULL"):
        return None
    if name in ("TIMESTAMP", "TIME"):
        unit = {"milliseconds": "MILLIS", "microseconds": "MICROS", "nanoseconds": "NANOS"}.get(kind.get("timeUnit"), "MICROS")
        return f"{name}({unit}{', UTC' if kind.get('isAdjustedToUTC') else ''})"
    if name == "DECIMAL":
        return f"DECIMAL({kind.get('precision')}, {kind.get('scale')})"
    if name == "INT":
        return f"INT({kind.get('bitWidth')}, {str(bool(kind.get('isSigned'))).lower()})"
    return name


def shown(value, physical: str) -> str | None:
    """A statistic as text: numbers plain, reals with 4 digits, bytes as text of 40 characters at most or as hex."""
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value + 0.0:.4f}"  # writers store a least value of zero as -0.0
    if isinstance(value, bytes):
        if physical != "BYTE_ARRAY":
            return value[:20].hex()
        value = value.decode("utf-8", "replace")
    text = str(value)
    return text[:39] + "…" if len(text) > 40 else text


def number(value) -> float | None:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    return None if isinstance(value, float) and math.isnan(value) else float(value)


def rows_of(meta: pq.FileMetaData, file: str, size: int):
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for c in range(group.num_columns):
            chunk, leaf = group.column(c), meta.schema.column(c)
            stats = chunk.statistics
            bounds = (stats.min_raw, stats.max_raw) if stats is not None and stats.has_min_max else (None, None)
            text = [shown(getattr(stats, k), leaf.physical_type) if bounds[0] is not None else None for k in ("min", "max")] if stats is not None else [None, None]
            start = chunk.dictionary_page_offset
            dictionary = chunk.data_page_offset - start if start and chunk.data_page_offset > start else None
            yield (
                file, size, meta.format_version, meta.num_rows, meta.num_row_groups, meta.created_by, g, group.num_rows,
                c, leaf.path, leaf.name, leaf.physical_type, logical_label(leaf), codec_label(chunk.compression), sorted(set(chunk.encodings)), chunk.total_compressed_size, chunk.total_uncompressed_size,
                dictionary, stats is not None, stats.null_count if stats is not None and stats.has_null_count else None, number(bounds[0]), number(bounds[1]), *text,
            )


class FilePartition(InputPartition):
    def __init__(self, file: str):
        super().__init__(file)
        self.file = file


def place_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path within it; without a scheme it is local."""
    if path.startswith("file:"):
        path = "file://" + "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    system, at = place_of(path)
    info = system.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [path]
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    files = system.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted(prefix + f.path for f in files if f.is_file and f.path.endswith(".parquet") and not f.base_name.startswith(("_", ".")))


class FooterReader(DataSourceReader):
    def __init__(self, options):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]

    def partitions(self):
        return [FilePartition(f) for p in self.paths for f in listed(p)]

    def read(self, partition):
        file = partition.file
        system, at = place_of(file)
        with system.open_input_file(at) as f:
            yield from rows_of(pq.read_metadata(f), file, f.size())


class FooterSource(DataSource):
    """spark.read.format("parquet_footer").load(path)"""

    @classmethod
    def name(cls):
        return "parquet_footer"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FooterReader(self.options)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """Footer rows of a file or of all Parquet files below a directory."""
    spark.dataSource.register(FooterSource)
    return spark.read.format("parquet_footer").load(path)


def footers_of_bytes(contents: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Footer rows of files held as binary values, such as spark.read.format("binaryFile") gives."""

    def run(batches):
        for batch in batches:
            rows = [r for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in rows_of(pq.read_metadata(io.BytesIO(data)), name, len(data))]
            yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r, strict=True)) for r in rows], schema=ARROW)

    return contents.select(path, content).mapInArrow(run, SCHEMA)


ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}[part.split()[1]]) for n, part in zip(NAMES, SCHEMA.replace("\n", " ").split(", "), strict=True)])


def column_names(footer: DataFrame) -> DataFrame:
    """(file, column) of all leaf columns, in file order."""
    return footer.where("row_group = 0").select("file", "position", "column").orderBy("file", "position")


def column_summary(footer: DataFrame) -> DataFrame:
    """One row per file and column: sums over row groups, union of encodings, bounds, and the values by row group."""
    by = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("row_group", F.col(c).alias("v")))), lambda x: x.v)
    low, high = F.min_by("min_text", F.coalesce("min_number", F.lit(0.0))), F.max_by("max_text", F.coalesce("max_number", F.lit(0.0)))
    return footer.groupBy("file", "column").agg(
        F.first("position").alias("position"), F.first("leaf").alias("leaf"), F.first("physical").alias("physical"), F.first("logical").alias("logical"),
        F.min_by("codec", "row_group").alias("codec"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("encodings")))).alias("encodings"),
        F.sum("compressed").alias("compressed"), F.sum("uncompressed").alias("uncompressed"),
        F.when(F.sum("compressed") > 0, F.sum("uncompressed") / F.sum("compressed")).otherwise(1.0).alias("ratio"),
        F.bool_and("has_stats").alias("statistics_available"),
        F.when(F.count("nulls") == F.count(F.lit(1)), F.sum("nulls")).alias("total_nulls"),
        F.when(F.count("min_number") > 0, low).otherwise(F.min("min_text")).alias("min_value"),
        F.when(F.count("max_number") > 0, high).otherwise(F.max("max_text")).alias("max_value"),
        by("encodings").alias("rg_encodings"), by("dict_bytes").alias("rg_dict_bytes"), by("compressed").alias("rg_compressed"), by("nulls").alias("rg_nulls"),
    )


def file_summary(footer: DataFrame) -> DataFrame:
    """One row per file: size, version, rows and the row groups' rows and bytes."""
    groups = footer.groupBy("file", "row_group").agg(F.first("rg_rows").alias("rows"), F.sum("compressed").alias("bytes"), F.first("file_size").alias("file_size"), F.first("version").alias("version"), F.first("file_rows").alias("file_rows"), F.first("created_by").alias("created_by"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("row_group", F.col(c).alias("v")))), lambda x: x.v)
    return groups.groupBy("file").agg(
        F.first("file_size").alias("file_size"), F.first("version").alias("version"), F.first("file_rows").alias("file_rows"), F.count(F.lit(1)).cast("int").alias("row_groups"), F.first("created_by").alias("created_by"),
        ordered("rows").alias("rg_rows"), ordered("bytes").alias("rg_bytes"), F.floor(F.avg("rows")).alias("avg_rows_per_group"),
    )


def info(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """column_summary() of a path; a list of names keeps those columns, unknown names are ignored, an empty list keeps all."""
    out = column_summary(footers(spark, path))
    wanted = [c.strip() for c in columns or [] if c.strip()]
    return out.where(F.col("column").isin(wanted) | F.col("leaf").isin(wanted)) if wanted else out
