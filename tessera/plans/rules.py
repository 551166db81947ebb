"""Which encoding and codec suits a column, as expressions over joined profile and footer rows.

Input columns: those of profile.STATS without `column` clashes, and physical, logical, encodings, codec, uncompressed
of footer.column_summary().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import value_bytes

#: Fixed values.
MONOTONIC, FEW, MANY, SORTED_TEXT, SHORT_TEXT, DICTIONARY_BYTES, RANDOM_BITS = 0.90, 0.10, 0.50, 0.80, 50.0, 524_288, 7.5
RULES = ("BooleanRle", "DeltaMonotonic", "RleDictionary", "ByteStreamSplit", "PlainUuid", "DeltaByteArray", "DeltaLengthByteArray", "PlainDefault")
ENCODING_OF = {"BooleanRle": "RLE", "DeltaMonotonic": "DELTA_BINARY_PACKED", "RleDictionary": "RLE_DICTIONARY", "ByteStreamSplit": "BYTE_STREAM_SPLIT", "PlainUuid": "PLAIN", "DeltaByteArray": "DELTA_BYTE_ARRAY", "DeltaLengthByteArray": "DELTA_LENGTH_BYTE_ARRAY", "PlainDefault": "PLAIN"}

#: Codecs and encodings by engine: (engine, name, supported, least version, note).
CODEC_SUPPORT = [
    *((e, c, True, None, None) for e in ("spark", "duckdb", "polars", "clickhouse", "pandas") for c in ("UNCOMPRESSED", "SNAPPY", "GZIP")),
    ("spark", "ZSTD", True, "3.2.0", "needs a Hadoop build with zstd"), ("spark", "LZ4", True, None, "Hadoop framing; other readers may reject it"), ("spark", "LZ4_RAW", True, "3.5.0", None), ("spark", "BROTLI", False, None, "codec class not shipped"),
    ("duckdb", "ZSTD", True, None, None), ("duckdb", "LZ4", True, "0.10.0", "written as LZ4_RAW"), ("duckdb", "LZ4_RAW", True, "0.10.0", None), ("duckdb", "BROTLI", True, "1.0.0", None),
    ("polars", "ZSTD", True, None, None), ("polars", "LZ4", True, None, "written as LZ4_RAW"), ("polars", "LZ4_RAW", True, None, None), ("polars", "BROTLI", True, None, None),
    ("clickhouse", "ZSTD", True, None, None), ("clickhouse", "LZ4", True, None, None), ("clickhouse", "LZ4_RAW", True, None, None), ("clickhouse", "BROTLI", True, None, "slow to decode"),
    ("pandas", "ZSTD", True, None, None), ("pandas", "LZ4", True, None, None), ("pandas", "LZ4_RAW", True, None, None), ("pandas", "BROTLI", True, None, None),
]
ENCODING_SUPPORT = [("spark", "DELTA_BINARY_PACKED", "3.2.0"), ("spark", "DELTA_BYTE_ARRAY", "3.3.0"), ("spark", "DELTA_LENGTH_BYTE_ARRAY", "3.3.0")]


def conditions() -> dict[str, Column]:
    """What each rule asks for, in order; the first that holds decides."""
    physical, logical, ratio = F.col("physical"), F.coalesce("logical", F.lit("")), F.col("cardinality_ratio")
    text = physical == "BYTE_ARRAY"
    spread = text & (ratio >= FEW) & ~F.col("uuid_detected") & ~F.col("json_detected") & (F.coalesce("len_mean", F.lit(float("inf"))) <= SHORT_TEXT)
    return {
        "BooleanRle": physical == "BOOLEAN",
        "DeltaMonotonic": (physical.isin("INT32", "INT64") | logical.startswith("TIMESTAMP") | logical.startswith("DATE")) & (F.coalesce("monotonicity", F.lit(-1.0)) >= MONOTONIC),
        "RleDictionary": (ratio < FEW) & (F.col("distinct_count") * value_bytes() < DICTIONARY_BYTES),
        "ByteStreamSplit": physical.isin("FLOAT", "DOUBLE") & (ratio > MANY),
        "PlainUuid": text & F.col("uuid_detected"),
        "DeltaByteArray": spread & (F.coalesce("string_monotonicity", F.lit(-1.0)) >= SORTED_TEXT),
        "DeltaLengthByteArray": spread,
        "PlainDefault": F.lit(True),
    }


def chain(pairs: dict[str, Column]) -> Column:
    out = None
    for value, condition in pairs.items():
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def encoding_of(rule: str = "rule") -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in ENCODING_OF.items() for x in pair)), F.col(rule))


def confidence() -> Column:
    """By sampled share and rows; near a rule's threshold Medium."""
    fraction, rows, ratio, order = F.col("sample_fraction"), F.col("n"), F.col("cardinality_ratio"), F.col("string_monotonicity")
    near = ((F.col("rule") == "RleDictionary") & ratio.between(0.08, 0.12)) | ((F.col("rule") == "DeltaByteArray") & (order >= 0.64) & (order < 0.96))
    return F.when(near, "Medium").when((fraction >= 0.10) & (rows >= 100_000), "High").when((fraction >= 0.02) | (rows >= 50_000), "Medium").otherwise("Low")


def with_encoding(rows: DataFrame) -> DataFrame:
    """rows with rule, encoding and confidence."""
    return rows.withColumn("rule", chain(conditions())).withColumn("encoding", encoding_of()).withColumn("confidence", confidence())


def with_codec(rows: DataFrame, engine: str, priority: str) -> DataFrame:
    """rows with rec_codec, rec_level and caveats (severity, message), engine overrides applied."""
    noisy = F.coalesce("byte_entropy", F.lit(0.0)) > RANDOM_BITS
    says = lambda severity, message: F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message"))
    none = F.array().cast("array<struct<severity:string,message:string>>")
    if engine == "spark":
        # Spark reads Snappy everywhere, so no priority leads to ZSTD there.
        codec, level = "SNAPPY", None
        notes = F.array(says("Info", "Snappy is read by every Spark version; ZSTD needs 3.2 or later"))
    elif priority == "speed":
        codec, level = "LZ4", None
        notes = F.when(F.col("encoding") == "DELTA_BINARY_PACKED", F.array(says("Warning", "LZ4 gains little on delta-packed integers"))).otherwise(none)
    else:
        codec, level, notes = "ZSTD", 6 if priority == "size" else 3, none
    if engine not in ("duckdb", "polars", "pandas", "unknown", "clickhouse"):
        split = F.when(F.col("encoding") == "BYTE_STREAM_SPLIT", F.array(says("Warning", "Spark's vectorized reader can't read BYTE_STREAM_SPLIT; turn it off for this column"))).otherwise(none)
        notes = F.concat(notes, split)
    return rows.withColumns(
        {
            "rec_codec": F.when(noisy, "UNCOMPRESSED").otherwise(codec),
            "rec_level": F.when(noisy, F.lit(None)).otherwise(F.lit(level)).cast("int"),
            "caveats": F.when(noisy, F.array(says("Info", "the bytes are close to random, so compressing them saves nothing"))).otherwise(notes),
            "engine_compat": F.when((F.lit(engine) == "spark") & (F.col("encoding") == "DELTA_BINARY_PACKED"), "spark>=3.2.0"),
        }
    )


def override_codec(engine: str, codec: str, level: int | None) -> tuple[str, int | None, tuple[str, str] | None]:
    """The codec an engine gets in place of one asked for, and what to say about it."""
    name = codec.upper()
    if engine == "spark" and name == "ZSTD":
        return "SNAPPY", None, ("Info", "ZSTD replaced by Snappy for older Spark clusters")
    if engine == "clickhouse" and name == "BROTLI":
        return "ZSTD", 3, ("Warning", "Brotli replaced by ZSTD, which ClickHouse decodes faster")
    if engine == "clickhouse" and name == "GZIP":
        return name, level, ("Warning", "GZIP decodes slowly in ClickHouse")
    return name, level, None


def codec_support(spark) -> DataFrame:
    return spark.createDataFrame(CODEC_SUPPORT, "engine string, codec string, supported boolean, min_version string, notes string")


def encoding_support(spark) -> DataFrame:
    return spark.createDataFrame(ENCODING_SUPPORT, "engine string, encoding string, min_version string")
