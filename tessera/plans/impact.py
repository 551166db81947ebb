"""What a recommendation is worth: stars by column, size and speed by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import codec_family, codec_text

#: Size factors of encodings over plain pages.
FACTORS = {"DeltaMonotonic": 3.0, "ByteStreamSplit": 1.15, "DeltaByteArray": 2.5, "DeltaLengthByteArray": 1.05}
CODEC_FACTOR, MOST_PCT, SPEED = 1.15, 90.0, 0.7


def same_codec(strict_level: bool) -> Column:
    """Footers hold no level, so families are compared unless strict_level asks for texts."""
    return F.col("codec") == codec_text("rec_codec", "rec_level") if strict_level else codec_family(F.col("codec")) == F.col("rec_codec")


def with_stars(rows: DataFrame, strict_level: bool = False) -> DataFrame:
    """rows with share (of the file's uncompressed bytes) and stars from 1 to 5."""
    total = F.sum("uncompressed").over(Window.partitionBy("file"))
    share = F.when(total > 0, F.col("uncompressed") / total).otherwise(0.0)
    s, present = F.col("share"), F.array_contains("encodings", F.col("encoding"))
    stars = F.when(present & same_codec(strict_level), 1).when(present, F.when(s >= 0.10, 3).when(s >= 0.04, 2).otherwise(1)).otherwise(F.when(s >= 0.10, 5).when(s >= 0.04, 4).when(s >= 0.01, 3).otherwise(2))
    return rows.withColumn("share", share).withColumn("stars", stars.cast("int"))


def size_factor() -> Column:
    """By how much a column is expected to shrink; codec texts are compared without the level."""
    differs = F.col("codec") != F.col("rec_codec")
    plain = F.array_contains("encodings", "PLAIN") & ~F.arrays_overlap("encodings", F.array(F.lit("RLE_DICTIONARY"), F.lit("DELTA_BINARY_PACKED")))
    ratio = F.col("cardinality_ratio")
    out = F.when(F.col("rule") == "RleDictionary", F.when(ratio < 0.001, 10.0).when(ratio < 0.01, 5.0).otherwise(2.0))
    for rule, factor in FACTORS.items():
        out = out.when(F.col("rule") == rule, factor)
    return F.when(plain, out.otherwise(F.when(differs, 1.25).otherwise(1.0))).otherwise(F.when(differs, CODEC_FACTOR).otherwise(1.0))


def predicted(rows: DataFrame) -> DataFrame:
    """Per file: size_reduction_pct, read_speedup and overall_confidence (the worst)."""
    total = F.sum("uncompressed").over(Window.partitionBy("file"))
    weighted = rows.withColumn("gain", F.when(total > 0, F.col("uncompressed") / total).otherwise(0.0) * (1 - 1 / size_factor()))
    worst = F.max(F.when(F.col("confidence") == "Low", 2).when(F.col("confidence") == "Medium", 1).otherwise(0))
    out = weighted.groupBy("file").agg(F.least(F.lit(MOST_PCT), 100 * F.sum("gain")).alias("size_reduction_pct"), worst.alias("worst"))
    return out.select("file", "size_reduction_pct", (1 + SPEED * F.col("size_reduction_pct") / 100).alias("read_speedup"), F.when(F.col("worst") == 2, "Low").when(F.col("worst") == 1, "Medium").otherwise("High").alias("overall_confidence"))


def size_range(pct: Column) -> Column:
    return F.struct(F.floor(pct * 0.5).alias("low"), F.ceil(pct * 1.5).alias("high"))


def mode_codec(rows: DataFrame, codec: str = "codec", level: str | None = None) -> DataFrame:
    """The most frequent codec of each file; of equals the one that comes first in the file."""
    keys = [codec] + ([level] if level else [])
    counts = rows.groupBy("file", *keys).agg(F.count(F.lit(1)).alias("times"), F.min("position").alias("at"))
    best = counts.groupBy("file").agg(F.max_by(F.struct(*keys), F.struct("times", -F.col("at"))).alias("best"))
    return best.select("file", *(F.col(f"best.{k}").alias(f"mode_{k}") for k in keys))
