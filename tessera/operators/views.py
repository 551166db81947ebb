"""Tables that a report page shows: filters, orders and summaries of recommendation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import codec_family
from tessera.plans.impact import size_range


def present_encoding() -> Column:
    """The first that is neither PLAIN nor RLE, else the first, else PLAIN."""
    return F.coalesce(F.get(F.filter("encodings", lambda e: ~e.isin("PLAIN", "RLE")), F.lit(0)), F.get("encodings", F.lit(0)), F.lit("PLAIN"))


def effectively_match() -> Column:
    """Nothing worth changing: marked so, or the same encoding and codec family."""
    return (F.col("status") == "Match") | (F.array_contains("encodings", F.col("encoding")) & (codec_family(F.col("codec")) == F.col("rec_codec")))


def with_changes(rows: DataFrame) -> DataFrame:
    now = present_encoding()
    return rows.withColumns({"present_encoding": now, "encoding_changes": now != F.col("encoding"), "codec_changes": codec_family(F.col("codec")) != F.col("rec_codec"), "effectively_match": effectively_match()})


def search(rows: DataFrame, part: str) -> DataFrame:
    return rows.where(F.lower("column").contains(part.lower()))


def open_only(rows: DataFrame) -> DataFrame:
    return rows.where(~effectively_match())


def reasons(rows: DataFrame) -> DataFrame:
    """Columns with something to say about: an encoding other than PLAIN or another codec."""
    return rows.where((F.col("encoding") != "PLAIN") | (codec_family(F.col("codec")) != F.col("rec_codec")))


def ordered(rows: DataFrame, by: str = "impact") -> DataFrame:
    rank = F.when(F.col("confidence") == "High", 0).when(F.col("confidence") == "Medium", 1).otherwise(2)
    keys = {"impact": [F.desc("stars"), effectively_match().asc(), F.asc("column")], "name": [F.asc("column")], "confidence": [rank.asc(), F.asc("column")], "size": [F.desc("compressed"), F.asc("column")]}
    return rows.orderBy(*keys[by])


def encoding_breakdown(rows: DataFrame) -> DataFrame:
    return rows.groupBy("encoding").agg(F.count(F.lit(1)).alias("columns")).orderBy(F.desc("columns"), "encoding")


def estimated_sizes(predictions: DataFrame) -> DataFrame:
    return predictions.select("*", size_range(F.col("size_reduction_pct")).alias("r")).select("*", "r.low", "r.high").drop("r")


def with_badges(grid: DataFrame) -> DataFrame:
    """A bench grid with marks on the least size, read time and write time."""
    whole = Window.partitionBy("column")
    return grid.withColumns({f"best_{c}": F.col(c) == F.min(c).over(whole) for c in ("bytes", "read_ms", "write_ms") if c in grid.columns})


def shares(rows: DataFrame) -> DataFrame:
    total = F.sum("uncompressed").over(Window.partitionBy("file"))
    return rows.withColumn("share_of_file", F.when(total > 0, F.col("uncompressed") / total).otherwise(0.0))
