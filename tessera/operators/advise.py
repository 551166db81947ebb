"""Advice on a whole file: the size of its row groups and columns it might be sorted by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: MiB from and to, by engine.
GROUP_MB = {"duckdb": (64, 128), "polars": (64, 128), "pandas": (64, 128), "spark": (128, 512), "clickhouse": (64, 256), "unknown": (64, 256)}
SORTED = 0.95


def row_group_advice(files: DataFrame, engine: str) -> DataFrame:
    """Per file of file_summary(): average, least and largest row group in MiB, and whether the average fits the engine."""
    low, high = GROUP_MB[engine]
    mb = F.transform("rg_bytes", lambda b: b / F.lit(1048576.0))
    avg = F.aggregate(mb, F.lit(0.0), lambda a, b: a + b) / F.size(mb)
    out = files.select("file", "row_groups", avg.alias("avg_mb"), F.array_min(mb).alias("min_mb"), F.array_max(mb).alias("max_mb"))
    verdict = F.when(F.col("row_groups") == 0, "within").when(F.col("avg_mb") < low, "below").when(F.col("avg_mb") > high, "above").otherwise("within")
    return out.withColumns({"verdict": verdict, "within": verdict == "within", "from_mb": F.lit(low), "to_mb": F.lit(high)})


def sort_candidates(rows: DataFrame) -> DataFrame:
    """Columns in order in more than SORTED of pairs: INT64 or timestamps. Declared sort orders are not read."""
    kind = (F.col("physical") == "INT64") | F.coalesce("logical", F.lit("")).contains("TIMESTAMP")
    return rows.where((F.col("monotonicity") > SORTED) & kind).select("file", "position", "column", "monotonicity")
