"""The whole advice on a file: recommendation rows, predictions, options, diagnoses."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import PRIORITIES
from tessera.functions.scalars import engine as known_engine
from tessera.functions.scalars import priority as known_priority
from tessera.operators.advise import row_group_advice, sort_candidates
from tessera.operators.diagnose import health, with_diagnosis
from tessera.operators.profile import STATS, profile
from tessera.operators.sample import same_path, sample, whole
from tessera.operators.views import with_changes
from tessera.plans.explain import with_explain
from tessera.plans.impact import mode_codec, predicted, with_stars
from tessera.plans.rules import with_codec, with_encoding
from tessera.plans.snippets import options, snippet
from tessera.sources.footer import column_summary, file_summary, footers, listed
from tessera.streaming.progress import follow

TUNE_ROWS, APPLY_ROWS = 2_000_000, 500_000
#: What a column without a usable sample counts as.
DEFAULTS = {"nulls": 0, "null_fraction": 0.0, "distinct_count": 0, "distinct_method": "none", "cardinality_ratio": 0.0, "run_length": 0.0, "uuid_detected": False, "json_detected": False}


def joined(summary: DataFrame, stats: DataFrame, file_rows: DataFrame) -> DataFrame:
    """Footer rows with their statistics; where these are missing, defaults."""
    stats = stats.withColumnRenamed("file", "place")
    rows = summary.withColumn("place", same_path("file")).join(stats, ["place", "column"], "left").drop("place").join(file_rows.select("file", "file_rows"), "file")
    rows = rows.withColumn("n", F.coalesce("n", "file_rows")).fillna(DEFAULTS)
    return rows.withColumn("sample_fraction", F.when(F.col("file_rows") > 0, F.col("n") / F.col("file_rows")).otherwise(0.0))


def recommend(rows: DataFrame, engine: str = "unknown", priority: str = "balanced", explain: str = "brief", strict_level: bool = False) -> DataFrame:
    """joined() rows with everything that is decided per column. Runs on a stored profile as well, without a scan."""
    out = with_codec(with_encoding(rows), known_engine(engine), known_priority(priority))
    out = with_changes(with_diagnosis(with_stars(out, strict_level), strict_level))
    return with_explain(out) if explain == "full" else out


def profiled(spark: SparkSession, path: str, sample_rows: int | None = TUNE_ROWS, exact: bool | None = None, told: Callable[[int, int, str], None] | None = None) -> DataFrame:
    """Footer rows joined to sampled statistics; save it to recommend() again for other engines.

    sample_rows None: statistics of all rows. told: is called with (number, total, name) after each column, which then takes a scan of its own.
    """
    footer = footers(spark, path)
    top = [f.name for f in spark.read.parquet(path).schema]

    def stats_of(columns: list[str]) -> DataFrame:
        return profile(whole(spark, path, columns) if sample_rows is None else sample(spark, path, columns, sample_rows, footer), exact)

    if not top:
        stats = spark.createDataFrame([], STATS)
    elif told is None:
        stats = stats_of(top)
    else:
        parts = [rows for _, rows in follow(top, lambda c: spark.createDataFrame(stats_of([c]).collect(), STATS), told)]  # a row per file
        stats = reduce(DataFrame.unionAll, parts)
    return joined(column_summary(footer), stats, file_summary(footer))


def tune(spark: SparkSession, path: str, engine: str = "unknown", priority: str = "balanced", sample_rows: int = TUNE_ROWS, explain: str = "brief", strict_level: bool = False, told: Callable[[int, int, str], None] | None = None) -> dict:
    """The report of one file, as a dict that json can write. told: progress by column, see profiled()."""
    began = time.time()
    listed(path)  # which fails for a path without a file
    footer = footers(spark, path)
    return assemble(recommend(profiled(spark, path, sample_rows, told=told).cache(), engine, priority, explain, strict_level), file_summary(footer), engine, priority, sample_rows, explain, began)


def assemble(rows: DataFrame, files: DataFrame, engine: str, priority: str, sample_rows: int, explain: str, began: float) -> dict:
    engine, priority = known_engine(engine), known_priority(priority)
    rows = rows.cache()
    columns = [json.loads(r[0]) for r in rows.orderBy("position").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    file = files.first()
    guess = predicted(rows).first()
    top = mode_codec(rows.withColumn("rec", F.concat_ws(":", "rec_codec", F.col("rec_level").cast("string"))), "rec").first()
    codec, _, level = (top.mode_rec if top else "SNAPPY").partition(":")
    now = mode_codec(rows).first()
    bundles = {p: [r.asDict(True) for r in with_codec(rows, engine, p).orderBy("position").select("column", "encoding", "rec_codec", "rec_level", "caveats").collect()] for p in PRIORITIES}
    report = {
        "file": file.file if file else None, "file_size": file.file_size if file else 0, "num_rows": file.file_rows if file else 0, "row_groups": file.row_groups if file else 0,
        "engine": engine, "priority": priority, "explain": explain,
        "sample_fraction": min(1.0, sample_rows / file.file_rows) if file and file.file_rows else 1.0,
        "current_codec": now.mode_codec if now else None, "columns": columns, "file_codec": codec, "file_level": int(level) if level else None,
        "size_reduction_pct": guess.size_reduction_pct if guess else 0.0, "read_speedup": guess.read_speedup if guess else 1.0, "overall_confidence": guess.overall_confidence if guess else "High",
        "row_group_advice": row_group_advice(files, engine).first().asDict(True) if file else None,
        "sort_candidates": [r.column for r in sort_candidates(rows).orderBy("position").collect()],
        "health": health(rows).first().asDict() if columns else None,
        "options": options(bundles),
    }
    report["python_snippet"], report["spark_snippet"] = snippet(report, "unknown"), snippet(report, "spark")
    report["scan_ms"] = round((time.time() - began) * 1000)
    rows.unpersist()
    return report


def save(rows: DataFrame, files: DataFrame, folder: str) -> None:
    """profiled() rows and file_summary() rows as two tables, for recommendations without a scan."""
    rows.write.mode("errorifexists").parquet(f"{folder}/columns")
    files.write.mode("errorifexists").parquet(f"{folder}/files")


def from_saved(spark: SparkSession, folder: str, engine: str, priority: str, explain: str = "brief") -> dict:
    return retune(spark.read.parquet(f"{folder}/columns"), spark.read.parquet(f"{folder}/files"), engine, priority, explain)


def retune(rows: DataFrame, files: DataFrame, engine: str, priority: str, explain: str = "brief") -> dict:
    """A report from a stored profiled() table for another engine or priority."""
    return assemble(recommend(rows, engine, priority, explain), files, engine, priority, TUNE_ROWS, explain, time.time())
