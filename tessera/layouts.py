"""Queries over columns whose layout is given by rule, with statistics of the real tables, and SQL that gives the same rows.

Footers have no SQL view. So the operators over layouts get a file's encodings, codecs and sizes from a rule by
a column's position, which SQL can repeat, while rows, lengths, order and distinct values are counted in the tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.advise import row_group_advice
from tessera.operators.diagnose import health, islands
from tessera.operators.profile import group_counts, profile
from tessera.operators.sample import numbered, whole
from tessera.operators.views import estimated_sizes, open_only
from tessera.plans.impact import mode_codec, predicted
from tessera.plans.rules import codec_support, encoding_support
from tessera.report import recommend

NAMES = ("nation", "customer", "orders")
#: Fixed values of the rule: by position modulo 4 the codec, by position modulo 5 the encodings, those by row group, dictionary bytes and ratio.
CODECS = ("SNAPPY", "ZSTD:1", "UNCOMPRESSED", "LZ4")
CASES = (
    (("PLAIN", "RLE"), (("PLAIN", "RLE"),), (None,), 1.0),
    (("PLAIN", "RLE", "RLE_DICTIONARY"), (("PLAIN", "RLE", "RLE_DICTIONARY"),), (950_000,), 2.0),
    (("RLE", "RLE_DICTIONARY"), (("RLE", "RLE_DICTIONARY"), ("RLE", "RLE_DICTIONARY")), (1000, 1000), 3.0),
    (("DELTA_BINARY_PACKED", "RLE"), (("DELTA_BINARY_PACKED", "RLE"),), (None,), 1.2),
    (("PLAIN", "RLE", "RLE_DICTIONARY"), (("RLE_DICTIONARY",), ("PLAIN",)), (10, None), 1.05),
)
GROUP_ROWS = 5000
KINDS = {"time": ("INT64", "TIMESTAMP(MICROS)")}


def laid_out(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    """Rows as report.joined() gives them: the rule's layout beside statistics of the whole table."""
    stats = profile(whole(spark, f"{sf_dir}/{name}.parquet", list(columns)), exact=True).drop("file")
    rows = []
    for p, (c, kind) in enumerate(columns.items()):
        physical, logical = KINDS.get(kind, (kind, None))
        encodings, groups, dictionary, ratio = CASES[p % len(CASES)]
        rows.append((name, p, c, physical, logical, CODECS[p % len(CODECS)], list(encodings), [list(g) for g in groups], list(dictionary), ratio))
    layout = spark.createDataFrame(rows, "file string, position int, column string, physical string, logical string, codec string, encodings array<string>, rg_encodings array<array<string>>, rg_dict_bytes array<long>, ratio double")
    size = F.when(F.col("physical") == "BYTE_ARRAY", F.round(F.col("len_mean") * (F.col("n") - F.col("nulls")))).when(F.col("physical") == "INT32", 4.0 * F.col("n")).otherwise(8.0 * F.col("n"))
    return layout.join(stats, "column").withColumns({"uncompressed": size.cast("long"), "file_rows": F.col("n"), "sample_fraction": F.lit(1.0)})


def queries(tables: dict[str, dict[str, str]]) -> dict:
    def every(make):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            parts = [make(recommend(laid_out(spark, sf_dir, n, tables[n]), "duckdb", "balanced")).withColumn("table_name", F.lit(n)) for n in NAMES]
            return reduce(DataFrame.unionAll, parts)

        return query

    column = lambda: F.col("column").alias("column_name")

    def row_group_advisory(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Files of two row groups, of 1000 and 3000 bytes for each row of the table."""
        files = None
        for n in tables:
            one = spark.read.parquet(f"{sf_dir}/{n}.parquet").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("file"), F.lit(2).alias("row_groups"), F.array(F.col("n") * 1000, F.col("n") * 3000).alias("rg_bytes"))
            files = one if files is None else files.union(one)
        out = row_group_advice(files, "duckdb")
        return out.select(F.col("file").alias("table_name"), *(F.round(c, 6).alias(c) for c in ("avg_mb", "min_mb", "max_mb")), "verdict", "within")

    def rg_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Row groups of GROUP_ROWS rows of lineitem; a column is a dictionary there if the number of its different values is even."""
        columns = list(tables["lineitem"])
        counts = group_counts(numbered(spark, f"{sf_dir}/lineitem.parquet", columns), columns, GROUP_ROWS)
        name = F.element_at(F.array(*map(F.lit, columns)), F.col("i") + 1)
        kinds = counts.select(name.alias("column"), "g", (F.col("distinct_count") % 2 == 0).alias("even"))
        sets = kinds.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "even"))), lambda x: F.array(F.when(x["even"], F.lit("RLE_DICTIONARY")).otherwise(F.lit("PLAIN")))).alias("rg_encodings"))
        runs = sets.select(column(), F.explode(islands()).alias("r"))
        return runs.select("column_name", F.col("r.from").cast("long").alias("from_group"), F.col("r.to").cast("long").alias("to_group"), F.col("r.encodings").alias("encoding"))

    def engine_support(spark: SparkSession, sf_dir: str) -> DataFrame:
        """What Spark asks for to read each recommended encoding of orders."""
        rows = recommend(laid_out(spark, sf_dir, "orders", tables["orders"]), "spark", "balanced")
        known = encoding_support(spark).where("engine = 'spark'").select("encoding", "min_version")
        return rows.join(known, "encoding", "left").select(column(), "encoding", "min_version")

    def codec_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Columns of customer by engine, with whether the codec recommended for small files is supported."""
        parts = []
        for engine in ("spark", "duckdb", "polars", "clickhouse", "pandas"):
            rows = recommend(laid_out(spark, sf_dir, "customer", tables["customer"]), engine, "size")
            known = codec_support(spark).where(F.col("engine") == engine).select(F.col("codec").alias("rec_codec"), "supported", "min_version")
            parts.append(rows.join(known, "rec_codec").groupBy("rec_codec", "supported", "min_version").agg(F.count(F.lit(1)).alias("columns")).select(F.lit(engine).alias("engine"), "rec_codec", "supported", "min_version", "columns"))
        return reduce(DataFrame.unionAll, parts)

    return {
        "impact_stars": every(lambda r: r.select(column(), F.round("share", 6).alias("share"), "stars")),
        "diagnose": every(lambda r: r.select(column(), "status", "present_encoding", "effectively_match", F.size("fallback_groups").cast("long").alias("n_fallback"), "largest_dict_bytes")),
        "size_prediction": every(lambda r: predicted(r).select(F.round("size_reduction_pct", 6).alias("size_reduction_pct"), F.round("read_speedup", 6).alias("read_speedup"), "overall_confidence")),
        "size_range": every(lambda r: estimated_sizes(predicted(r)).select("low", "high")),
        "health": every(lambda r: health(r).drop("file")),
        "mode_codec": every(lambda r: mode_codec(r).drop("file")),
        "open_columns": every(lambda r: open_only(r).select(column(), "stars")),
        "row_group_advisory": row_group_advisory,
        "rg_islands": rg_islands,
        "encoding_support": engine_support,
        "codec_support": codec_choice,
    }


def quoted(values) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in values) + "]"


def oracle_sql(tables: dict[str, dict[str, str]], statistics_sql, rule: str, encoding: str, confidence: str) -> dict[str, str]:
    """statistics_sql(name) opens a WITH that ends in stats; rule, encoding and confidence are expressions over it."""

    def rows(name: str) -> str:
        """A WITH that ends in r: one row per column with all that the queries need."""
        values = []
        for p, c in enumerate(tables[name]):
            e, _, d, ratio = CASES[p % len(CASES)]
            # Groups whose dictionary is full while plain pages follow it, and plain groups beside others with a dictionary.
            full = [i for i, (g, b) in enumerate(zip(CASES[p % len(CASES)][1], d, strict=True)) if "PLAIN" in g and "RLE_DICTIONARY" in g and (b or 0) >= 900_000]
            coded = [i for i, g in enumerate(CASES[p % len(CASES)][1]) if "RLE_DICTIONARY" in g]
            bare = [i for i, g in enumerate(CASES[p % len(CASES)][1]) if "PLAIN" in g and "RLE_DICTIONARY" not in g]
            fallback = len(full) or (len(bare) if coded and bare else 0)
            values.append(f"('{c}', {p}, '{CODECS[p % len(CODECS)]}', {quoted(e)}, {fallback}, {max((x for x in d if x is not None), default='NULL')}, {ratio})")
        return f"""{statistics_sql(name)},
ruled AS (SELECT *, {rule} AS rule FROM stats), coded AS (SELECT *, {encoding} AS encoding, {confidence} AS confidence FROM ruled),
layout(column_name, position, codec, encodings, n_fallback, largest, ratio) AS (VALUES {', '.join(values)}),
sized AS (SELECT *, CASE physical WHEN 'BYTE_ARRAY' THEN round(raw_mean * (n - nulls)) WHEN 'INT32' THEN 4 * n ELSE 8 * n END::BIGINT AS uncompressed, split_part(codec, ':', 1) = 'ZSTD' AS same,
  list_contains(encodings, encoding) AS present, list_contains(encodings, 'RLE_DICTIONARY') AS dictionary, list_contains(encodings, 'DELTA_BINARY_PACKED') AS delta FROM coded JOIN layout USING (column_name)),
shared AS (SELECT *, uncompressed / sum(uncompressed) OVER () AS share FROM sized),
r AS (SELECT *, CASE WHEN present AND same THEN 1 WHEN present THEN CASE WHEN share >= 0.1 THEN 3 WHEN share >= 0.04 THEN 2 ELSE 1 END WHEN share >= 0.1 THEN 5 WHEN share >= 0.04 THEN 4 WHEN share >= 0.01 THEN 3 ELSE 2 END AS stars,
  CASE WHEN n_fallback > 0 THEN 'FallbackDictionary' WHEN encoding = 'RLE_DICTIONARY' AND NOT dictionary THEN 'Mismatch' WHEN uncompressed >= 10000 AND delta AND encoding <> 'DELTA_BINARY_PACKED' AND ratio < 1.5 THEN 'IneffectiveEncoding'
    WHEN present AND encoding <> 'RLE' AND same THEN 'Match' ELSE 'Mismatch' END AS status,
  CASE WHEN list_contains(encodings, 'PLAIN') AND NOT dictionary AND NOT delta THEN CASE rule WHEN 'RleDictionary' THEN CASE WHEN raw_ratio < 0.001 THEN 10.0 WHEN raw_ratio < 0.01 THEN 5.0 ELSE 2.0 END WHEN 'DeltaMonotonic' THEN 3.0 WHEN 'ByteStreamSplit' THEN 1.15
    WHEN 'DeltaByteArray' THEN 2.5 WHEN 'DeltaLengthByteArray' THEN 1.05 ELSE 1.25 END ELSE 1.15 END AS factor, '{name}' AS table_name FROM shared)"""

    def every(select: str) -> str:
        return " UNION ALL ".join(f"SELECT * FROM ({rows(n)}\n{select})" for n in NAMES)

    match = "(status = 'Match' OR (present AND same))"
    guess = "SELECT table_name, least(90.0, 100 * sum(share * (1 - 1 / factor))) AS pct, max(CASE confidence WHEN 'Low' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END) AS worst FROM r GROUP BY table_name"
    advice = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in tables)
    flags = " UNION ALL ".join(f"SELECT '{c}' AS column_name, g, CASE WHEN count(DISTINCT {c}) % 2 = 0 THEN 'RLE_DICTIONARY' ELSE 'PLAIN' END AS encoding FROM l GROUP BY g" for c in tables["lineitem"])
    size = {e: ("SNAPPY", "NULL") if e == "spark" else ("ZSTD", "NULL") for e in ("spark", "duckdb", "polars", "clickhouse", "pandas")}
    return {
        "impact_stars": every("SELECT column_name, round(share, 6) AS share, stars, table_name FROM r"),
        "diagnose": every(f"SELECT column_name, status, coalesce(list_filter(encodings, lambda x: x NOT IN ('PLAIN', 'RLE'))[1], encodings[1]) AS present_encoding, {match} AS effectively_match, n_fallback::BIGINT AS n_fallback, largest::BIGINT AS largest_dict_bytes, table_name FROM r"),
        "size_prediction": every(f"SELECT round(pct, 6) AS size_reduction_pct, round(1 + 0.7 * pct / 100, 6) AS read_speedup, CASE worst WHEN 2 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END AS overall_confidence, table_name FROM ({guess})"),
        "size_range": every(f"SELECT floor(pct * 0.5)::BIGINT AS low, ceil(pct * 1.5)::BIGINT AS high, table_name FROM ({guess})"),
        "health": every("SELECT count(*) FILTER (status = 'Match')::BIGINT AS matched, count(*) FILTER (status = 'FallbackDictionary')::BIGINT AS fallbacks, count(*) FILTER (status = 'IneffectiveEncoding')::BIGINT AS weak, count(*) FILTER (status = 'Mismatch')::BIGINT AS mismatches, table_name FROM r GROUP BY table_name"),
        "mode_codec": every("SELECT codec AS mode_codec, table_name FROM (SELECT codec, table_name, row_number() OVER (ORDER BY count(*) DESC, min(position)) AS k FROM r GROUP BY codec, table_name) WHERE k = 1"),
        "open_columns": every(f"SELECT column_name, stars, table_name FROM r WHERE NOT {match}"),
        "row_group_advisory": f"SELECT table_name, round(n * 2000 / 1048576.0, 6) AS avg_mb, round(n * 1000 / 1048576.0, 6) AS min_mb, round(n * 3000 / 1048576.0, 6) AS max_mb, CASE WHEN n * 2000 < 64 * 1048576 THEN 'below' WHEN n * 2000 > 128 * 1048576 THEN 'above' ELSE 'within' END AS verdict, n * 2000 BETWEEN 64 * 1048576 AND 128 * 1048576 AS within FROM ({advice})",
        "rg_islands": f"WITH l AS (SELECT *, (row_number() OVER () - 1) // {GROUP_ROWS} AS g FROM lineitem), f AS ({flags}), m AS (SELECT *, lag(encoding) OVER w IS DISTINCT FROM encoding AS new FROM f WINDOW w AS (PARTITION BY column_name ORDER BY g)), k AS (SELECT *, sum(new::INT) OVER (PARTITION BY column_name ORDER BY g) AS run FROM m), i AS (SELECT column_name, run, min(g)::BIGINT AS from_group, max(g)::BIGINT AS to_group, any_value(encoding) AS encoding FROM k GROUP BY ALL) SELECT column_name, from_group, to_group, encoding FROM i WHERE column_name IN (SELECT column_name FROM i GROUP BY 1 HAVING count(*) > 1)",
        "encoding_support": f"{rows('orders')} SELECT column_name, encoding, CASE encoding WHEN 'DELTA_BINARY_PACKED' THEN '3.2.0' WHEN 'DELTA_BYTE_ARRAY' THEN '3.3.0' WHEN 'DELTA_LENGTH_BYTE_ARRAY' THEN '3.3.0' END AS min_version FROM r",
        "codec_support": " UNION ALL ".join(f"SELECT '{e}' AS engine, '{c}' AS rec_codec, true AS supported, {v}::VARCHAR AS min_version, count(*)::BIGINT AS columns FROM (DESCRIBE customer)" for e, (c, v) in size.items()),
    }
