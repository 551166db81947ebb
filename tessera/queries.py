"""Queries over the given tables and the SQL that gives the same rows.

A table's profile is one query per table and statistic; the SQL is made from the list of columns
below. Lists of columns are fixed values.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import layouts
from tessera.operators.advise import sort_candidates
from tessera.operators.bench import bench
from tessera.operators.profile import distinct_counts, entropy, profile
from tessera.operators.sample import whole
from tessera.operators.views import encoding_breakdown, with_badges
from tessera.report import profiled, recommend
from tessera.sources.footer import column_names, column_summary, file_summary, footers

#: Columns by table: name and physical type, with "time" for timestamps.
TABLES = {
    "region": {"r_regionkey": "INT32", "r_name": "BYTE_ARRAY"},
    "nation": {"n_nationkey": "INT32", "n_name": "BYTE_ARRAY", "n_regionkey": "INT32"},
    "customer": {"c_custkey": "INT64", "c_name": "BYTE_ARRAY", "c_nationkey": "INT32", "c_acctbal": "DOUBLE", "c_mktsegment": "BYTE_ARRAY"},
    "supplier": {"s_suppkey": "INT64", "s_name": "BYTE_ARRAY", "s_nationkey": "INT32", "s_acctbal": "DOUBLE"},
    "part": {"p_partkey": "INT64", "p_name": "BYTE_ARRAY", "p_brand": "BYTE_ARRAY", "p_type": "BYTE_ARRAY", "p_size": "INT32", "p_retailprice": "DOUBLE"},
    "orders": {"o_orderkey": "INT64", "o_custkey": "INT64", "o_orderstatus": "BYTE_ARRAY", "o_totalprice": "DOUBLE", "o_orderdate": "time", "o_orderpriority": "BYTE_ARRAY"},
    "lineitem": {"l_orderkey": "INT64", "l_partkey": "INT64", "l_suppkey": "INT64", "l_linenumber": "INT32", "l_quantity": "DOUBLE", "l_extendedprice": "DOUBLE", "l_discount": "DOUBLE", "l_tax": "DOUBLE", "l_returnflag": "BYTE_ARRAY", "l_linestatus": "BYTE_ARRAY", "l_shipdate": "time"},
    "events": {"event_id": "INT64", "ts": "time", "user_id": "INT64", "event_type": "BYTE_ARRAY", "value": "DOUBLE", "props": "BYTE_ARRAY"},
}


def at(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def statistics(spark: SparkSession, sf_dir: str, name: str, counted: bool = True) -> DataFrame:
    """profile() of a whole table, with distinct values counted one by one or, without counted, not at all."""
    return profile(whole(spark, at(sf_dir, name), list(TABLES[name])), True, counted)


def rounded(df: DataFrame, *names: str) -> list:
    return [F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns]


STAT_COLUMNS = {
    "null_profile": ("n", "nulls", "null_fraction"),
    "cardinality": ("distinct_count", "cardinality_ratio"),
    "monotonicity": ("monotonicity",),
    "string_monotonicity": ("string_monotonicity",),
    "run_length": ("run_length",),
    "string_length": ("len_min", "len_max", "len_mean", "len_stddev"),
    "patterns": ("uuid_detected", "json_detected"),
}
REALS = ("null_fraction", "cardinality_ratio", "monotonicity", "string_monotonicity", "run_length", "len_mean", "len_stddev")


def statistic_query(stat: str, name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = statistics(spark, sf_dir, name, counted=stat == "cardinality").select("column", *STAT_COLUMNS[stat])
        return out.select(*rounded(out, *REALS)).withColumnRenamed("column", "column_name")

    return query


def statistics_sql(name: str) -> str:
    """One row per column with all statistics, as `stats`."""
    parts = []
    for c, kind in TABLES[name].items():
        text, ordered_kind = kind == "BYTE_ARRAY", kind in ("INT32", "INT64", "time")
        size = f"strlen({c})" if text else "NULL::BIGINT"
        up = f"count(*) FILTER ({c} IS NOT NULL AND p IS NOT NULL AND {c} >= p)::DOUBLE / nullif(count(*) FILTER ({c} IS NOT NULL AND p IS NOT NULL), 0)"
        same = f"coalesce(count(*) FILTER ({c} = p)::DOUBLE / nullif(count(*) FILTER ({c} IS NOT NULL AND p IS NOT NULL), 0), 0.0)"
        first = f"(SELECT {c} AS v, row_number() OVER (ORDER BY rn) AS k FROM {name}_n WHERE {c} IS NOT NULL)"
        uuid = f"coalesce((SELECT avg(regexp_full_match(v, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}')::INT) >= 0.9 FROM {first} WHERE k <= 1000), false)" if text else "false"
        json = f"coalesce((SELECT avg((ltrim(v, ' \t\n\r') LIKE '{{%' OR ltrim(v, ' \t\n\r') LIKE '[%')::INT) >= 0.8 FROM {first} WHERE k <= 1000), false)" if text else "false"
        parts.append(
            f"SELECT '{c}' AS column_name, '{'INT64' if kind == 'time' else kind}' AS physical, {'true' if kind == 'time' else 'false'} AS is_time, count(*)::BIGINT AS n, (count(*) - count({c}))::BIGINT AS nulls, round((count(*) - count({c}))::DOUBLE / count(*), 6) AS null_fraction, "
            f"count(DISTINCT {c})::BIGINT AS distinct_count, count(DISTINCT {c})::DOUBLE / count({c}) AS raw_ratio, round(count(DISTINCT {c})::DOUBLE / count({c}), 6) AS cardinality_ratio, "
            f"{f'coalesce({up}, 0.0)' if ordered_kind else 'NULL::DOUBLE'} AS raw_mono, {f'round(coalesce({up}, 0.0), 6)' if ordered_kind else 'NULL::DOUBLE'} AS monotonicity, "
            f"{up if text else 'NULL::DOUBLE'} AS raw_text, {f'round({up}, 6)' if text else 'NULL::DOUBLE'} AS string_monotonicity, round({same}, 6) AS run_length, "
            f"min({size})::BIGINT AS len_min, max({size})::BIGINT AS len_max, avg({size}) AS raw_mean, round(avg({size}), 6) AS len_mean, round(stddev_pop({size}), 6) AS len_stddev, {uuid} AS uuid_detected, {json} AS json_detected "
            f"FROM (SELECT {c}, lag({c}) OVER (ORDER BY rn) AS p FROM {name}_n)"
        )
    body = "\nUNION ALL ".join(parts)
    return f"WITH {name}_n AS (SELECT *, row_number() OVER () AS rn FROM {name}),\nstats AS ({body})"


def statistic_sql(stat: str, name: str) -> str:
    return f"{statistics_sql(name)}\nSELECT column_name, {', '.join(STAT_COLUMNS[stat])} FROM stats"


RULE_SQL = """CASE WHEN physical = 'BOOLEAN' THEN 'BooleanRle'
  WHEN (physical IN ('INT32', 'INT64') OR is_time) AND raw_mono >= 0.9 THEN 'DeltaMonotonic'
  WHEN raw_ratio < 0.1 AND distinct_count * (CASE physical WHEN 'BYTE_ARRAY' THEN coalesce(raw_mean, 8) WHEN 'INT32' THEN 4 WHEN 'FLOAT' THEN 4 WHEN 'BOOLEAN' THEN 1 ELSE 8 END) < 524288 THEN 'RleDictionary'
  WHEN physical IN ('FLOAT', 'DOUBLE') AND raw_ratio > 0.5 THEN 'ByteStreamSplit'
  WHEN physical = 'BYTE_ARRAY' AND uuid_detected THEN 'PlainUuid'
  WHEN physical = 'BYTE_ARRAY' AND raw_ratio >= 0.1 AND NOT uuid_detected AND NOT json_detected AND coalesce(raw_text, -1) >= 0.8 AND coalesce(raw_mean, 1e9) <= 50 THEN 'DeltaByteArray'
  WHEN physical = 'BYTE_ARRAY' AND raw_ratio >= 0.1 AND NOT uuid_detected AND NOT json_detected AND coalesce(raw_mean, 1e9) <= 50 THEN 'DeltaLengthByteArray'
  ELSE 'PlainDefault' END"""
ENCODING_SQL = "CASE rule WHEN 'BooleanRle' THEN 'RLE' WHEN 'DeltaMonotonic' THEN 'DELTA_BINARY_PACKED' WHEN 'RleDictionary' THEN 'RLE_DICTIONARY' WHEN 'ByteStreamSplit' THEN 'BYTE_STREAM_SPLIT' WHEN 'DeltaByteArray' THEN 'DELTA_BYTE_ARRAY' WHEN 'DeltaLengthByteArray' THEN 'DELTA_LENGTH_BYTE_ARRAY' ELSE 'PLAIN' END"
CONFIDENCE_SQL = "CASE WHEN rule = 'RleDictionary' AND raw_ratio BETWEEN 0.08 AND 0.12 OR rule = 'DeltaByteArray' AND raw_text >= 0.64 AND raw_text < 0.96 THEN 'Medium' WHEN n >= 100000 THEN 'High' ELSE 'Medium' END"


def rows_of(spark: SparkSession, sf_dir: str, name: str, engine: str = "duckdb", priority: str = "balanced", explain: str = "brief") -> DataFrame:
    return recommend(profiled(spark, at(sf_dir, name), None, exact=True), engine, priority, explain)


def rules_query(name: str):
    return lambda spark, sf_dir: rows_of(spark, sf_dir, name).select(F.col("column").alias("column_name"), "rule", "encoding", "confidence")


def rules_sql(name: str) -> str:
    return f"{statistics_sql(name)},\nruled AS (SELECT *, {RULE_SQL} AS rule FROM stats)\nSELECT column_name, rule, {ENCODING_SQL} AS encoding, {CONFIDENCE_SQL} AS confidence FROM ruled"


def codec_query(engine: str, priority: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows_of(spark, sf_dir, "orders", engine, priority).select(F.col("column").alias("column_name"), "encoding", "rec_codec", F.col("rec_level").cast("long").alias("rec_level"), F.size("caveats").cast("long").alias("n_caveats"), "engine_compat")

    return query


def codec_sql(engine: str, priority: str) -> str:
    codec, level = ("SNAPPY", "NULL") if engine == "spark" else ("LZ4", "NULL") if priority == "speed" else ("ZSTD", "6" if priority == "size" else "3")
    notes = "1 + (encoding = 'BYTE_STREAM_SPLIT')::INT" if engine == "spark" else "(encoding = 'DELTA_BINARY_PACKED')::INT" if priority == "speed" else "0"
    compat = "CASE WHEN encoding = 'DELTA_BINARY_PACKED' THEN 'spark>=3.2.0' END" if engine == "spark" else "NULL::VARCHAR"
    return f"{statistics_sql('orders')},\nruled AS (SELECT *, {RULE_SQL} AS rule FROM stats), coded AS (SELECT column_name, {ENCODING_SQL} AS encoding FROM ruled)\nSELECT column_name, encoding, '{codec}' AS rec_codec, {level}::BIGINT AS rec_level, ({notes})::BIGINT AS n_caveats, {compat} AS engine_compat FROM coded"


def json_pattern_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(whole(spark, at(sf_dir, "events"), ["props"]), exact=True, counted=False).select(F.col("column").alias("column_name"), "uuid_detected", "json_detected")


def uuid_pattern_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.md5(F.col("o_orderkey").cast("string"))
    rows = whole(spark, at(sf_dir, "orders"), ["o_orderkey"]).select(F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)).alias("id"), "__file", "__row")
    return profile(rows, exact=True, counted=False).select(F.col("column").alias("column_name"), "uuid_detected", "json_detected")


def byte_entropy_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of the bytes of SHA-256 sums, by priority of the order."""
    rows = spark.read.parquet(at(sf_dir, "orders")).select("o_orderpriority", F.explode(F.regexp_extract_all(F.sha2(F.col("o_orderkey").cast("string"), 256), F.lit("(..)"), F.lit(1))).alias("b"))
    return entropy(rows.groupBy("o_orderpriority", "b").count(), "o_orderpriority").select("o_orderpriority", F.round("byte_entropy", 6).alias("byte_entropy"))


def boolean_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a derived boolean column."""
    rows = whole(spark, at(sf_dir, "lineitem"), ["l_returnflag"]).select((F.col("l_returnflag") == "R").alias("returned"), "__file", "__row")
    return profile(rows, exact=True).select(F.col("column").alias("column_name"), "n", "distinct_count", F.round("run_length", 6).alias("run_length"))


def approximate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sketch comes within 5 % of the exact count, by column."""
    columns = list(TABLES["lineitem"])
    rows = whole(spark, at(sf_dir, "lineitem"), columns)
    counts = lambda exact, name: distinct_counts(rows, columns, None, exact).select("i", F.col("distinct_count").alias(name))
    both = counts(True, "exact").join(counts(False, "guess"), "i")
    name = F.element_at(F.array(*map(F.lit, columns)), F.col("i") + 1)
    return both.select(name.alias("column_name"), "exact", (F.abs(F.col("guess") - F.col("exact")) <= 0.05 * F.col("exact") + 1).alias("close"))


def footer_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = column_summary(footers(spark, at(sf_dir, "lineitem")))
    return out.select(F.col("column").alias("column_name"), "physical", F.substring_index("codec", ":", 1).alias("codec"), F.col("compressed").alias("compressed_bytes"), F.col("uncompressed").alias("uncompressed_bytes"), F.col("total_nulls").alias("null_count"), "statistics_available")


def footer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = None
    for name in TABLES:
        one = file_summary(footers(spark, at(sf_dir, name))).select(F.lit(name).alias("table_name"), F.col("file_rows"), F.col("row_groups").cast("long").alias("row_groups"), F.aggregate("rg_rows", F.lit(0).cast("long"), lambda a, b: a + b).alias("sum_rows"))
        rows = one if rows is None else rows.union(one)
    return rows


def bench_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_badges(bench(spark, at(sf_dir, "events"), "event_type")).select("column", "encoding", "codec", "level", "bytes", "ratio", "best_bytes")


def rewrite_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of orders after an exact rewrite, against the input."""
    from tessera.sources.rewrite import place_of, read_exact, rewrite

    folder = spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/tessera"  # without a shared folder: local tests
    system, at_folder = place_of(folder)
    system.create_dir(at_folder)
    target = f"{folder.rstrip('/')}/roundtrip-{uuid.uuid4().hex}.parquet"
    result = rewrite(spark, at(sf_dir, "orders"), target, "spark", "balanced")
    made = read_exact(spark, target, ["o_orderkey", "o_totalprice"], "o_orderkey long, o_totalprice double")
    return made.agg(F.lit(result["rows"]).cast("long").alias("written"), F.count(F.lit(1)).alias("n_rows"), F.sum("o_orderkey").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def explain_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir, "orders", explain="full")
    return rows.select(F.col("column").alias("column_name"), F.explode("rule_trace").alias("t")).select("column_name", F.col("t.rule").alias("rule"), F.col("t.evaluated").alias("evaluated"), F.col("t.fired").alias("fired"))


def explain_sql() -> str:
    order = "['BooleanRle', 'DeltaMonotonic', 'RleDictionary', 'ByteStreamSplit', 'PlainUuid', 'DeltaByteArray', 'DeltaLengthByteArray', 'PlainDefault']"
    return f"{statistics_sql('orders')},\nruled AS (SELECT column_name, {RULE_SQL} AS rule FROM stats), every_rule AS (SELECT unnest({order}) AS rule, unnest(range(1, 9)) AS place)\nSELECT column_name, e.rule, e.place <= list_position({order}, r.rule) AS evaluated, e.rule = r.rule AS fired FROM ruled r CROSS JOIN every_rule e"


def queries() -> dict:
    out = {}
    for name in TABLES:
        for stat in STAT_COLUMNS:
            out[f"{stat}_{name}"] = statistic_query(stat, name)
        out[f"encoding_rules_{name}"] = rules_query(name)
    for engine, priority in (("duckdb", "balanced"), ("duckdb", "size"), ("duckdb", "speed"), ("spark", "size"), ("clickhouse", "speed")):
        out[f"codec_{priority}_{engine}"] = codec_query(engine, priority)
    out |= {
        "json_pattern_events": json_pattern_events, "uuid_pattern_derived": uuid_pattern_derived, "byte_entropy_derived": byte_entropy_derived, "boolean_derived": boolean_rule, "approximate_distinct": approximate_distinct,
        "footer_columns": footer_columns, "footer_files": footer_files, "column_names": lambda s, d: column_names(footers(s, at(d, "customer"))).select("position", F.col("column").alias("column_name")),
        "encoding_breakdown": lambda s, d: encoding_breakdown(rows_of(s, d, "orders")),
        "sort_candidates": lambda s, d: sort_candidates(rows_of(s, d, "orders")).select(F.col("column").alias("column_name"), F.round("monotonicity", 6).alias("monotonicity")),
        "bench_grid": bench_grid, "rewrite_roundtrip": rewrite_roundtrip, "explain_trace": explain_trace,
    }
    return out | layouts.queries(TABLES)


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in TABLES:
        for stat in STAT_COLUMNS:
            out[f"{stat}_{name}"] = statistic_sql(stat, name)
        out[f"encoding_rules_{name}"] = rules_sql(name)
    for engine, priority in (("duckdb", "balanced"), ("duckdb", "size"), ("duckdb", "speed"), ("spark", "size"), ("clickhouse", "speed")):
        out[f"codec_{priority}_{engine}"] = codec_sql(engine, priority)
    flags = ", ".join(f"('{c}', (SELECT count(DISTINCT {c}) FROM lineitem)::BIGINT)" for c in TABLES["lineitem"])
    files = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*)::BIGINT AS file_rows, 1::BIGINT AS row_groups, count(*)::BIGINT AS sum_rows FROM {t}" for t in TABLES)
    out |= {
        "json_pattern_events": "SELECT 'props' AS column_name, false AS uuid_detected, avg((ltrim(props) LIKE '{%' OR ltrim(props) LIKE '[%')::INT) >= 0.8 AS json_detected FROM (SELECT props FROM (SELECT props, row_number() OVER () AS rn FROM events) WHERE props IS NOT NULL ORDER BY rn LIMIT 1000)",
        "uuid_pattern_derived": "WITH u AS (SELECT md5(o_orderkey::VARCHAR) AS h, row_number() OVER () AS rn FROM orders), t AS (SELECT concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS v FROM u ORDER BY rn LIMIT 1000) SELECT 'id' AS column_name, avg(regexp_full_match(v, '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}')::INT) >= 0.9 AS uuid_detected, false AS json_detected FROM t",
        "byte_entropy_derived": "WITH h AS (SELECT o_orderpriority, sha256(o_orderkey::VARCHAR) AS h FROM orders), b AS (SELECT o_orderpriority, substr(h, 2 * i + 1, 2) AS b, count(*)::DOUBLE AS c FROM h, range(32) r(i) GROUP BY ALL), s AS (SELECT *, c / sum(c) OVER (PARTITION BY o_orderpriority) AS p FROM b) SELECT o_orderpriority, round(-sum(p * log2(p)), 6) AS byte_entropy FROM s GROUP BY 1",
        "boolean_derived": "WITH r AS (SELECT l_returnflag = 'R' AS v, row_number() OVER () AS rn FROM lineitem), l AS (SELECT v, lag(v) OVER (ORDER BY rn) AS p FROM r) SELECT 'returned' AS column_name, count(*)::BIGINT AS n, count(DISTINCT v)::BIGINT AS distinct_count, round(count(*) FILTER (v = p)::DOUBLE / count(*) FILTER (v IS NOT NULL AND p IS NOT NULL), 6) AS run_length FROM l",
        "approximate_distinct": f"SELECT column_name, exact, true AS close FROM (VALUES {flags}) t(column_name, exact)",
        "footer_files": files,
        "column_names": "SELECT (row_number() OVER () - 1)::INT AS position, column_name FROM (DESCRIBE customer)",
        "explain_trace": explain_sql(),
        "encoding_breakdown": f"{statistics_sql('orders')},\nruled AS (SELECT *, {RULE_SQL} AS rule FROM stats), coded AS (SELECT {ENCODING_SQL} AS encoding FROM ruled) SELECT encoding, count(*)::BIGINT AS columns FROM coded GROUP BY 1",
        "sort_candidates": f"{statistics_sql('orders')} SELECT column_name, monotonicity FROM stats WHERE raw_mono > 0.95 AND physical = 'INT64'",
        "rewrite_roundtrip": "SELECT count(*)::BIGINT AS written, count(*)::BIGINT AS n_rows, sum(o_orderkey)::BIGINT AS keys, round(sum(o_totalprice), 2) AS total FROM orders",
    }
    return out | layouts.oracle_sql(TABLES, statistics_sql, RULE_SQL, ENCODING_SQL, CONFIDENCE_SQL)
