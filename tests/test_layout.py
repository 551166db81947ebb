"""Statistics, rules, diagnoses and rewriting on small files with known answers."""

import json

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera import cli, queries
from tessera.functions import scalars
from tessera.operators.advise import row_group_advice
from tessera.operators.bench import bench
from tessera.operators.diagnose import islands
from tessera.operators.profile import distinct_counts, group_counts, profile
from tessera.operators.sample import numbered, sample, sample_bytes, whole
from tessera.plans.rules import override_codec
from tessera.report import profiled, recommend, retune, tune
from tessera.sources.footer import column_summary, file_summary, footers, footers_of_bytes, info
from tessera.sources.rewrite import rewrite, rewrite_bytes
from tessera.streaming.progress import follow

SF = "/root/testdata/sf0.001"


def written(folder, name="t", group=None, **columns):
    path = f"{folder}/{name}.parquet"
    table = pa.table(columns)
    pq.write_table(table, path, row_group_size=group or max(1, table.num_rows))
    return path


def stats_of(spark, path, **more):
    return {r.column: r for r in profile(sample(spark, path, **more), exact=True).collect()}


def test_order_and_nulls(spark, tmp_path):
    path = written(tmp_path, up=pa.array([1, 2, 3, 4]), mixed=pa.array([1, None, 3, None]), pair=pa.array([1, None, 3, 4]), same=[1, 1, 1, 1], text=["ant", "bear", "camel", "donkey"], down=["four", "five", "", "a"][:2] + ["a", ""], flag=[True, False, True, True], real=[1.0, 1.0, 2.0, None])
    s = stats_of(spark, path)
    assert s["up"].monotonicity == 1.0 and s["mixed"].monotonicity == 0.0 and s["pair"].monotonicity == 1.0
    assert s["mixed"].null_fraction == 0.5 and s["same"].run_length == 1.0
    assert s["text"].string_monotonicity == 1.0 and s["down"].string_monotonicity == 0.0 and s["up"].string_monotonicity is None
    assert s["flag"].distinct_count == 2 and s["flag"].monotonicity is None and s["real"].distinct_count == 2
    assert (s["text"].len_min, s["text"].len_max, s["text"].len_mean) == (3, 6, 4.5)


def test_one_text_has_no_order(spark, tmp_path):
    assert stats_of(spark, written(tmp_path, a=["x"]))["a"].string_monotonicity is None


def test_pairs_across_splits(spark, tmp_path):
    """Many batches and splits of one file: no pair is lost or counted twice."""
    n = 30_000
    values = [i if i % 7000 else None if i == 21_000 else 0 for i in range(n)]
    path = written(tmp_path, group=1000, a=pa.array(values), s=[f"{i // 3:05d}" for i in range(n)], f=[float("nan") if i % 2 else -0.0 if i % 4 else 0.0 for i in range(n)], b=[i % 3 == 0 for i in range(n)])
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    try:
        assert whole(spark, path).rdd.getNumPartitions() > 3
        s = {r.column: r for r in profile(whole(spark, path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    pairs = [(x, y) for x, y in zip(values, values[1:]) if x is not None and y is not None]
    assert s["a"].n == n and s["a"].nulls == 1 and s["a"].monotonicity == pytest.approx(sum(y >= x for x, y in pairs) / len(pairs))
    assert s["s"].string_monotonicity == 1.0 and s["s"].run_length == pytest.approx((n - n // 3) / (n - 1), abs=1e-4) and s["s"].distinct_count == 10_000
    assert s["f"].distinct_count == 2 and s["f"].run_length == 0.0 and s["b"].monotonicity is None and s["b"].distinct_count == 2


def test_whole_files_and_equal_names(spark, tmp_path):
    """All row groups count; files of one name in different folders stay apart."""
    path = written(tmp_path, group=100, a=list(range(1000)))
    assert profile(whole(spark, path)).first().n == 1000 and profile(sample(spark, path)).first().n == 100
    for k, n in ((1, 3), (2, 4)):
        (tmp_path / "d" / f"k={k} +x").mkdir(parents=True)
        written(tmp_path / "d" / f"k={k} +x", "part-0", a=list(range(n)))
    assert sorted(r.n for r in profile(sample(spark, f"{tmp_path}/d", ["a"])).collect()) == [3, 4]
    rows = profiled(spark, f"{tmp_path}/d").where("column = 'a'").collect()
    assert sorted((r.n, r.file_rows, r.distinct_count) for r in rows) == [(3, 3, 3), (4, 4, 4)]


def test_sketch_by_column_and_file(spark, tmp_path):
    n = 60_000
    written(tmp_path, "many", a=list(range(n)), sparse=pa.array([i if i % 100 == 0 else None for i in range(n)]))
    written(tmp_path, "few", a=[1, 2, 2], sparse=pa.array([None, None, None], pa.int64()))
    got = {(r.file.rsplit("/", 1)[-1], r.column): (r.distinct_method, r.distinct_count) for r in profile(whole(spark, str(tmp_path))).collect()}
    assert got["few.parquet", "a"] == ("exact", 2) and got["many.parquet", "sparse"] == ("exact", 600) and got["few.parquet", "sparse"] == ("exact", 0)
    method, count = got["many.parquet", "a"]
    assert method == "hyperloglog" and abs(count - n) < 0.05 * n


def test_nothing_is_made_of_a_file_name_for_each_row(spark, tmp_path):
    rows = whole(spark, written(tmp_path, a=[1, 2, 2], b=pa.array([None, -0.0, float("nan")])))
    for exact in (True, False):
        counts = distinct_counts(rows, ["a", "b"], None, exact)
        plan = counts._jdf.queryExecution().optimizedPlan().toString()
        assert "_metadata" in plan and "regexp_replace" not in plan and "url_decode" not in plan.lower() and "hyperloglogplusplus" not in plan.lower()
        assert sorted((r.i, r.distinct_count) for r in counts.collect()) == [(0, 2), (1, 2)]
    assert profile(rows).first().file == f"{tmp_path}/t.parquet"


def test_values_are_counted_where_asked_for(spark):
    """Figures of order, lengths and patterns take one scan, and are the same with values counted."""
    rows = whole(spark, f"{SF}/events.parquet")
    drop = ("distinct_count", "distinct_method", "cardinality_ratio")
    assert sorted(map(str, profile(rows, True, False).drop(*drop).collect())) == sorted(map(str, profile(rows, True).drop(*drop).collect()))
    for stat in queries.STAT_COLUMNS:
        plan = queries.queries()[f"{stat}_lineitem"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert (plan.count("Relation [") == 1) == (stat != "cardinality")


def test_sketch_of_equal_and_missing_values(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit("f").alias("__file"), F.col("id").alias("__row"), (F.col("id") % 7000).alias("a"), F.when(F.col("id") % 2 == 0, F.lit(-0.0)).otherwise(0.0).alias("zero"), F.lit(None).cast("long").alias("none"), F.concat(F.lit("x"), F.col("id")).alias("s"))
    got = {r.i: r.distinct_count for r in distinct_counts(rows, ["a", "zero", "none", "s"], None, False).collect()}
    assert abs(got[0] - 7000) < 350 and abs(got[3] - n) < 0.05 * n and (got[1], got[2]) == (1, 0)


def test_patterns_and_entropy(spark, tmp_path):
    uuid = [f"{i:08x}-0000-4000-8000-{i:012X}" for i in range(50)]
    path = written(tmp_path, u=uuid, j=['  {"a": 1}'] * 40 + ["x"] * 10, b=pa.array([bytes([i]) for i in range(50)], pa.binary()))
    s = stats_of(spark, path)
    assert s["u"].uuid_detected and not s["u"].json_detected and s["j"].json_detected
    whole = written(tmp_path, "whole", b=pa.array([bytes([i]) for i in range(256)], pa.binary()), e=pa.array([b""] * 256, pa.binary()))
    s = stats_of(spark, whole)
    assert s["b"].byte_entropy == pytest.approx(8.0) and s["e"].byte_entropy == 0.0


def test_rules(spark, tmp_path):
    n = 2000
    path = written(tmp_path, id=list(range(n)), status=[["a", "bb", "ccc", "dd", "e"][i % 5] for i in range(n)], value=[(i * 7919 % n) / 7 for i in range(n)], flag=[i % 3 == 0 for i in range(n)], uuid=[f"{i * 7919 % n:08x}-0000-4000-8000-{i:012x}" for i in range(n)], sorted=[f"name{i:06d}" for i in range(n)], shuffled=[f"name{i * 7919 % n:06d}" for i in range(n)], long=["x" * 60 + str(i * 7919 % n) for i in range(n)])
    rows = {r.column: r for r in recommend(profiled(spark, path), "duckdb").collect()}
    assert {c: r.rule for c, r in rows.items()} == {"id": "DeltaMonotonic", "status": "RleDictionary", "value": "ByteStreamSplit", "flag": "BooleanRle", "uuid": "PlainUuid", "sorted": "DeltaByteArray", "shuffled": "DeltaLengthByteArray", "long": "PlainDefault"}
    assert rows["id"].rec_codec == "ZSTD" and rows["id"].rec_level == 3 and rows["sorted"].confidence == "Medium"
    full = recommend(profiled(spark, path), "spark", "size", "full").where("column = 'id'").first()
    assert full.rec_codec == "SNAPPY" and full.engine_compat == "spark>=3.2.0" and len(full.rule_trace) == 8
    assert [t.rule for t in full.rule_trace if t.fired] == ["DeltaMonotonic"] and [a.rule for a in full.alternatives] == ["BooleanRle"]
    assert full.raw_stats["cardinality_ratio"] == "1.0" and "byte_entropy" not in full.raw_stats


def test_all_null_column_goes_to_a_dictionary(spark, tmp_path):
    path = written(tmp_path, a=pa.array([None, None], pa.int64()))
    assert recommend(profiled(spark, path)).first().rule == "RleDictionary"


def test_noise_is_not_compressed(spark, tmp_path):
    import random

    r = random.Random(1)
    path = written(tmp_path, b=pa.array([r.randbytes(32) for _ in range(2000)], pa.binary()))
    row = recommend(profiled(spark, path), "duckdb").first()
    assert row.rec_codec == "UNCOMPRESSED" and row.caveats[0].severity == "Info"


def test_footer_fields(spark, tmp_path):
    path = written(tmp_path, group=3, a=[5, -1, 7, 2, None, 300], s=["x" * 50, "b", "c", "d", "e", "f"], f=[1.5, 2.25, 0.0, 3.0, 4.0, 5.0])
    rows = {r.column: r for r in column_summary(footers(spark, path)).collect()}
    assert (rows["a"].min_value, rows["a"].max_value, rows["a"].total_nulls) == ("-1", "300", 1)
    assert rows["s"].max_value == "x" * 39 + "…" and rows["f"].min_value == "0.0000" and rows["s"].logical == "STRING"
    assert len(rows["a"].rg_encodings) == 2 and rows["a"].codec == "SNAPPY" and rows["a"].statistics_available
    f = file_summary(footers(spark, path)).first()
    assert f.rg_rows == [3, 3] and f.file_rows == 6
    assert info(spark, path, [" a ", "nothing"]).count() == 1 and info(spark, path, []).count() == 3
    from_bytes = footers_of_bytes(spark.read.format("binaryFile").load(path)).drop("file")
    assert sorted(map(str, from_bytes.collect())) == sorted(map(str, footers(spark, path).drop("file").collect()))
    assert sample(spark, path, ["a"], 2).count() == 2 and sample(spark, path).count() == 3
    with open(path, "rb") as f:
        assert sample_bytes(spark, f.read()).count() == 3


def test_no_statistics_and_nested(spark, tmp_path):
    path = f"{tmp_path}/n.parquet"
    pq.write_table(pa.table({"x": [1, 2], "s": [{"x": 1}, {"x": 2}], "l": [[1.0], []]}), path, write_statistics=False)
    rows = {r.column: r for r in column_summary(footers(spark, path)).collect()}
    assert set(rows) == {"x", "s.x", "l.list.element"} and not rows["x"].statistics_available and rows["x"].total_nulls is None
    assert len(tune(spark, path)["columns"]) == 3


def test_files_of_a_directory(spark, tmp_path):
    written(tmp_path, "one", a=[1, 2, 3])
    written(tmp_path, "two", a=[3, 2])
    got = {r.file.rsplit("/", 1)[-1]: r.monotonicity for r in profile(sample(spark, str(tmp_path)), exact=True).collect()}
    assert got == {"one.parquet": 1.0, "two.parquet": 0.0}


def test_diagnosis(spark):
    from tessera.operators.diagnose import with_diagnosis

    base = {"file": "f", "encodings": ["PLAIN", "RLE_DICTIONARY"], "codec": "ZSTD:1", "rec_codec": "ZSTD", "rec_level": 3, "encoding": "RLE_DICTIONARY", "uncompressed": 100_000, "ratio": 2.0, "rg_encodings": [["RLE_DICTIONARY", "PLAIN"]], "rg_dict_bytes": [2000]}
    cases = {
        "Match": {}, "full": {"rg_dict_bytes": [950_000]}, "some": {"rg_encodings": [["RLE_DICTIONARY"], ["PLAIN"]], "rg_dict_bytes": [10, None]},
        "none": {"encodings": ["PLAIN"], "rg_encodings": [["PLAIN"]], "rg_dict_bytes": [None]}, "delta": {"encodings": ["DELTA_BINARY_PACKED"], "encoding": "PLAIN", "ratio": 1.2, "rg_encodings": [["DELTA_BINARY_PACKED"]]},
        "split": {"encodings": ["BYTE_STREAM_SPLIT"], "encoding": "BYTE_STREAM_SPLIT", "ratio": 1.05, "rg_encodings": [["BYTE_STREAM_SPLIT"]]}, "codec": {"codec": "SNAPPY"},
    }
    rows = [base | {"column": k} | v for k, v in cases.items()]
    df = spark.createDataFrame(rows, "file string, column string, encodings array<string>, codec string, rec_codec string, rec_level int, encoding string, uncompressed long, ratio double, rg_encodings array<array<string>>, rg_dict_bytes array<long>")
    got = {r.column: r for r in with_diagnosis(df).collect()}
    assert {k: r.status for k, r in got.items()} == {"Match": "Match", "full": "FallbackDictionary", "some": "FallbackDictionary", "none": "Mismatch", "delta": "IneffectiveEncoding", "split": "IneffectiveEncoding", "codec": "Mismatch"}
    assert got["full"].fallback_groups == [0] and got["some"].fallback_groups == [1] and "RG 1" in got["some"].variance
    strict = {r.column: r.status for r in with_diagnosis(df, strict_level=True).collect()}
    assert strict["Match"] == "Mismatch"


def test_islands_of_many_row_groups(spark):
    """So many groups that work growing with their square or cube never ends."""
    sets = [["PLAIN", "RLE"] if i % 3 else ["RLE_DICTIONARY"] for i in range(20_000)]
    df = spark.createDataFrame([(sets,), ([["PLAIN"]] * 3,), ([["PLAIN"]],), ([["PLAIN"], ["PLAIN"], ["DELTA_BINARY_PACKED", "RLE"]],)], "rg_encodings array<array<string>>")
    long, alike, one, short = (r.runs for r in df.select(islands().alias("runs")).collect())
    assert [tuple(r) for r in long[:3]] == [(0, 0, "RLE_DICTIONARY"), (1, 2, "PLAIN"), (3, 3, "RLE_DICTIONARY")] and len(long) == 13_334 and long[-1].to == 19_999
    assert alike is None and one is None and [tuple(r) for r in short] == [(0, 1, "PLAIN"), (2, 2, "DELTA_BINARY_PACKED")]


def test_distinct_values_of_row_groups(spark, tmp_path):
    """Groups that lie across splits and files, nulls, signs of zero and NaN."""
    n, nan = 30_000, float("nan")
    a, s, f = [None if i % 5 == 0 or i < 700 else i % 457 for i in range(n)], [f"{i % 91}" for i in range(n)], [nan if i % 3 else -0.0 if i % 2 else 0.0 for i in range(n)]
    cut = 12_345
    (tmp_path / "t").mkdir()
    for name, part in (("one", slice(0, cut)), ("two", slice(cut, n))):
        written(tmp_path / "t", name, group=1000, a=pa.array(a[part], pa.int64()), s=s[part], f=f[part])
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = numbered(spark, f"{tmp_path}/t", ["a", "s", "f"])
        assert rows.rdd.getNumPartitions() > 3
        got = {(r.g, r.i): r.distinct_count for r in group_counts(rows, ["a", "s", "f"], 700).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert got == {(g, i): len({str(x + 0.0) if i == 2 else x for x in c[700 * g : 700 * g + 700]} - {None}) for g in range(-(-n // 700)) for i, c in enumerate((a, s, f))} and got[0, 0] == 0


def test_row_group_advice(spark):
    df = spark.createDataFrame([("a", 1, [12 << 20]), ("b", 1, [200 << 20]), ("c", 1, [600 << 20])], "file string, row_groups int, rg_bytes array<long>")
    assert {r.file: r.verdict for r in row_group_advice(df, "spark").collect()} == {"a": "below", "b": "within", "c": "above"}


def test_scalars():
    assert scalars.parse_codecs("zstd:3,lz4") == [("ZSTD", 3), ("LZ4", None)] and scalars.parse_encoding("dict") == "RLE_DICTIONARY"
    assert scalars.writer_encoding("?") == "PLAIN" and scalars.writer_codec("?", 1) == ("SNAPPY", None) and scalars.writer_codec("zstd", None) == ("ZSTD", 3)
    assert scalars.group_ranges([0, 1, 3]) == "RGs 0-1, 3" and scalars.group_ranges([2]) == "RG 2" and scalars.human_bytes(1536) == "1.5 KB"
    assert scalars.apply_gate(600 << 20) == "severe" and scalars.analyze_gate(300 << 20) == "warn" and scalars.engine("Spark") == "spark" and scalars.priority("?") == "balanced"
    assert override_codec("spark", "zstd", 6)[0] == "SNAPPY" and override_codec("clickhouse", "brotli", None)[:2] == ("ZSTD", 3) and override_codec("clickhouse", "gzip", 6)[0] == "GZIP"
    with pytest.raises(ValueError):
        scalars.parse_codec("brotli")
    told = []
    assert dict(follow("ab", str.upper, lambda *x: told.append(x))) == {"a": "A", "b": "B"} and told[-1] == (2, 2, "b")


def test_rewrite_and_report(spark, tmp_path, monkeypatch):
    told_of = []
    source, target = f"{SF}/orders.parquet", f"{tmp_path}/out.parquet"
    result = rewrite(spark, source, target, "duckdb", "size")
    assert pq.read_table(target).equals(pq.read_table(source)) and result["output_bytes"] < result["input_bytes"]
    after = {r.column: r.encodings for r in column_summary(footers(spark, target)).collect()}
    assert "DELTA_BINARY_PACKED" in after["o_orderkey"] and "BYTE_STREAM_SPLIT" in after["o_totalprice"]
    with pytest.raises(FileExistsError):
        rewrite(spark, source, target)
    with open(source, "rb") as f:
        data, r = rewrite_bytes(spark, f.read())
    assert len(data) == r["output_bytes"] and len(r["columns"]) == 6
    report = tune(spark, source)
    assert report["size_reduction_pct"] == pytest.approx(100 * (1 - 1 / 1.15)) and [o["id"] for o in report["options"]] == ["a", "b", "c"]
    assert report["current_codec"] == "SNAPPY"
    small, told = tune(spark, source, "duckdb", "size", told=lambda *x: told_of.append(x)), told_of
    a, b, c = small["options"]
    assert (a["codec"], a["level"], b["level"], c["codec"]) == ("ZSTD", 3, 6, "LZ4") and not a["caveats"] and [n["severity"] for n in c["caveats"]] == ["Warning"]
    assert len(told) == 6 and told[-1] == (6, 6, "o_orderpriority") and [x["column"] for x in small["columns"]] == [x["column"] for x in report["columns"]]
    assert json.loads(json.dumps(report, default=str))["columns"][0]["column"] == "o_orderkey"
    exec(report["python_snippet"].replace("'input.parquet'", repr(source)).replace("'output.parquet'", repr(f"{tmp_path}/s.parquet")))
    assert pq.read_table(f"{tmp_path}/s.parquet").num_rows == 1500
    again = retune(profiled(spark, source), file_summary(footers(spark, source)), "spark", "size")
    assert {c["rec_codec"] for c in again["columns"]} == {"SNAPPY"}
    large = written(tmp_path, "large", group=2000, a=list(range(5000)))
    monkeypatch.setattr("tessera.sources.rewrite.PART", 1500)
    result = rewrite(spark, large, f"{tmp_path}/parts.parquet")
    made = pq.ParquetFile(f"{tmp_path}/parts.parquet")
    assert result["rows"] == 5000 and made.read().equals(pq.read_table(large)) and not list(tmp_path.glob("*.tmp"))
    native = rewrite(spark, source, f"{tmp_path}/native", "spark", mode="native")
    assert native["rows"] == 1500


def test_bench(spark):
    rows = bench(spark, f"{SF}/events.parquet", "event_type", ["PLAIN", "RLE_DICTIONARY"], [("ZSTD", 3), ("UNCOMPRESSED", None)]).collect()
    assert len(rows) == 4 and [r.bytes for r in rows] == sorted(r.bytes for r in rows)
    with pytest.raises(ValueError):
        bench(spark, f"{SF}/events.parquet", "nothing")


def test_exit_codes(spark, tmp_path, capsys):
    path = written(tmp_path, a=list(range(1000)))
    assert cli.main(["info", path, "--output", "json"], spark) == 0 and json.loads(capsys.readouterr().out)[0]["column"] == "a"
    assert cli.main(["tune", path, "--min-improvement", "1"], spark) == 1
    assert cli.main(["tune", path, "--min-improvement", "1000"], spark) == 0
    assert cli.main(["tune", f"{tmp_path}/nothing.parquet"], spark) == 2 and cli.main(["tune", path, "--engine", "x"], spark) == 2
    assert cli.main(["apply", path, "--output", path], spark) == 2
    link = tmp_path / "link.parquet"
    link.symlink_to(path)
    assert cli.main(["apply", path, "--output", str(link)], spark) == 2
    capsys.readouterr()
    assert cli.main(["tune", path, "--priority", "speed", "--progress"], spark) == 1
    out = capsys.readouterr()
    assert "LZ4 gains little" in out.out and "option c: Fastest, LZ4" in out.out and "row groups:" in out.out and "1 of 1: a" in out.err
    assert cli.parser().parse_args(["tune", path]).min_improvement == 10.0
    assert cli.main(["profile", path, "--save", f"{tmp_path}/kept"], spark) == 0
    assert cli.main(["retune", f"{tmp_path}/kept", "--output", "json", "--engine", "spark"], spark) == 0
    report = capsys.readouterr().out
    (tmp_path / "report.json").write_text(report)
    assert cli.main(["snippet", f"{tmp_path}/report.json", "--engine", "spark"], spark) == 0 and "df.write" in capsys.readouterr().out
    for measure, seen in (("size", ()), ("read", ("read",)), ("write", ("write",)), ("all", ("read", "write"))):
        assert cli.main(["bench", path, "--column", "a", "--codecs", "zstd:3,snappy", "--measure", measure], spark) == 0
        text = capsys.readouterr().out
        assert "★size" in text and [k for k in ("read", "write") if f"{k} " in text] == list(seen)
    assert cli.main(["bench", path, "--column", "a", "--measure", "none"], spark) == 2


@pytest.mark.parametrize("name", ["encoding_rules_orders", "null_profile_events", "string_length_part", "codec_speed_duckdb", "explain_trace", "byte_entropy_derived", "diagnose", "size_prediction", "rg_islands"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in queries.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name]).df()
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    text = lambda rows: sorted(tuple("null" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    want = want.astype(object).where(want.notna(), None)
    assert text(tuple(r[c] for c in cols) for r in df.collect()) == text(want[cols].itertuples(index=False))
