"""Code that writes a file as recommended, and three ready options."""

from __future__ import annotations

import json


def changed(columns: list[dict]) -> list[dict]:
    return [c for c in columns if c["encoding"] != "PLAIN"]


def pyarrow_snippet(columns: list[dict], codec: str, level: int | None) -> str:
    """Arguments that pyarrow takes: a column with an encoding must be without a dictionary."""
    dictionary = [c["column"] for c in columns if c["encoding"] == "RLE_DICTIONARY"]
    encodings = {c["column"]: c["encoding"] for c in changed(columns) if c["encoding"] != "RLE_DICTIONARY"}
    lines = ["import pyarrow.parquet as pq", "", "table = pq.read_table('input.parquet')", "pq.write_table(", "    table, 'output.parquet',", f"    compression={codec.lower() if codec != 'UNCOMPRESSED' else 'none'!r},"]
    if level is not None:
        lines.append(f"    compression_level={level},")
    lines.append(f"    use_dictionary={dictionary!r},")
    if encodings:
        lines.append(f"    column_encoding={encodings!r},")
    return "\n".join([*lines, ")"])


def pyspark_snippet(columns: list[dict], codec: str, level: int | None) -> str:
    names = {"UNCOMPRESSED": "none", "LZ4": "lz4_raw"}
    lines = ["df = spark.read.parquet('input.parquet')", "(df.write", f"    .option('compression', '{names.get(codec, codec.lower())}')", "    .option('parquet.writer.version', 'v2')", "    .option('parquet.enable.dictionary', 'false')"]
    if codec == "ZSTD" and level is not None:
        lines.append(f"    .option('parquet.compression.codec.zstd.level', '{level}')")
    lines += [f"    .option('parquet.enable.dictionary#{c['column']}', 'true')" for c in columns if c["encoding"] == "RLE_DICTIONARY"]
    return "\n".join([*lines, "    .parquet('output'))"])


def polars_snippet(columns: list[dict], codec: str, level: int | None) -> str:
    more = f", compression_level={level}" if level is not None else ""
    return f"import polars as pl\n\npl.read_parquet('input.parquet').write_parquet('output.parquet', compression='{codec.lower()}'{more})"


def snippet(report: dict | str, engine: str = "unknown") -> str:
    """Code for an engine from a report: a dict, or its JSON text."""
    report = json.loads(report) if isinstance(report, str) else report
    codec, level = report["file_codec"], report.get("file_level")
    make = {"spark": pyspark_snippet, "polars": polars_snippet}.get(engine, pyarrow_snippet)
    return make(report["columns"], codec, level)


#: Id, label, priority and codec of the options; None is the first column's codec.
OPTIONS = (("a", "Balanced", "balanced", None), ("b", "Smallest", "size", ("ZSTD", 6)), ("c", "Fastest", "speed", ("LZ4", None)))


def options(columns: dict[str, list[dict]]) -> list[dict]:
    """Three ready options from the columns as recommended for each priority; each has the caveats of its own priority."""
    made = []
    for name, label, priority, fixed in OPTIONS:
        own = columns[priority]
        codec, level = fixed or ((own[0]["rec_codec"], own[0]["rec_level"]) if own else ("ZSTD", 3))
        notes = [dict(n) for c in own for n in c["caveats"]]
        made.append({"id": name, "label": label, "codec": codec, "level": level, "caveats": notes, "python_snippet": pyarrow_snippet(own, codec, level)})
    return made
