"""Names, labels and small computations that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
ENGINES = ("spark", "duckdb", "polars", "clickhouse", "pandas", "unknown")
PRIORITIES = ("size", "speed", "balanced")
LEVEL_ENCODINGS = ("RLE", "BIT_PACKED")
DICTIONARIES = ("RLE_DICTIONARY", "PLAIN_DICTIONARY")
ENCODINGS = ("PLAIN", "RLE", "RLE_DICTIONARY", "DELTA_BINARY_PACKED", "DELTA_LENGTH_BYTE_ARRAY", "DELTA_BYTE_ARRAY", "BYTE_STREAM_SPLIT")
CODECS = ("UNCOMPRESSED", "SNAPPY", "GZIP", "LZ4", "LZ4_RAW", "ZSTD", "BROTLI")
VALUE_BYTES = {"INT32": 4, "FLOAT": 4, "INT64": 8, "DOUBLE": 8, "BOOLEAN": 1}
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
JSON_PATTERN = r"^[\s\x0b\p{Z}]*[{\[]"
DEFAULT_GRID = (("SNAPPY", None), ("ZSTD", 1), ("ZSTD", 3), ("ZSTD", 6), ("LZ4", None), ("UNCOMPRESSED", None))
VALID_ENCODINGS = {
    "BOOLEAN": ("PLAIN", "RLE"),
    "INT32": ("PLAIN", "RLE_DICTIONARY", "DELTA_BINARY_PACKED"),
    "INT64": ("PLAIN", "RLE_DICTIONARY", "DELTA_BINARY_PACKED"),
    "FLOAT": ("PLAIN", "RLE_DICTIONARY", "BYTE_STREAM_SPLIT"),
    "DOUBLE": ("PLAIN", "RLE_DICTIONARY", "BYTE_STREAM_SPLIT"),
    "BYTE_ARRAY": ("PLAIN", "RLE_DICTIONARY", "DELTA_LENGTH_BYTE_ARRAY", "DELTA_BYTE_ARRAY"),
}
GIB, MIB = 1 << 30, 1 << 20


def engine(text: str | None) -> str:
    found = (text or "").strip().lower()
    return found if found in ENGINES else "unknown"


def priority(text: str | None) -> str:
    found = (text or "").strip().lower()
    return found if found in PRIORITIES else "balanced"


def valid_encodings(physical: str) -> tuple[str, ...]:
    return VALID_ENCODINGS.get(physical, ("PLAIN", "RLE_DICTIONARY"))


def parse_encoding(text: str) -> str:
    """Strict; DICT stands for RLE_DICTIONARY."""
    found = text.strip().upper()
    found = {"DICT": "RLE_DICTIONARY"}.get(found, found)
    if found not in ENCODINGS:
        raise ValueError(f"unknown encoding: {text}")
    return found


def parse_codec(text: str, level: int | None = None) -> tuple[str, int | None]:
    """Strict; takes `zstd:3` as well."""
    name, _, own = text.strip().upper().partition(":")
    if name not in CODECS or name == "BROTLI":
        raise ValueError(f"unsupported codec: {text}")
    return name, int(own) if own else level


def parse_codecs(text: str) -> list[tuple[str, int | None]]:
    return [parse_codec(part) for part in text.split(",") if part.strip()]


def writer_encoding(text: str) -> str:
    """Lenient: PLAIN for what is unknown."""
    try:
        return parse_encoding(text)
    except ValueError:
        return "PLAIN"


def writer_codec(name: str, level: int | None) -> tuple[str, int | None]:
    """Lenient: SNAPPY for what is unknown; ZSTD without a level is 3."""
    found = (name or "").upper()
    if found not in CODECS:
        return "SNAPPY", None
    return found, (level if level is not None else 3) if found == "ZSTD" else level if found in ("GZIP", "BROTLI") else None


def human_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if abs(n) < 1024 or unit == "GB":
            return f"{n:.0f} B" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return ""


def group_ranges(indices: list[int]) -> str:
    """Row-group numbers as text: `RG 2`, `RGs 0-3, 5`."""
    parts: list[list[int]] = []
    for i in sorted(indices):
        if parts and i == parts[-1][1] + 1:
            parts[-1][1] = i
        else:
            parts.append([i, i])
    text = ", ".join(str(a) if a == b else f"{a}-{b}" for a, b in parts)
    return f"{'RG' if len(indices) == 1 else 'RGs'} {text}"


def codec_text(codec: str = "codec", level: str = "level") -> Column:
    return F.concat_ws(":", F.col(codec), F.col(level).cast("string"))


def codec_family(text: Column) -> Column:
    return F.substring_index(text, ":", 1)


def data_encodings(encodings: str | Column) -> Column:
    """Without the encodings of levels."""
    return F.filter(encodings, lambda e: ~e.isin(*LEVEL_ENCODINGS))


def value_bytes(physical: str = "physical", mean: str = "len_mean") -> Column:
    """Mean bytes of a value: of byte arrays their mean length, or 8."""
    out = F.when(F.col(physical) == "BYTE_ARRAY", F.coalesce(F.col(mean), F.lit(8.0)))
    for name, size in VALUE_BYTES.items():
        out = out.when(F.col(physical) == name, float(size))
    return out.otherwise(8.0)


def reduction_pct(before: Column, after: Column) -> Column:
    return F.when(before == 0, 0.0).otherwise((1 - after / before) * 100)


def truncated(text: Column, most: int = 40) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def analyze_gate(size: int) -> str:
    """Whether a file may be analyzed in memory: ok, warn above 200 MiB, reject above 1 GiB."""
    return "reject" if size > GIB else "warn" if size > 200 * MIB else "ok"


def apply_gate(size: int) -> str:
    """Whether a file may be rewritten in memory: ok, mild above 200 MiB, severe above 500 MiB, blocked above 1 GiB."""
    return "blocked" if size > GIB else "severe" if size > 500 * MIB else "mild" if size > 200 * MIB else "ok"


def tuned_name(name: str) -> str:
    base = name.rsplit("/", 1)[-1]
    return (base[: -len(".parquet")] if base.endswith(".parquet") else base) + "_tuned.parquet"
