"""Statistics of columns in file order: one long row per file and column.

A scan gives a file's rows in order, so order statistics, lengths, patterns and byte counts take one pass
without a shuffle or a sort: each task turns a run of successive rows into one row per column, with the run's first and
last value, and the runs of a file are put together by their places. A null breaks a pair. Doubles are compared as
values: NaN equals NaN, -0.0 equals 0.0. Distinct values are counted column by column, combined in each task
before the shuffle, or by a sketch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalars import JSON_PATTERN, UUID_PATTERN
from tessera.operators.sample import same_path

EXACT_BELOW = 50_000
PATTERN_ROWS = 1_000
SKETCH = 14
ORDERED = (T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType)
STATS = "file string, column string, n long, nulls long, null_fraction double, distinct_count long, distinct_method string, cardinality_ratio double, monotonicity double, string_monotonicity double, run_length double, len_min long, len_max long, len_mean double, len_stddev double, uuid_detected boolean, json_detected boolean, byte_entropy double"
RUNS = "file string, at long, stop long, i int, n long, some long, pairs long, up long, same long, lo long, hi long, total long, squares double, flags binary, bytes array<long>, first_n long, first_d double, first_b binary, last_n long, last_d double, last_b binary"
PARTS = "g long, i int, done long, n long, d double, b binary"


def comparable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def plain(values: pa.Array) -> pa.Array:
    """The values as integers, doubles or bytes, which compare alike."""
    kind = values.type
    if pa.types.is_floating(kind):
        # Without signs of zero, and with one NaN, so that equal values are equal bits.
        out = values.cast(pa.float64())
        return pc.add(out, 0.0)
    if pa.types.is_boolean(kind):
        return values.cast(pa.int8()).cast(pa.int64())
    if pa.types.is_integer(kind):
        return values.cast(pa.int64())
    if pa.types.is_date32(kind):
        return values.cast(pa.int32()).cast(pa.int64())
    if pa.types.is_temporal(kind):
        return values.cast(pa.int64())
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        return values.cast(pa.binary())
    return values.cast(pa.string()).cast(pa.binary())


def equal(a: pa.Array, b: pa.Array) -> pa.Array:
    same = pc.equal(a, b)
    return pc.or_(same, pc.and_(pc.is_nan(a), pc.is_nan(b))) if pa.types.is_floating(a.type) else same


class Run:
    """Sums of one column over successive rows of a file."""

    def __init__(self, text: bool, binary: bool):
        self.text, self.binary = text, binary
        self.n = self.some = self.pairs = self.up = self.same = self.total = 0
        self.squares, self.lo, self.hi, self.flags = 0.0, None, None, b""
        self.bytes = np.zeros(256, np.int64) if binary else None
        self.first = self.last = None  # arrays of one value

    def add(self, values: pa.Array) -> None:
        v, n = plain(values), len(values)
        edges = [(v.slice(1), v.slice(0, n - 1))] if n > 1 else []
        if self.last is not None:
            edges.append((v.slice(0, 1), self.last))
        for a, b in edges:
            same, up = equal(a, b), pc.greater_equal(a, b)
            self.pairs += len(same) - same.null_count
            self.same += pc.sum(same).as_py() or 0
            self.up += pc.sum(up).as_py() or 0
        self.n, self.some = self.n + n, self.some + n - v.null_count
        self.first, self.last = self.first if self.first is not None else v.slice(0, 1), v.slice(n - 1)
        if self.text and n > v.null_count:
            size = pc.binary_length(v).cast(pa.int64())
            low, high = pc.min_max(size).as_py().values()
            self.lo, self.hi = min(low, self.lo or low) if self.lo is not None else low, max(high, self.hi or 0)
            self.total += pc.sum(size).as_py()
            self.squares += pc.sum(pc.power(size.cast(pa.float64()), 2)).as_py()
            if len(self.flags) < PATTERN_ROWS:
                own = values.drop_null().slice(0, PATTERN_ROWS - len(self.flags)).cast(pa.string())
                flag = [pc.match_substring_regex(own, pattern=p).to_numpy(zero_copy_only=False).astype(np.uint8) for p in (UUID_PATTERN, JSON_PATTERN)]
                self.flags += (flag[0] + 2 * flag[1]).tobytes()
        if self.binary:
            whole = b"".join(x for x in v.to_pylist() if x)
            self.bytes += np.bincount(np.frombuffer(whole, np.uint8), minlength=256)

    def row(self, file: str, at: int, stop: int, i: int) -> dict:
        out = {"file": file, "at": at, "stop": stop, "i": i, "n": self.n, "some": self.some, "pairs": self.pairs, "up": self.up, "same": self.same}
        out |= {"lo": self.lo, "hi": self.hi, "total": self.total, "squares": self.squares, "flags": self.flags, "bytes": self.bytes.tolist() if self.binary else None}
        for name, edge in (("first", self.first), ("last", self.last)):
            kind = "d" if pa.types.is_floating(edge.type) else "n" if pa.types.is_integer(edge.type) else "b"
            out |= {f"{name}_{k}": edge[0].as_py() if k == kind else None for k in "ndb"}
        return out


def arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (part.split() for part in schema.split(", "))])


def runs(rows: DataFrame, columns: list[str], kinds: dict) -> DataFrame:
    """RUNS rows: the sums of each column over each run of successive rows that a task meets."""
    texts = [isinstance(kinds[c], T.StringType) for c in columns]
    binaries = [isinstance(kinds[c], T.BinaryType) for c in columns]
    schema = arrow(RUNS)

    def run(batches):
        file = at = stop = None
        sums: list[Run] = []

        def told():
            return pa.RecordBatch.from_pylist([s.row(file, at, stop, i) for i, s in enumerate(sums)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            place, names = batch.column(1).to_numpy(), batch.column(0)
            breaks = place[1:] != place[:-1] + 1
            if names[0] != names[-1] or breaks.any():
                breaks = breaks | pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(breaks) + 1).tolist(), len(place)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if file != names[a].as_py() or place[a] != stop + 1:
                    if sums:
                        yield told()
                    file, at, sums = names[a].as_py(), int(place[a]), [Run(t, x) for t, x in zip(texts, binaries, strict=True)]
                stop = int(place[b - 1])
                for i, s in enumerate(sums):
                    s.add(batch.column(i + 2).slice(a, b - a))
        if sums:
            yield told()

    return rows.select("__file", "__row", *(F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(columns))).mapInArrow(run, RUNS)


def stitched(found: DataFrame) -> DataFrame:
    """One row per file and column i from the runs of each file: their sums and the pairs across their edges."""
    order = Window.partitionBy("file", "i").orderBy("at")
    last = {k: F.lag(f"last_{k}").over(order) for k in "ndb"}
    edge = found.withColumns({"meets": F.lag("stop").over(order) == F.col("at") - 1} | {f"p_{k}": v for k, v in last.items()})
    compared = lambda f: F.col("meets") & F.coalesce(*(f(F.col(f"first_{k}"), F.col(f"p_{k}")) for k in "ndb"))
    count = lambda f: F.when(compared(f), 1).otherwise(0)
    flags = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("at", "flags"))), lambda x: F.hex(x["flags"])), lambda x: x != "")
    return edge.groupBy("file", "i").agg(
        F.sum("n").alias("n"), F.sum("some").alias("some"), F.sum(F.col("pairs") + count(lambda a, b: F.when(a.isNotNull() & b.isNotNull(), True))).alias("pairs"),
        F.sum(F.col("up") + count(lambda a, b: a >= b)).alias("up"), F.sum(F.col("same") + count(lambda a, b: a == b)).alias("same"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("total").cast("double").alias("total"), F.sum("squares").alias("squares"),
        F.substring(F.array_join(flags, ""), 1, 2 * PATTERN_ROWS).alias("flags"),
    )


def share(part: Column, whole: Column, none: float | None) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(none).cast("double"))


def sketched_count(column: Column) -> Column:
    """Different values by a HyperLogLog sketch of 2 ** SKETCH registers: a standard error of 0.8 %."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(F.when(column.isNotNull(), F.xxhash64(column)), F.lit(SKETCH)))


def distinct_counts(rows: DataFrame, columns: list[str], some: DataFrame, exact: bool | None) -> DataFrame:
    """(file, i, distinct_count, distinct_method) of every file and column; some is (file, i, some).

    exact None: a column with fewer than EXACT_BELOW values in a file is counted one by one, any other by a sketch.
    """
    out = None

    def gather(more: DataFrame):
        nonlocal out
        out = more if out is None else out.unionAll(more)

    few = many = set(range(len(columns)))
    if exact is None:
        # Two figures per column.
        bounds = some.groupBy("i").agg(F.min("some").alias("lo"), F.max("some").alias("hi")).collect()
        few, many = {r["i"] for r in bounds if r["lo"] < EXACT_BELOW}, {r["i"] for r in bounds if r["hi"] >= EXACT_BELOW}
    for i, c in enumerate(columns):
        if i not in few or exact is False:
            continue
        # Each column by itself: no row is copied, and a task sends its distinct values only.
        own = rows.select(F.col("__file").alias("file"), F.col(f"`{c}`").alias("v")).where("v IS NOT NULL")
        if exact is None and i in many:
            own = own.join(some.where((F.col("i") == i) & (F.col("some") < EXACT_BELOW)).select("file"), "file", "left_semi")
        gather(own.distinct().groupBy("file").agg(F.count(F.lit(1)).alias("distinct_count")).select("file", F.lit(i).alias("i"), "distinct_count", F.lit("exact").alias("distinct_method")))
    sketched = [i for i in range(len(columns)) if exact is False or exact is None and i in many]
    if sketched:
        wide = rows.groupBy(F.col("__file").alias("file")).agg(*(sketched_count(F.col(f"`{columns[i]}`")).alias(f"d{i}") for i in sketched))
        long = wide.select("file", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"d{i}").alias("distinct_count")) for i in sketched))).alias("x")).select("file", "x.i", "x.distinct_count", F.lit("hyperloglog").alias("distinct_method"))
        if exact is None:
            long = long.join(some.where(F.col("some") >= EXACT_BELOW).select("file", "i"), ["file", "i"], "left_semi")
        gather(long)
    return out


def group_counts(rows: DataFrame, columns: list[str], size: int) -> DataFrame:
    """(g, i, distinct_count) of every column i over rows g * size to (g + 1) * size - 1.

    A group that a task meets whole is counted there; of the others, at the ends of splits, tasks send the different values.
    """
    schema = arrow(PARTS)

    def told(g: int, n: int, pieces: list[list[pa.Array]]):
        parts = []
        for i, p in enumerate(pieces):
            values = pa.chunked_array(p)
            if n == size:
                parts.append({"g": [g], "i": [i], "done": [pc.count_distinct(values, mode="only_valid").as_py()]})
                continue
            values = pc.unique(values).drop_null()
            kind = "d" if pa.types.is_floating(values.type) else "n" if pa.types.is_integer(values.type) else "b"
            # The first row says that there is a group, with or without values.
            parts.append({"g": [g] * (1 + len(values)), "i": [i] * (1 + len(values)), "done": [0] + [None] * len(values), kind: pa.concat_arrays([pa.nulls(1, values.type), values])})
        for p in parts:
            yield pa.RecordBatch.from_arrays([pa.array(p[f.name], f.type) if f.name in p else pa.nulls(len(p["g"]), f.type) for f in schema], schema=schema)

    def run(batches):
        at, n, pieces = None, 0, [[] for _ in columns]
        for batch in batches:
            groups = batch.column(0).to_numpy() // size
            cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)] if len(groups) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if at != groups[a]:
                    if n:
                        yield from told(at, n, pieces)
                    at, n, pieces = int(groups[a]), 0, [[] for _ in columns]
                n += b - a
                for i, p in enumerate(pieces):
                    p.append(plain(batch.column(i + 1).slice(a, b - a)))
        if n:
            yield from told(at, n, pieces)

    parts = rows.select("__row", *(F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(columns))).mapInArrow(run, PARTS)
    return parts.distinct().groupBy("g", "i").agg((F.sum(F.coalesce("done", F.lit(0))) + F.count("n") + F.count("d") + F.count("b")).alias("distinct_count"))


def profile(rows: DataFrame, exact: bool | None = None, counted: bool = True) -> DataFrame:
    """STATS of every comparable column of rows(…, __file, __row), as whole() and sample() give them.

    exact: whether values are counted one by one; by default where a column holds fewer than EXACT_BELOW in a file.
    counted: without it no distinct values are counted, which take a scan and a shuffle for each column, and their figures are null.
    """
    columns = [f.name for f in rows.schema if comparable(f.dataType) and not f.name.startswith("__")]
    kinds = {c: rows.schema[c].dataType for c in columns}
    if not columns:
        return rows.sparkSession.createDataFrame([], STATS)
    found = runs(rows, columns, kinds)
    if counted and exact is None or any(isinstance(k, T.BinaryType) for k in kinds.values()):
        found = found.cache()  # one row per file, split and column
    sums = stitched(found)
    if counted:
        counts = distinct_counts(rows, columns, sums.select("file", "i", "some"), exact)
        out = sums.join(counts, ["file", "i"], "left").withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0).cast("long"))).withColumn("distinct_method", F.coalesce("distinct_method", F.lit("hyperloglog" if exact is False else "exact")))
    else:
        out = sums.withColumns({"distinct_count": F.lit(None).cast("long"), "distinct_method": F.lit(None).cast("string")})
    name = F.element_at(F.array(*(F.lit(c) for c in columns)), F.col("i") + 1)
    of = lambda kind: F.col("i").isin(*(i for i, c in enumerate(columns) if isinstance(kinds[c], kind)))
    text, some, mean = of(T.StringType), F.col("some"), F.col("total") / F.col("some")
    sized = lambda value: F.when(text & (some > 0), value)
    hits = lambda digits: F.length(F.regexp_replace("flags", f"0[^{digits}]", "")) / F.length("flags")
    detected = lambda digits, least: F.coalesce(F.when(text & (F.length("flags") > 0), hits(digits) >= least), F.lit(False))
    out = out.select(
        "file", name.alias("column"), "n", (F.col("n") - some).alias("nulls"), share(F.col("n") - some, F.col("n"), 0.0).alias("null_fraction"),
        "distinct_count", "distinct_method", (share(F.col("distinct_count"), some, 0.0) if counted else F.lit(None).cast("double")).alias("cardinality_ratio"),
        F.when(of(ORDERED), share(F.col("up"), F.col("pairs"), 0.0)).alias("monotonicity"),
        F.when(text, share(F.col("up"), F.col("pairs"), None)).alias("string_monotonicity"),
        share(F.col("same"), F.col("pairs"), 0.0).alias("run_length"),
        sized(F.col("lo")).alias("len_min"), sized(F.col("hi")).alias("len_max"), sized(mean).alias("len_mean"), sized(F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / some - mean * mean))).alias("len_stddev"),
        detected("13", 0.9).alias("uuid_detected"), detected("23", 0.8).alias("json_detected"),
    )
    entropies = byte_entropies(found, columns, kinds)
    out = out.join(entropies, ["file", "column"], "left") if entropies is not None else out.withColumn("byte_entropy", F.lit(None).cast("double"))
    return out.withColumn("file", same_path("file", True))


def byte_entropies(found: DataFrame, columns: list[str], kinds: dict) -> DataFrame | None:
    """Shannon entropy of the bytes of binary columns; 0 without bytes."""
    binary = [F.struct(F.lit(i).alias("i"), F.lit(c).alias("column")) for i, c in enumerate(columns) if isinstance(kinds[c], T.BinaryType)]
    if not binary:
        return None
    name = F.element_at(F.map_from_entries(F.array(*binary)), F.col("i"))
    counts = found.where("bytes IS NOT NULL").select("file", name.alias("column"), F.posexplode("bytes").alias("b", "count")).groupBy("file", "column", "b").agg(F.sum("count").alias("count"))
    return entropy(counts, "file", "column").withColumn("byte_entropy", F.coalesce("byte_entropy", F.lit(0.0)))


def entropy(counts: DataFrame, *by: str) -> DataFrame:
    """(by, byte_entropy) of counts(by, count): log2 of the sum less the mean of the counts' logs; null without any."""
    c = F.col("count")
    logs = F.sum(F.when(c > 0, c * F.log2(c)).otherwise(0.0))
    return counts.groupBy(*by).agg(F.when(F.sum(c) > 0, F.log2(F.sum(c)) - logs / F.sum(c)).alias("byte_entropy"))
