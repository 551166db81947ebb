"""How a file's present layout differs from the recommended one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import DICTIONARIES, codec_text, data_encodings
from tessera.plans.impact import same_codec

#: Fixed values.
FULL_DICTIONARY, LEAST_BYTES, DELTA_RATIO, SPLIT_RATIO = 900_000, 10_000, 1.5, 1.1


def has_dictionary(e: Column) -> Column:
    return F.arrays_overlap(e, F.array(*map(F.lit, DICTIONARIES)))


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once: an expression used in a lambda is computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def islands(groups: str = "rg_encodings") -> Column:
    """Successive row groups of one encoding set: array of (from, to, encodings); null if all are alike."""
    each = F.transform(F.col(groups), lambda e: F.array_join(F.array_sort(data_encodings(e)), "+"))

    def runs(sets: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(sets) - 1), lambda i: (i == 0) | (F.get(sets, i) != F.get(sets, i - 1)))
        one = lambda start: F.transform(start, lambda s, k: F.struct(s.alias("from"), F.coalesce(F.get(start, k + 1) - 1, F.size(sets) - 1).alias("to"), F.get(sets, s).alias("encodings")))
        return F.when(F.size(F.array_distinct(sets)) > 1, bound(first, one))

    return F.when(F.size(groups) >= 2, bound(each, runs))


def islands_text(runs: Column) -> Column:
    one = lambda r: F.concat(r.encodings, F.when(r["from"] == r["to"], F.concat(F.lit(" in RG "), r["from"].cast("string"))).otherwise(F.concat(F.lit(" in RGs "), r["from"].cast("string"), F.lit("-"), r["to"].cast("string"))))
    return F.array_join(F.transform(runs, one), "; ")


def with_diagnosis(rows: DataFrame, strict_level: bool = False) -> DataFrame:
    """rows with status, detail, fallback_groups, largest_dict_bytes and variance (text of islands)."""
    rg = F.arrays_zip(F.col("rg_encodings").alias("e"), F.col("rg_dict_bytes").alias("d"))
    where = lambda keep: F.filter(F.transform(rg, lambda x, i: F.when(keep(x), i)), lambda i: i.isNotNull())
    plain = lambda x: F.array_contains(x.e, "PLAIN")
    spilled = where(lambda x: has_dictionary(x.e) & plain(x) & (F.coalesce(x.d, F.lit(0)) >= FULL_DICTIONARY))
    coded = where(lambda x: has_dictionary(x.e))
    bare = where(lambda x: plain(x) & ~has_dictionary(x.e))
    data, same = data_encodings("encodings"), same_codec(strict_level)
    big, ratio, wanted = F.col("uncompressed") >= LEAST_BYTES, F.col("ratio"), F.col("encoding")
    right = F.array_contains(data, wanted)
    weak_delta = big & F.array_contains("encodings", "DELTA_BINARY_PACKED") & (wanted != "DELTA_BINARY_PACKED") & (ratio < DELTA_RATIO)
    weak_split = big & F.array_contains("encodings", "BYTE_STREAM_SPLIT") & (ratio < SPLIT_RATIO)
    mixed = (F.size(coded) > 0) & (F.size(bare) > 0)
    no_dictionary = (wanted == "RLE_DICTIONARY") & ~has_dictionary(F.col("encodings"))
    status = F.when(F.size(spilled) > 0, "FallbackDictionary").when(mixed, "FallbackDictionary").when(no_dictionary, "Mismatch").when(weak_delta | weak_split, "IneffectiveEncoding").when(right & same, "Match").otherwise("Mismatch")
    target = codec_text("rec_codec", "rec_level")
    detail = (
        F.when(F.size(spilled) > 0, F.concat(F.lit("the dictionary filled up in row groups "), F.array_join(spilled.cast("array<string>"), ", ")))
        .when(mixed, F.concat(F.lit("no dictionary in row groups "), F.array_join(bare.cast("array<string>"), ", ")))
        .when(no_dictionary, F.lit("few distinct values, and no dictionary"))
        .when(weak_delta | weak_split, F.concat(F.lit("the present encoding gains little: ratio "), F.round(ratio, 2).cast("string")))
        .when(right & same, F.lit("as recommended"))
        .otherwise(F.concat_ws("; ", F.when(~right, F.concat(F.lit("encoding "), wanted)), F.when(~same, F.concat(F.lit("codec "), F.col("codec"), F.lit(" to "), target))))
    )
    fallback = F.when(F.size(spilled) > 0, spilled).when(mixed, bare).otherwise(F.array().cast("array<int>"))
    return rows.withColumns({"status": status, "detail": detail, "fallback_groups": fallback, "largest_dict_bytes": F.array_max("rg_dict_bytes"), "variance": islands_text(islands())})


def health(rows: DataFrame) -> DataFrame:
    """Counts of statuses per file."""
    count = lambda s: F.count_if(F.col("status") == s)
    return rows.groupBy("file").agg(count("Match").alias("matched"), count("FallbackDictionary").alias("fallbacks"), count("IneffectiveEncoding").alias("weak"), count("Mismatch").alias("mismatches"))
