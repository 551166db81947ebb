"""Full explanation of a recommendation: statistics, the trace of all rules, and what lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.rules import ENCODING_OF, RULES, conditions

#: Our wording.
THRESHOLDS = {
    "BooleanRle": "physical type BOOLEAN",
    "DeltaMonotonic": "integers or times, in order in 0.90 of pairs",
    "RleDictionary": "distinct share below 0.10, dictionary below 512 KiB",
    "ByteStreamSplit": "real numbers, distinct share above 0.50",
    "PlainUuid": "0.90 of the first 1000 texts are UUIDs",
    "DeltaByteArray": "texts of 50 bytes at most on average, in order in 0.80 of pairs",
    "DeltaLengthByteArray": "texts of 50 bytes at most on average",
    "PlainDefault": "nothing else holds",
}
TEACHING = {
    "BooleanRle": "Runs of equal bits take a few bytes each.",
    "DeltaMonotonic": "Differences of ordered numbers are small and pack into few bits.",
    "RleDictionary": "Few values are stored once; rows hold short indexes.",
    "ByteStreamSplit": "Bytes of one rank lie together, and the codec finds their likeness.",
    "PlainUuid": "Random identifiers have no likeness to use.",
    "DeltaByteArray": "Ordered texts share prefixes, which are left out.",
    "DeltaLengthByteArray": "Lengths pack well apart from the characters.",
    "PlainDefault": "No encoding is expected to gain anything.",
}
STATS = ("n", "nulls", "null_fraction", "distinct_count", "distinct_method", "cardinality_ratio", "monotonicity", "string_monotonicity", "run_length", "len_mean", "uuid_detected", "json_detected", "byte_entropy")


def raw_stats() -> Column:
    """The statistics that are not null, as texts by name, sorted."""
    entries = F.array(*(F.struct(F.lit(s).alias("key"), F.col(s).cast("string").alias("value")) for s in sorted(STATS)))
    return F.map_from_entries(F.filter(entries, lambda e: e.value.isNotNull()))


def actual(rule: str) -> Column:
    number = lambda c: F.coalesce(F.round(c, 4).cast("string"), F.lit("none"))
    if rule == "BooleanRle":
        return F.col("physical")
    if rule == "DeltaMonotonic":
        return F.concat(F.lit("in order "), number("monotonicity"))
    if rule in ("RleDictionary", "ByteStreamSplit"):
        return F.concat(F.lit("distinct share "), number("cardinality_ratio"))
    if rule == "PlainUuid":
        return F.concat(F.lit("UUIDs "), F.col("uuid_detected").cast("string"))
    if rule == "DeltaByteArray":
        return F.concat(F.lit("in order "), number("string_monotonicity"), F.lit(", mean bytes "), number("len_mean"))
    return F.concat(F.lit("mean bytes "), number("len_mean"))


def trace() -> Column:
    """Of rows with place, the number of the rule that decides: eight entries: whether a rule was reached, whether it decided, its threshold, the value found and the outcome."""
    holds, place = conditions(), F.col("place")
    entries = []
    for i, rule in enumerate(RULES, 1):
        outcome = F.when(F.lit(i) > place, "not reached").when(F.lit(i) == place, F.concat(F.lit("decides for "), F.lit(ENCODING_OF[rule]))).otherwise("does not hold")
        entries.append(F.struct(F.lit(rule).alias("rule"), (F.lit(i) <= place).alias("evaluated"), (F.lit(i) == place).alias("fired"), F.coalesce(holds[rule], F.lit(False)).alias("holds"), F.lit(THRESHOLDS[rule]).alias("threshold"), actual(rule).alias("actual"), outcome.alias("outcome")))
    return F.array(*entries)


def with_explain(rows: DataFrame) -> DataFrame:
    """rows with raw_stats, rule_trace, alternatives (reached, not decisive) and teaching."""
    lessons = F.create_map(*(F.lit(x) for pair in TEACHING.items() for x in pair))
    encodings = F.create_map(*(F.lit(x) for pair in ENCODING_OF.items() for x in pair))
    place = F.array_position(F.array(*map(F.lit, RULES)), F.col("rule"))
    out = rows.withColumn("raw_stats", raw_stats()).withColumn("place", place).withColumn("rule_trace", trace()).drop("place")
    lost = F.transform(F.filter("rule_trace", lambda t: t.evaluated & ~t.fired), lambda t: F.struct(t.rule.alias("rule"), F.element_at(encodings, t.rule).alias("encoding"), t.actual.alias("reason")))
    return out.withColumn("alternatives", lost).withColumn("teaching", F.element_at(lessons, F.col("rule")))
