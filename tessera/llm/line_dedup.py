"""Repeated line runs, found by a suffix array over line-ID sequences.

A document is the sequence of its non-blank lines. Only lines that occur again can be part of a repeated run, so
the suffixes that begin with one of these are sorted, and a suffix ends in front of a line that occurs once. Distributed prefix
doubling: the repeated lines, known by 128 bits of hash, are sorted by range, and a line's rank is the number of places in front of it; in each
round the places that share the n lines from there are sorted by the ranks n, 2 n ... 7 n lines on (three doublings at once), and those that agree
keep one rank. Rounds go on until no two places share n whole lines, so the ranks end as the suffix array of all documents: only suffixes that are
equal to their ends share one, and these stand by (id, text hash, place). Ranks come from the order of what they stand for, so from the first round
on they are exact. Stretches that are shorter than n lines are settled and leave the rounds. Each round's ranks are written, so that lost
executors don't renumber.

Each suffix is looked at down to the first depth at which its lines have min_words words (or min_chars characters, where that is given). The
common prefix of neighbours in the suffix array is counted in lines, as far as that depth; where it reaches it, both belong to one interval.
Intervals of two or more places are the repeated runs, and runs that overlap make up the
maximal ones. Their first copy, by (id, text hash, place), stays. Lines of later copies go, but for those that the
first copy itself covers where copies overlap.

DataFrame functions only. Counts of lines, pairs and intervals are summed in each task before the shuffle, the suffix array is dealt by range,
wherever a line is frequent, and the joins back to the places are such that adaptive execution splits them.

Null texts have no lines and stay null. Rows equal in id and text are one document, and get
the same result. Blank lines are never deleted by themselves, nor are runs below both bounds. A line has one word more than
spaces, and one for every two characters of scripts written without spaces (Chinese, Japanese, Thai, Lao, Khmer, Burmese). An empty table gives an empty one; other columns stay, whatever their names,
but for n_lines and n_removed_lines, which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.base import fresh, scratch, stored

#: Scripts written without spaces between words.
UNSPACED = r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]"


def line_table(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, key, seq, at, a, b, words, chars): the non-blank lines of each document; at counts all lines, seq these; a and b are hashes."""
    numbered = F.transform(F.split(F.col(text), "\n"), lambda line, at: F.struct(at.alias("at"), line.alias("line")))
    full = F.filter(numbered, lambda x: F.trim(x["line"]) != "")
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("key"), F.posexplode(full).alias("seq", "x"))
    lines = rows.select("id", "key", "seq", "x.at", "x.line")
    spaces = F.length("line") - F.length(F.replace("line", F.lit(" ")))
    unspaced = F.when(F.octet_length("line") > F.length("line"), F.regexp_count("line", F.lit(UNSPACED))).otherwise(0)
    return lines.select("id", "key", "seq", "at", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), (spaces + 1 + F.floor(unspaced / 2)).cast("int").alias("words"), F.length("line").alias("chars"))


def dealt(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """rows sorted by range over tasks: part numbers the ranges in their order."""
    return stored(rows.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), name, clean=False)


def earlier(rows: DataFrame, value: Column, how: Callable[[Column], Column], name: str) -> DataFrame:
    """rows with how(value) over the parts in front of their own: one value a part is moved."""
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(F.broadcast(rows.groupBy("part").agg(value.alias("value")).select("part", how(F.col("value")).over(ahead).alias(name))), "part")


def ranked(pairs: DataFrame, name: str, shortest: int = 1) -> DataFrame:
    """(a, b, n, before): the pairs (a, b) that occur `shortest` times at least, their number, and that of all rows with a smaller pair."""
    counts = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= shortest)
    rows = dealt(counts, ["a", "b"], name)
    within = Window.partitionBy("part").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    both = [F.coalesce(c, F.lit(0)) for c in (F.col("ahead"), F.sum("n").over(within))]
    return earlier(rows, F.sum("n"), F.sum, "ahead").select("a", "b", "n", (both[0] + both[1]).alias("before"))


def suffix_ranks(lines: DataFrame, depth: int = 1) -> DataFrame:
    """(id, key, island, seq, at, words, chars, size, left, rank, r0, r1, ...): the places of repeated lines; rank is that of the suffix from there
    among all suffixes, rj (2**j lines up to depth, which takes a round each) that of the 2**j lines from there, null if these occur once.

    island numbers the stretches of successive places of a document, size is their length, left what of it lies from the place on.
    """
    own = Window.partitionBy("id", "key").orderBy("seq")
    repeated = ranked(lines.select("a", "b"), "line-ranks", 2)
    places = lines.join(repeated, ["a", "b"]).select("id", "key", "seq", "at", "words", "chars", F.col("before").alias("r0")).distinct()
    places = places.withColumn("island", F.col("seq") - F.row_number().over(own))
    stretch = Window.partitionBy("id", "key", "island").orderBy("seq")
    whole = Window.partitionBy("id", "key", "island")
    places = places.withColumns({"size": F.count(F.lit(1)).over(whole), "left": F.max("seq").over(whole) - F.col("seq") + 1, "rank": F.col("r0"), "tied": F.col("r0")})
    places, settled, length = stored(places, "places"), [], 1
    while not places.where("tied IS NOT NULL").isEmpty():
        times = 2 if 2 * length <= depth else 8
        behind = [F.coalesce(F.lead("rank", k * length).over(stretch), F.lit(-1)) for k in range(1, times)]
        paired = places.withColumn("a", F.col("tied")).withColumn("b", F.when(F.col("tied").isNotNull(), F.array(*behind)))
        pairs = ranked(paired.where("a IS NOT NULL").select("a", "b"), "pair-ranks")
        first = pairs.groupBy("a").agg(F.min("before").alias("start"))
        pairs = pairs.join(first, "a").select("a", "b", "n", (F.col("a") + F.col("before") - F.col("start")).alias("now"))
        length *= times
        paired = paired.join(pairs, ["a", "b"], "left").withColumn("rank", F.coalesce("now", "rank")).withColumn("tied", F.when((F.col("n") > 1) & (F.col("left") >= length), F.col("rank")))
        if length <= depth:
            paired = paired.withColumn(f"r{length.bit_length() - 1}", F.col("tied"))
        found = stored(paired.drop("a", "b", "n", "now"), "places")
        settled.append(found.where(F.col("size") < length))
        places = found.where(F.col("size") >= length)
    for table in settled:
        places = places.unionByName(table, allowMissingColumns=True)
    while 2 * length <= depth:
        length *= 2
        places = places.withColumn(f"r{length.bit_length() - 1}", F.lit(None).cast("long"))
    return places.drop("tied")


def suffixes(places: DataFrame, min_words: int, min_chars: int | None = None) -> DataFrame:
    """(id, key, at, last, rank, depth, run): suffixes down to the first depth with min_words words or min_chars characters: run holds the ranks
    of these lines, and last is the final line's place."""
    w = Window.partitionBy("id", "key", "island").orderBy("seq")
    words, chars = F.col("words"), F.col("chars")
    enough = lambda: words >= min_words if min_chars is None else (words >= min_words) | (chars >= min_chars)
    depth = F.when(enough(), 1)
    for d in range(1, min_words):
        there = F.lead("seq", d).over(w).isNotNull()
        words = words + F.coalesce(F.lead("words", d).over(w), F.lit(0))
        if min_chars is not None:
            chars = chars + F.coalesce(F.lead("chars", d).over(w), F.lit(0))
        depth = depth.when(there & enough(), d + 1)
    last = F.col("at")
    for d in range(2, min_words + 1):
        last = F.when(F.col("depth") == d, F.lead("at", d - 1).over(w)).otherwise(last)
    run = F.slice(F.array(*(F.lead("r0", d).over(w) for d in range(min_words))), 1, F.col("depth"))
    out = places.withColumn("depth", depth).withColumns({"last": last, "run": run})
    return out.where("depth IS NOT NULL").select("id", "key", "at", "last", "rank", "depth", "run")


def intervals(suffix: DataFrame) -> DataFrame:
    """suffix with lcp, the lines shared with the suffix in front of it in the suffix array as far as its depth, and interval, the rank at which
    the suffixes begin that share its lines down to its depth."""
    order = ["rank", "id", "key", "at"]
    rows = dealt(suffix, order, "suffix-array")
    w = Window.partitionBy("part").orderBy(*order)
    rows = earlier(rows, F.max_by("run", F.struct(*order)), lambda run: F.last(run), "edge")
    front = F.coalesce(F.lag("run").over(w), F.col("edge"))
    rows = rows.withColumn("same", F.zip_with("run", front, lambda x, y: F.coalesce(x == y, F.lit(False))))
    rows = rows.withColumn("lcp", F.when(F.col("same").isNull(), 0).otherwise(F.least(F.col("depth"), F.coalesce(F.nullif(F.array_position("same", False), F.lit(0)) - 1, F.col("depth")))))
    begins = F.when(F.col("lcp") < F.col("depth"), F.col("rank"))
    rows = earlier(rows.withColumn("begins", begins), F.max("begins"), F.max, "open")
    return rows.select(*suffix.columns, "lcp", F.coalesce(F.max("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("open")).alias("interval"))


def later_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 10, min_chars: int | None = None) -> DataFrame:
    """(id, key, runs): for each document the runs (first line, last line) to delete."""
    with scratch() as keep:
        suffix = intervals(suffixes(suffix_ranks(line_table(docs, doc_id, text)), min_words, min_chars))
        suffix = stored(suffix.select("id", "key", "at", "last", "interval"), "intervals")
        runs = suffix.groupBy("interval").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "key", "at", "last")).alias("first")).where("copies > 1")
        found = suffix.join(runs, "interval")
        same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))
        start = F.when(same, F.greatest(F.col("at"), F.col("first.last") + 1)).otherwise(F.col("at"))
        gone = found.where(~(same & (F.col("at") == F.col("first.at")))).select("id", "key", start.alias("from"), F.col("last").alias("to")).where("from <= to")
        out = stored(gone.groupBy("id", "key").agg(F.sort_array(F.collect_set(F.struct("from", "to"))).alias("runs")), "later-copies")
        keep(out)
    return out


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 10, min_chars: int | None = None) -> DataFrame:
    """docs with text freed of later copies, and n_lines and n_removed_lines."""
    i, k, g = fresh(docs, "i", "k", "g")
    gone = later_copies(docs, doc_id, text, min_words, min_chars)
    gone = gone.select(F.col("id").alias(i), F.col("key").alias(k), F.expr("array_distinct(flatten(transform(runs, r -> sequence(r.from, r.to))))").alias(g))
    out = docs.join(gone.hint("shuffle_hash"), F.col(doc_id).eqNullSafe(F.col(i)) & (F.xxhash64(F.col(text)) == F.col(k)), "left")
    lines = F.split(F.col(text), "\n")
    kept = F.array_join(F.filter(lines, lambda line, at: ~F.coalesce(F.array_contains(g, at), F.lit(False))), "\n")
    columns = [F.when(F.col(g).isNull(), F.col(text)).otherwise(kept).alias(text) if c == text else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    counts = [F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.coalesce(F.size(g), F.lit(0)).cast("long").alias("n_removed_lines")]
    return out.select(*columns, *counts)
