"""Benchmark decontamination by SimHash of item-sized windows.

Similarity of a window and an item: weighted Jaccard of their `size`-word shingles, a shingle
weighing as often as it occurs. A window has the words of an item; with m shingles of the item and k of the window, a window at
threshold t shares t / (1 + t) * (m + k) of them at least. So every window of some item's length is fingerprinted in which so many
places hold a shingle of any item of that length, in whatever order these come; no other window can match.

Their 64-bit SimHashes meet those of all items of their length in a multi-index: 64 bits are cut into radius + 1 blocks,
so fingerprints within the radius have an equal block, and which items a window is compared with follows from the blocks alone.
At t = 0.8 a bit differs with probability 0.152; radius 21 lies 3.9 deviations above the mean of 9.7. Candidates within it are
verified by the exact similarity. The 64 counts of a SimHash are lanes of a few long integers, wide enough for the longest item,
so a shingle is added to all of them by a few operations.

DataFrame functions only. The item tables are broadcast if the items' shingles number less than
BROADCAST_ROWS; else joins shuffle. The keys of documents with windows are written first, so that Spark knows their size: if small, they
go to the texts, else a document's text moves once.

Null or wordless texts and items match nothing. A text shorter than a shingle is one
shingle, so an item of so few words matches only a text of just these words. In a text shorter
than the item the window is the whole text. Items of equal text each count. Rows equal in id and text are
one document; null ids are ids like others. An empty table gives an empty result. Columns of any name may stand beside id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import fresh, scratch, stored

BROADCAST_ROWS = 500_000
RADIUS = 21


def words_of(text: str) -> Column:
    """Lower-case words; white space separates."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")


def shingles_of(words: str, size: int) -> Column:
    """Hashes of all runs of size words; a shorter text is one run."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))))
    return F.when(n >= size, runs).when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<long>"))


def let(value: Column, f) -> Column:
    """f(value), the value being computed once."""
    return F.transform(F.array(value), f)[0]


def lane_bits(longest: int) -> int:
    """The narrowest lanes that count this many shingles and have two bits left, so that no sum reaches the sign."""
    return next(w for w in (8, 16, 32) if longest < 1 << w - 2)


def simhash(shingles: Column, width: int) -> Column:
    """64 majority bits; a tie is 0. The counts of bits g, g + width, ... are the lanes of the g-th sum."""
    ones = F.lit(sum(1 << at for at in range(0, 64, width)) if width < 64 else 1)
    shift = lambda x, by: F.call_function("shiftrightunsigned", x, F.lit(by))
    zero = F.struct(*(F.lit(0).cast("long").alias(f"a{g}") for g in range(width)))
    added = lambda sums, h: F.struct(*((sums[f"a{g}"] + shift(h, g).bitwiseAND(ones)).alias(f"a{g}") for g in range(width)))
    # With this added, a lane has its second highest bit if it counts more than half of the shingles.
    more = (F.lit((1 << width - 2) - 1).cast("long") - F.floor(F.size(shingles) / 2)) * ones

    def bits(sums):
        out = F.lit(0).cast("long")
        for g in range(width):
            out = out.bitwiseOR(F.shiftleft(shift(sums[f"a{g}"] + more, width - 2).bitwiseAND(ones), g))
        return out

    return F.aggregate(shingles, zero, added, bits)


def blocks(fingerprint: str, radius: int) -> Column:
    """Blocks (number, bits) of a fingerprint: two equal but for radius bits share one."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    parts = [F.struct(F.lit(i).alias("block"), F.shiftright(F.col(fingerprint), lo).bitwiseAND(F.lit((1 << hi - lo) - 1)).alias("bits")) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
    return F.array(*parts)


def again(shingles: Column) -> Column:
    """All occurrences of shingles but the first of each, with their numbers, so that sets of these are multisets."""
    later = lambda o: F.filter(o, lambda h, i: (i > 0) & (h == F.get(o, i - 1)))
    numbered = lambda o: F.transform(o, lambda h, i: F.struct(h.alias("h"), (i - F.array_position(o, h)).alias("k")))
    return let(let(F.array_sort(shingles), later), numbered)


def shared(own: Column, item: Column, item_again: Column) -> Column:
    """The number of shingles in common, each as often as both hold it; item_again is again(item)."""
    return F.size(F.array_intersect(own, item)) + F.when(F.size(item_again) > 0, F.size(F.array_intersect(again(own), item_again))).otherwise(0)


def items_of(benchmark: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """(item_id, length, s, m): words, shingles and their number, of items with words."""
    rows = benchmark.select(F.col(item_id).alias("item_id"), words_of(text).alias("w"))
    rows = rows.select("item_id", F.size("w").alias("length"), shingles_of("w", size).alias("s")).where("length > 0")
    return rows.select("item_id", "length", "s", F.size("s").alias("m"))


def windows_of(docs: DataFrame, items: DataFrame, sent, doc_id: str, text: str, size: int, threshold: float) -> DataFrame:
    """(id, key, windows): the windows (length, m, start) with enough places that hold a shingle of some item of their length."""
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("key"), words_of(text).alias("w"))
    places = rows.select("id", "key", F.size("w").alias("n"), F.posexplode(shingles_of("w", size)).alias("at", "h"))
    index = items.select("length", "m", F.explode(F.array_distinct("s")).alias("h")).distinct()
    hits = places.join(sent(index), "h").groupBy("id", "key", "n", "length", "m").agg(F.collect_set("at").alias("places"))
    own = F.least(F.col("m"), F.greatest(F.lit(1), F.col("n") - (size - 1)))
    hits = hits.withColumn("least", F.ceil((F.col("m") + own) * (threshold / (1 + threshold)) - 1e-9).cast("int")).where("size(places) >= least").withColumn("places", F.array_sort("places"))
    # Windows with the places i to i + least - 1, but for those that begin at or before place i - 1.
    begin = "greatest(0, places[i + least - 1] - m + 1, if(i > 0, places[greatest(i - 1, 0)] + 1, 0))"
    end = "least(places[i], greatest(0, n - length))"
    full = F.expr(f"flatten(transform(sequence(0, size(places) - least), i -> if({begin} <= {end}, sequence({begin}, greatest({begin}, {end})), cast(array() as array<int>))))")
    starts = hits.select("id", "key", "length", "m", full.alias("starts"))
    windows = F.flatten(F.collect_list(F.transform("starts", lambda x: F.struct("length", "m", x.alias("start")))))
    # Filtered after this aggregation only: a filter below it would be pushed into the lambda, with the sort of the places.
    return starts.groupBy("id", "key").agg(windows.alias("windows")).where("size(windows) > 0")


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 5, threshold: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """(id, key, item_id, similarity, start): for each document and item the best window at threshold or more."""
    items = items_of(benchmark, item_id, item_text, size)
    total, longest = items.agg(F.sum("m"), F.max("m")).first()
    width = lane_bits(longest or 0)
    sent = F.broadcast if (total or 0) <= BROADCAST_ROWS else (lambda df: df)
    with scratch() as keep:
        near = stored(windows_of(docs, items, sent, doc_id, text, size, threshold), "windows")
        keys = stored(near.select(F.col("id").alias("i"), F.col("key").alias("k")), "documents-with-windows")
        rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("key"), F.col(text).alias("t"))
        texts = rows.join(keys, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left_semi").dropDuplicates(["id", "key"])
        near = near.select(F.col("id").alias("i"), F.col("key").alias("k"), "windows")
        texts = texts.join(near.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k"))).select("id", "key", "windows", words_of("t").alias("w"))
        texts = stored(texts.select("id", "key", "windows", shingles_of("w", size).alias("s")), "texts-with-windows")
        keep(texts)
    print_of = lambda x: F.struct(x["length"].alias("length"), x["start"].alias("start"), let(F.slice("s", x["start"] + 1, x["m"]), lambda own: simhash(own, width)).alias("g"))
    prints = texts.select("id", "key", F.explode(F.transform("windows", print_of)).alias("x")).select("id", "key", "x.*")
    prints = prints.withColumn("b", F.explode(blocks("g", radius))).select("*", "b.block", "b.bits").drop("b")
    keyed = items.select("item_id", "length", simhash(F.col("s"), width).alias("f"))
    keyed = keyed.withColumn("b", F.explode(blocks("f", radius))).select("*", "b.block", "b.bits").drop("b")
    # One equal block is enough: the first decides, so that no pair comes twice.
    differ = F.col("g").bitwiseXOR(F.col("f"))
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    first = F.coalesce(*(F.when(F.shiftright(differ, lo).bitwiseAND(F.lit((1 << hi - lo) - 1)) == 0, F.lit(i)) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))))
    pairs = prints.join(sent(keyed), ["length", "block", "bits"]).where((F.bit_count(differ) <= radius) & (first == F.col("block")))
    # A document's candidates of one item, verified where its shingles are.
    pairs = pairs.groupBy(F.col("id").alias("i"), F.col("key").alias("k"), "item_id").agg(F.collect_list("start").alias("starts"))
    pairs = pairs.join(sent(items.select("item_id", "m", F.col("s").alias("item"), again(F.col("s")).alias("item_again"))), "item_id")
    pairs = texts.select("id", "key", "s").join(pairs, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")))

    def sized(own):
        both = shared(own, F.col("item"), F.col("item_again"))
        return let(both, lambda n: F.struct((n / (F.size(own) + F.col("m") - n)).alias("similarity"), (n >= (F.size(own) + F.col("m") - n) * threshold - 1e-9).alias("enough")))

    tried = F.transform("starts", lambda x: F.struct(let(F.slice("s", x + 1, F.col("m")), sized).alias("v"), (-x).alias("s")))
    best = pairs.select("id", "key", "item_id", F.array_max(F.transform(F.filter(tried, lambda x: x["v"]["enough"]), lambda x: F.struct(x["v"]["similarity"].alias("similarity"), x["s"].alias("s")))).alias("x"))
    return best.where("x IS NOT NULL").select("id", "key", "item_id", F.col("x.similarity").alias("similarity"), (-F.col("x.s")).alias("start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """docs without those that hold a passage of the benchmark."""
    i, k = fresh(docs, "i", "k")
    with scratch() as keep:
        found = contaminated(docs, benchmark, doc_id, text, **settings).select(F.col("id").alias(i), F.col("key").alias(k)).distinct()
        found = stored(found, "contaminated")  # its size is known, so a small one goes to the texts
        keep(found)
    return docs.join(found, F.col(doc_id).eqNullSafe(F.col(i)) & (F.xxhash64(F.col(text)) == F.col(k)), "left_anti")
