"""Exact Jaccard self-join on word shingles with adaptive multi-match prefixes.

Sets. A text's words (runs of bytes other than U+0020 and U+0009 to U+000D, A-Z lowered) give the
set of its distinct `size`-word shingles, as 64-bit hashes; fewer words give one shingle, no
words the empty set, which links with nothing. Documents with equal sets are one node.

Order. All tokens are ordered by (level, hash). A token's level is 0 unless it is frequent: at least FREQUENT sets hold it
among the tokens that come first in order of hash (half as many again as a prefix takes), counted over all documents.
Frequent tokens have levels by the logarithm of that count, so they come last. They are broadcast, the most frequent HEAVIEST of
them at most; any order of the tokens is exact, so this bound changes costs alone. A list of tokens of level 0
makes no more than FREQUENT / 2 pairs for each of its members, whatever the size of the corpus.

Prefixes. With n tokens and alpha = ceil(t n), a partner shares alpha tokens at least, so among the
first n - alpha + l tokens of both, l are shared. l is 1 plus the number of frequent tokens in
the basic prefix (the estimated candidate cost), and MOST_MATCHES at most; a pair must share min(l) prefix
tokens. What lies behind the prefixes bounds the overlap from above (n - prefix), which discards most
pairs before any text is read. A set's parity bits bound the difference of two sets from below (each differing bit
is a differing token at least), which discards most of the rest.

Linking. Copies in groups would give all pairs, so links are found in rounds: each node is tried against the
first of its lists; in lists of more than LARGE nodes, then in each list against a hub of another class. Possible trials are
verified on whole texts, and classes merge. When trials help no more, every pair of two classes that shares a list is
counted, bounded and verified; it is left out of a list where the BEFORE tokens in front of the list's token, in an
order of each node's own lists, show another shared one. Pairs inside one class change no class and are never verified.

Null texts count as empty. Repeated rows are copies. An empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.base import forget, fresh, scratch, small_batches, stored, trimmed
from tessera.llm.graph import components

MOST_MATCHES = 16
FREQUENT = 16
HEAVIEST = 1 << 20
ROUNDS = 3
FEWER = 4
HUBS = 6
BITS = 512
BEFORE = 2
LARGE = 32
GAP, SPACE = re.compile(rb"[ \t-\r]*"), re.compile(rb"[ \t-\r]")


class Shingler:
    """Distinct shingle hashes of texts, sorted.

    Words are hashed together: with a random 64-bit value per byte, prefix sums of value times
    power give any word's polynomial hash by one difference, so a megabyte of texts takes a
    few array operations. Longer texts are hashed a part at a time.
    """

    PART = 1 << 20
    GIANT = 1 << 16
    BASE = 0x9E3779B97F4A7C15

    def __init__(self, size: int):
        self.size = size
        self.values = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        with np.errstate(over="ignore"):
            self.up, self.down = np.full(self.PART + 1, self.BASE, np.uint64), np.full(self.PART + 1, pow(self.BASE, -1, 1 << 64), np.uint64)
            for powers in (self.up, self.down):
                powers[0] = 1
                np.cumprod(powers, out=powers)

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and starts of the words of at most PART bytes."""
        c = np.frombuffer(data, np.uint8)
        gap = self.space[c]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate([[0], edge])
        if not gap[-1]:
            edge = np.concatenate([edge, [len(c)]])
        starts, ends = edge[::2], edge[1::2]
        with np.errstate(over="ignore"):
            sums = np.zeros(len(c) + 1, np.uint64)
            np.cumsum(self.values[c] * self.up[: len(c)], out=sums[1:])
            h = (sums[ends] - sums[starts]) * self.down[starts]
            h += (ends - starts).astype(np.uint64)
        h = mixed(h)
        for i in np.flatnonzero(ends - starts >= self.GIANT):
            h[i] = self.giant(data[starts[i] : ends[i]])[0]
        return h, starts

    def long_words(self, data: bytes) -> np.ndarray:
        out, at = [], GAP.match(data).end()
        while at < len(data):
            end = min(at + self.PART, len(data))
            if end < len(data):
                end = max(data.rfind(x, at, end) for x in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) + 1
            if end:
                out.append(self.words(data[at:end])[0])
            else:  # one word fills the part
                found = SPACE.search(data, at)
                end = found.start() if found else len(data)
                out.append(self.giant(data[at:end]))
            at = GAP.match(data, end).end()
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    @staticmethod
    def giant(word: bytes) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(word)], np.uint64)

    def runs(self, h: np.ndarray) -> np.ndarray:
        k = min(self.size, len(h))
        with np.errstate(over="ignore"):
            s = np.zeros(len(h) - k + 1, np.uint64)
            for i in range(k):
                s = mixed(s * np.uint64(self.BASE) + h[i : len(h) - k + 1 + i])
        return s

    def many(self, texts: list[str | None]):
        """The sets of texts, in order."""
        held, size = [], 0
        for text in texts:
            data = (text or "").encode("utf-8", "surrogatepass").lower()
            if len(data) > self.PART // 4:
                yield from self.together(held)
                held, size = [], 0
                h = self.long_words(data)
                yield distinct(self.runs(h)) if len(h) else h
                continue
            if size + len(data) + 1 > self.PART:
                yield from self.together(held)
                held, size = [], 0
            held.append(data)
            size += len(data) + 1
        yield from self.together(held)

    def together(self, parts: list[bytes]):
        if not parts:
            return
        h, starts = self.words(b"\n".join(parts) + b"\n")
        ends = np.cumsum([len(x) + 1 for x in parts])
        last = np.searchsorted(starts, ends)
        whole = self.runs(h) if len(h) >= self.size else h
        first = 0
        for stop in last.tolist():
            n = stop - first
            yield distinct(whole[first : stop - self.size + 1] if n >= self.size else self.runs(h[first:stop]) if n else h[:0])
            first = stop


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def basic(n: int, percent: int) -> int:
    """Tokens of a prefix that takes one shared token."""
    return n + percent * n // -100 + 1


class Levels:
    """The frequent tokens in ascending order and their levels; all others have level 0."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens = tokens[order]
        self.levels = (np.log2(counts[order] / FREQUENT) + 1).astype(np.uint8)

    def of(self, s: np.ndarray) -> np.ndarray:
        out = np.zeros(len(s), np.uint8)
        if len(self.tokens) and len(s):
            at = np.searchsorted(self.tokens, s)
            at[at == len(self.tokens)] = 0
            same = self.tokens[at] == s
            out[same] = self.levels[at[same]]
        return out


def frequent_tokens(texts: DataFrame, size: int, percent: int) -> Levels:
    """The tokens that many sets hold among their first ones, counted over all texts; equal sets count once a task."""

    def run(batches):
        shingler, held, n, seen = Shingler(size), [], 0, set()

        def counted():
            tokens, times = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(tokens), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(tokens[i : i + (1 << 16)].view(np.int64)), pa.array(times[i : i + (1 << 16)].astype(np.int64))], names=["token", "n"])

        for batch in batches:
            for s in shingler.many(batch.column(0).to_pylist()):
                if not len(s):
                    continue
                node = xxhash.xxh3_64_intdigest(s.tobytes())
                if node in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(node)
                held.append(s[: basic(len(s), percent) * 3 // 2 + 4])
                n += len(held[-1])
                if n > 1 << 20:
                    yield from counted()
                    held, n = [], 0
        if held:
            yield from counted()

    counts = texts.mapInArrow(trimmed(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    counts = stored(counts, "frequent")
    # The smallest number of documents for which the table has HEAVIEST rows at most.
    steps = counts.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("step")).count().collect()  # some hundred rows
    least, rows = 0, 0
    for step, count in sorted(((r["step"], r["count"]) for r in steps), reverse=True):
        rows += count
        if rows > HEAVIEST:
            least = step + 1
            break
    got = counts.where(F.floor(F.log2("n") * 4) >= least).toArrow()
    forget(counts)
    return Levels(got.column("token").to_numpy().view(np.uint64), got.column("n").to_numpy())


def prefixes(rows: DataFrame, size: int, percent: int, levels) -> DataFrame:
    """rows(id, key, text) -> (id, key, node, n, ell, q, prefix, bits); a set's prefix and parity bits are kept once a task."""

    def run(batches):
        shingler, seen = Shingler(size), set()
        for batch in batches:
            nodes, ns, ells, qs, lists, parities = [], [], [], [], [], []
            for s in shingler.many(batch.column(2).to_pylist()):
                n = len(s)
                node = xxhash.xxh3_64_intdigest(s.tobytes()) >> 1 if n else None
                nodes.append(node)
                ns.append(n)
                if not n or node in seen:
                    ells.append(0)
                    qs.append(0)
                    lists.append(None)
                    parities.append(None)
                    continue
                if len(seen) < 1_000_000:
                    seen.add(node)
                alpha = n - basic(n, percent) + 1
                of = levels.value.of(s)
                order = np.argsort(of, kind="stable") if of.any() else slice(None)
                ell = min(1 + int((of[order][: n - alpha + 1] > 0).sum()), MOST_MATCHES, alpha)
                ells.append(ell)
                qs.append(n - alpha + ell)
                lists.append(s[order][: n - alpha + ell].view(np.int64))
                odd = np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
                parities.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(ns, pa.int64()), pa.array(ells, pa.int32()), pa.array(qs, pa.int32()), pa.array(lists, pa.list_(pa.int64())), pa.array(parities, pa.list_(pa.int64()))],
                names=["id", "key", "node", "n", "ell", "q", "prefix", "bits"],
            )

    return rows.mapInArrow(trimmed(run), "id long, key long, node long, n long, ell int, q int, prefix array<long>, bits array<long>")


def shared_lists(batches):
    """Rows (token, node, short) in order -> (token, node, short, hub) of the tokens with two nodes or more; hub is the smallest."""
    last, hub, told, tail, held = None, None, False, None, False
    for batch in batches:
        t, v, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(t):
            continue
        new = np.empty(len(t), bool)
        new[0], new[1:] = t[0] != last, t[1:] != t[:-1]
        run = np.cumsum(new) - 1 + (not new[0])
        first = np.flatnonzero(new)
        hubs = v[first] if new[0] else np.concatenate([[hub], v[first]])
        mine = hubs[run]
        fresh = np.ones(len(t), bool)
        fresh[1:] = new[1:] | (v[1:] != v[:-1])
        if not new[0]:
            fresh[0] = v[0] != tail
        differs = mine != v
        many = np.bincount(run, differs) > 0
        if not new[0] and told:
            many[0] = True
        keep = many[run] & fresh
        out_t, out_v, out_f, out_h = t[keep], v[keep], f[keep], mine[keep]
        if not new[0] and not told and many[0]:
            out_t, out_v, out_f, out_h = np.append(out_t, last), np.append(out_v, hub), np.append(out_f, held), np.append(out_h, hub)
        # The short prefix flag of the run's first row, for when the run goes on in the next batch.
        held = f[first[-1]] if len(first) else held
        last, hub, told, tail = t[-1], mine[-1], bool(many[-1]), v[-1]
        yield pa.RecordBatch.from_arrays([pa.array(out_t), pa.array(out_v), pa.array(out_f), pa.array(out_h)], names=["token", "node", "short", "hub"])


def needed(percent: int):
    """The shared tokens a pair has at least at the threshold."""
    return F.ceil((F.col("n_a") + F.col("n_b")) * percent / F.lit(100.0 + percent) - 1e-9)


def alike(percent: int):
    """Whether a pair's parity bits allow the threshold."""
    differing = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    return differing <= F.col("n_a") + F.col("n_b") - 2 * needed(percent)


def possible(percent: int):
    """Whether a pair with c shared prefix tokens can still reach the threshold."""
    need = needed(percent)
    behind = F.greatest(F.col("n_a") - F.col("q_a"), F.col("n_b") - F.col("q_b"))
    return (F.col("c") >= F.least("ell_a", "ell_b")) & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (F.col("c") + behind >= need)


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole texts reach the threshold; texts is (node, text)."""

    def run(batches):
        shingler, at, own = Shingler(size), None, None
        for batch in batches:
            keep = []
            for a, x, other in zip(batch.column(0).to_pylist(), batch.column(2), shingler.many(batch.column(3).to_pylist()), strict=True):
                if a != at:
                    at, own = a, next(shingler.many([x.as_py()]))
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    whole = first.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").select("a", "b", "x", "y")
    return whole.mapInArrow(trimmed(run), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, keys: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id): a row per document, the class being the smallest id linked with it.

    Ids are integers; a null id takes part, but names no class. Documents link when 100 * intersection >= percent * union.
    keys: also key, the hash of the text, and class, which names the classes of documents without ids too (null for the empty set).
    """
    before = docs.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        with scratch() as keep:
            made, final = linked_classes(docs, doc_id, text, size, percent)
            keep(made)
            keep(final)
    finally:
        docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    out = made.select("id", "n", "node", "key").join(final, "node", "left")
    columns = [F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")]
    return out.select(*columns, "key", F.when(F.col("n") > 0, F.col("comp")).alias("class")) if keys else out.select(*columns)


def one_of_each_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each class: of smallest id (null last), then of smallest hash of the text.

    Of rows equal in id and text one stays, whichever. Rows without words are in no class and all stay.
    """
    i, k = fresh(docs, "i", "k")
    same = F.col(doc_id).cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(k))
    with scratch() as keep:
        named = near_duplicates(docs, doc_id, text, size, percent, keys=True).where("class IS NOT NULL")
        rows = named.groupBy("doc_id", "key").agg(F.min("class").alias("class"), F.count(F.lit(1)).alias("copies"))
        rows = rows.withColumn("order", F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key"))
        rows = rows.join(rows.groupBy("class").agg(F.min("order").alias("first")), "class").select(F.col("doc_id").alias(i), F.col("key").alias(k), "copies", (F.col("order") == F.col("first")).alias("stays"))
        # Written, their sizes are known: small ones go to the texts.
        rows = stored(rows.where("NOT stays OR copies > 1"), "rows-of-classes", clean=False)
        gone, several = stored(rows.where("NOT stays").select(i, k), "gone"), stored(rows.where("stays").select(i, k), "several", clean=False)
        for df in (gone, several):
            keep(df)
        left = docs.join(gone, same, "left_anti")
        if several.isEmpty():
            return left
    own = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias(k)
    once = left.join(several, same, "left_semi").select("*", own).dropDuplicates([doc_id, k]).drop(k)
    return left.join(several, same, "left_anti").unionAll(once)


def linked_classes(docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: (id, key, n, node, ...) of every document, and (node, comp, component_id) of every set."""
    spark = docs.sparkSession
    small_batches(spark)
    spark.sparkContext.setJobDescription("n-gram Jaccard join")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(text).alias("text"))
    levels = spark.sparkContext.broadcast(frequent_tokens(rows.select("text"), size, percent))
    made = stored(prefixes(rows, size, percent, levels), "prefixes")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")
    # One document, with its text's key, stands for each set. Sets in no list need no more than that.
    postings = made.where(F.col("prefix").isNotNull()).select(F.posexplode("prefix").alias("at", "token"), "node", (F.col("n") - F.ceil(F.col("n") * F.lit(2.0 * percent / (100 + percent)) - 1e-9) + F.col("ell")).alias("own"))
    postings = postings.select("token", "node", (F.col("at") < F.col("own")).alias("short"))
    lists = stored(postings.repartition("token").sortWithinPartitions("token", "node").mapInArrow(shared_lists, "token long, node long, short boolean, hub long"), "lists")
    listed = lists.select("node").distinct()
    nodes = stored(
        made.where("ell > 0").groupBy("node").agg(F.min("n").alias("n"), F.min("ell").alias("ell"), F.min("q").alias("q"), F.min(F.struct("id", "key")).alias("r"), F.min("bits").alias("bits")).join(listed, "node", "left_semi"),
        "nodes",
    )
    sides = stored(nodes.select("node", "n", "ell", "q"), "sides", clean=False)
    side = lambda k: sides.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("ell").alias(f"ell_{k}"), F.col("q").alias(f"q_{k}"))
    tried = lambda pairs: pairs.join(side("a"), "a").join(side("b"), "b").where(possible(percent))
    parity = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}"))

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs whose parity bits and whole texts reach the threshold."""
        pairs = stored(pairs.select("a", "b").join(parity("a"), "a").join(parity("b"), "b").where(alike(percent)).select("a", "b"), "pairs", clean=False)
        if pairs.isEmpty():
            return pairs
        either = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        # Written, its size is known: below the broadcast threshold the corpus is scanned without a shuffle, else it moves once.
        wanted = stored(nodes.join(either, "node", "left_semi").select("node", F.xxhash64("r.id", "r.key").alias("row")), "wanted", clean=False)
        texts = stored(rows.select(F.xxhash64("id", "key").alias("row"), "text").join(wanted, "row").dropDuplicates(["node"]).select("node", "text"), "texts")
        small_batches(spark, 64)
        links = stored(verified(pairs, texts, size, percent), "links", clean=False)
        for done in (pairs, wanted, texts):
            forget(done)
        return links

    star = tried(lists.where("node != hub").groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("c")))
    star = stored(star.groupBy("b").agg(F.max_by("a", "c").alias("a")).select("a", "b"), "trials", clean=False)
    links = [linked(star)]
    forget(star)

    label = components(links[0])

    def labelled(left: DataFrame) -> DataFrame:
        return left.drop("comp").join(label, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")

    large = stored(lists.groupBy("token").count().where(F.col("count") > LARGE).select("token"), "large", clean=False)
    sorted_out = lists.join(large.withColumn("large", F.lit(True)), "token", "left")
    small = sorted_out.where("large IS NULL").select("token", "node", "short")
    left = stored(labelled(sorted_out.where("large").select("token", "node", "short")), "large-lists", clean=False)
    before = 0
    for turn in range(ROUNDS):
        hubs = left.groupBy("token").agg(*(F.min_by(F.struct("node", "comp"), F.xxhash64("node", F.lit(turn * HUBS + i))).alias(f"h{i}") for i in range(HUBS)))
        hubs = hubs.select("token", F.array(*(f"h{i}" for i in range(HUBS))).alias("hubs"))
        # A member is tried against the first hub of another class, so a round makes no more rows than the lists have.
        trials = left.join(hubs, "token").withColumn("h", F.get(F.filter("hubs", lambda h: h["comp"] != F.col("comp")), F.lit(0)))
        trials = trials.where("h IS NOT NULL").groupBy(F.least("h.node", "node").alias("a"), F.greatest("h.node", "node").alias("b")).agg(F.count(F.lit(1)).alias("c"))
        # c counts only the lists that have this hub, so the bound is not exact here: it only thins the trials.
        found = linked(tried(trials))
        fresh = found.count()
        if not fresh:
            break
        links = [stored((links[0] if len(links) == 1 else links[0].union(links[1])).union(found), "links", clean=False)]
        label = components(links[0])
        after = stored(labelled(left), "large-lists", clean=False)
        forget(left)
        left = after
        if fresh * FEWER < before:  # what is left links too little for trials to pay
            break
        before = fresh
    # Lists of one class make no pairs; a large one is not joined with itself to find that out.
    still = left.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("token")
    left = left.join(still, "token", "left_semi")
    # Of the tokens that a pair shares and that are short for its smaller node, the first in that node's order is never left out.
    order = Window.partitionBy("node").orderBy(F.desc("short"), "token")
    earlier = F.array_compact(F.array(*(F.lag("token", i + 1).over(order) for i in range(BEFORE))))
    sized = labelled(small.withColumn("large", F.lit(False)).union(left.select("token", "node", "short", F.lit(True)))).join(sides.select("node", "n"), "node").withColumn("before", earlier)
    shorter = F.when(F.struct("n_a", "a") < F.struct("n_b", "b"), F.col("short_a")).otherwise(F.col("short_b"))
    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent

    def met(postings: DataFrame, allowed) -> DataFrame:
        """The pairs of different classes that meet in a list."""
        x, y = (postings.select("token", F.col("node").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in postings.columns if c not in ("token", "node"))) for k in "ab")
        same = (x["token"] == y["token"]) & (F.col("comp_a") < F.col("comp_b")) & shorter & near & allowed & ~F.arrays_overlap("before_a", "before_b")
        return x.join(y, same).select("a", "b").distinct()

    # In large lists the bits go along, so that only pairs they allow leave the join.
    hot = sized.where("large").drop("large").join(nodes.select("node", "bits"), "node").select("*", *(F.col("bits")[i].alias(f"w{i}") for i in range(BITS // 64))).drop("bits")
    differing = sum(F.bit_count(F.col(f"w{i}_a").bitwiseXOR(F.col(f"w{i}_b"))) for i in range(BITS // 64))
    hot = met(hot, differing <= F.col("n_a") + F.col("n_b") - 2 * needed(percent))
    cold = met(sized.where("NOT large").drop("large"), F.lit(True))
    cold = cold.join(parity("a"), "a").join(parity("b"), "b").where(alike(percent)).select("a", "b")
    pairs = stored(hot.union(cold).distinct(), "pairs", clean=False)
    # The whole prefixes of what is left give the count for the bound.
    either = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    held = stored(made.where("ell > 0").join(either, "node", "left_semi").select("node", "n", "ell", "q", "prefix").dropDuplicates(["node"]), "held")
    whole = lambda k: held.select(F.col("node").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("n", "ell", "q", "prefix")))
    pairs = pairs.join(whole("a"), "a").join(whole("b"), "b").withColumn("c", F.size(F.array_intersect("prefix_a", "prefix_b"))).where(possible(percent))
    links.append(linked(pairs))

    label = components(links[0].union(links[1]))
    ids = made.where("n > 0").groupBy("node").agg(F.min("id").alias("first"))
    named = ids.join(label, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    # Two small tables, one row per set: a set's class, and the class's smallest id.
    named = stored(named.select("node", "comp", "first"), "classes", clean=False)
    classes = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    return made, stored(named.join(classes, "comp").select("node", "comp", "component_id"), "named", clean=False)
