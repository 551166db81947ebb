"""Removal of every byte covered by a `length`-byte string that also starts elsewhere.

Anchors. The smallest hash among the GRAM-byte strings of a window of `length` bytes marks a place
that depends on the window's content alone, so equal windows meet at their anchor's hash.
Successive windows with one anchor make one stretch of about 1.4 times `length` bytes; two
stretches of equal content repeat whole. Only stretches whose anchor occurs in another content as well need their
bytes compared; these are cut out of the texts once and dealt out by anchor.

Index. Each task keeps a logarithmic family of suffix arrays (Family): the windows of a new
batch are sorted as byte strings, equal neighbours are matches, the batch is merge-scanned
against each level, and levels of equal size merge, so that a window is sorted into O(log n) levels. Stretches are dealt to
tasks by their anchor. An anchor with more than MANY different stretches is dealt anew, by finer keys: windows that begin at
like distances from the anchor (bands of BANDS[0] distances, then BANDS[1], ...) share all the bytes that lie in each of them, so equal
windows meet at the hash of these. Each deal first takes equal strings as one, which repeat whole, and leaves out what is alone
under its key; so rows grow with the number of stretches, and no key needs all its stretches in one task. In the last deal a band is
one window. Index keeps such a family over batches that come one after the other, its levels being tables in order of anchor.

Strings are judged on the input. Texts are UTF-8 bytes, null is empty; matches don't cross
documents; copies and repeated rows are matches of each other. Texts below `length` bytes are kept.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import forget, scratch, small_batches, stored, trimmed

GRAM = 32
MANY = 2000
BANDS = (32, 8, 1)
PART = 1 << 20
BASE = 0x9E3779B97F4A7C15


class Hasher:
    """Content hashes of substrings by prefix sums, for up to PART + length bytes at once."""

    def __init__(self, extra: int):
        self.values = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
        n = PART + extra + 1
        self.up, self.down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
        with np.errstate(over="ignore"):
            for powers in (self.up, self.down):
                powers[0] = 1
                np.cumprod(powers, out=powers)

    def sums(self, data: bytes) -> np.ndarray:
        c = np.frombuffer(data, np.uint8)
        out = np.zeros(len(c) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.values[c] * self.up[: len(c)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, starts, ends) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (sums[ends] - sums[starts]) * self.down[starts]
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def parts_of(data: bytes, length: int):
    """(offset, bytes): parts that overlap so that every window lies whole in exactly one."""
    at = 0
    while True:
        yield at, data[at : at + PART + length - 1]
        at += PART
        if at + length > len(data):
            return


def stretches(data: bytes, hasher: Hasher, length: int):
    """(anchor hash, content hash, first byte, size, anchor's offset) of each stretch of one part."""
    w = length - GRAM + 1
    sums = hasher.sums(data)
    n = len(data) - GRAM + 1
    at = np.arange(n, dtype=np.uint64)
    grams = hasher.hashes(sums, slice(0, n), slice(GRAM, GRAM + n))
    low = (grams & ~np.uint64((1 << 24) - 1)) | at  # the leftmost of equals
    reach = 1
    while 2 * reach <= w:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < w:
        low = np.minimum(low[: len(low) - (w - reach)], low[w - reach :])
    new = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    stop = np.concatenate([new[1:], [len(low)]]) - 1 + length
    anchor = (low[new] & np.uint64((1 << 24) - 1)).astype(np.int64)
    return grams[anchor].view(np.int64), hasher.hashes(sums, new, stop).view(np.int64), new, stop - new, anchor - new


def stretch_table(rows: DataFrame, length: int) -> DataFrame:
    """rows(key, text) -> (key, anchor, content, at, size)."""

    def run(batches):
        hasher = Hasher(length)
        for batch in batches:
            found = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                if len(data) < length:
                    continue
                for base, part in parts_of(data, length):
                    if len(part) >= length:
                        a, c, at, size, _ = stretches(part, hasher, length)
                        found.append((np.full(len(a), key), a, c, at + base, size))
            if found:
                cols = [np.concatenate(x) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3].astype(np.int64)), pa.array(cols[4].astype(np.int32))], names=["key", "anchor", "content", "at", "size"])

    return rows.mapInArrow(run, "key long, anchor long, content long, at long, size int")


class Family:
    """Suffix arrays of windows in levels of doubling size; add() marks what repeats.

    A suffix is named by its number in the order of adding; marks holds one bit each.
    """

    def __init__(self, length: int):
        self.kind = f"S{length}"
        self.length = length
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # sorted windows, their numbers
        self.marks = np.zeros(0, bool)

    def add(self, strings: list[bytes]) -> None:
        data = np.frombuffer(b"".join(strings), np.uint8)
        sizes = np.array([len(s) for s in strings])
        starts = np.concatenate([np.arange(n - self.length + 1) + base for n, base in zip(sizes, np.cumsum(sizes) - sizes, strict=True)])
        windows = np.lib.stride_tricks.as_strided(data, (len(data) - self.length + 1, self.length), (1, 1))[starts]
        windows = np.ascontiguousarray(windows).view(self.kind).ravel()
        numbers = np.arange(len(windows)) + len(self.marks)
        self.marks = np.concatenate([self.marks, np.zeros(len(windows), bool)])
        order = np.argsort(windows, kind="stable")
        new = (windows[order], numbers[order])
        self.mark_equals(*new)
        for level in self.levels:
            self.scan(new, level)
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            self.levels[-2:] = [self.merged(*self.levels[-2:])]

    def mark_equals(self, windows: np.ndarray, numbers: np.ndarray) -> None:
        same = windows[1:] == windows[:-1]
        self.marks[numbers[1:][same]] = True
        self.marks[numbers[:-1][same]] = True

    def scan(self, new, level) -> None:
        """Marks on both sides; a level's equals were marked when they met."""
        at = np.minimum(np.searchsorted(level[0], new[0]), len(level[0]) - 1)
        same = level[0][at] == new[0]
        self.marks[new[1][same]] = True
        self.marks[level[1][at[same]]] = True

    @staticmethod
    def merged(a, b):
        windows, numbers = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(windows, kind="stable")  # two sorted runs: one linear merge
        return windows[order], numbers[order]


def spans(marks: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte spans covered by the marked windows of one string."""
    on = np.flatnonzero(marks)
    if not len(on):
        return []
    cut = np.flatnonzero(on[1:] > on[:-1] + length) + 1
    return [(int(g[0]), int(g[-1]) + length) for g in np.split(on, cut)]


def indexed(batches, length: int, windows: int = 60_000):
    """Rows (anchor, key, at, bytes) in order of anchor -> (key, from, to).

    Equal windows have equal anchors, so a family lasts until the anchor changes and enough has been indexed.
    """
    family, owners, waiting, size, anchor = Family(length), [], [], 0, None

    def finish():
        nonlocal family, owners
        first = 0
        out = []
        for key, at, n in owners:
            out += [(key, at + a, at + b) for a, b in spans(family.marks[first : first + n], length)]
            first += n
        family, owners = Family(length), []
        return out

    def flush():
        nonlocal waiting, size
        if waiting:
            family.add(waiting)
        waiting, size = [], 0

    for batch in batches:
        made = []
        for a, key, at, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= windows:
                flush()
                if a != anchor and len(family.marks) >= 4 * windows:
                    made += finish()
            anchor = a
            waiting.append(data)
            owners.append((key, at, len(data) - length + 1))
            size += len(data) - length + 1
        if made:
            yield span_batch(made)
    flush()
    if made := finish():
        yield span_batch(made)


def span_batch(made: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], pa.int64()) for i in range(3)], names=["key", "from", "to"])


def banded(batches, length: int, band: int):
    """Rows (deal, key, at, data, lead) -> (deal, content, key, at, data, lead): the windows of each band, under their common bytes.

    data holds windows in a row, lead is the anchor's place in it (below 0 where the anchor lies before it).
    """
    hasher = Hasher(length)
    for batch in batches:
        out = []
        for _, key, at, data, lead in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sums, n = hasher.sums(data), len(data) - length + 1
            for k in range((lead - n + 1) // band, lead // band + 1):
                first, last = max(0, lead - k * band - band + 1), min(n - 1, lead - k * band)  # windows with this distance // band
                core = [lead - k * band, lead - k * band - band + 1 + length]
                deal, content = hasher.hashes(sums, np.array([core[0], first]), np.array([core[1], last + length])).view(np.int64).tolist()
                out.append((deal ^ k, content, key, at + first, data[first : last + length], lead - first))
        if out:
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary()), pa.array(cols[5], pa.int32())], names=["deal", "content", "key", "at", "data", "lead"])


def lead(data: bytes, hasher: Hasher) -> int:
    """The anchor's place in a stretch: its grams' smallest hash, the leftmost of equals."""
    n = len(data) - GRAM + 1
    grams = hasher.hashes(hasher.sums(data), slice(0, n), slice(GRAM, GRAM + n))
    return int(((grams & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)).argmin())


def dealt_anew(pieces: DataFrame, length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Pieces of keys with too many -> spans (key, from, to) of what repeats whole, and pieces under keys that fit a task."""
    spans_found, fitting = [], []
    for band in BANDS:
        if pieces.isEmpty():
            break
        made = stored(pieces.mapInArrow(lambda b, band=band: banded(b, length, band), "deal long, content long, key long, at long, data binary, lead int"), "bands")
        same = made.groupBy("deal", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("key", "at")).alias("r"))
        deals = same.groupBy("deal").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("kinds")).where("n > 1")
        same = stored(same.join(deals, "deal").select("deal", "content", "copies", "r", "kinds"), "band-contents")
        whole = made.join(same.where("copies > 1").select("deal", "content"), ["deal", "content"], "left_semi")
        spans_found.append(whole.select("key", F.col("at").alias("from"), (F.col("at") + F.octet_length("data")).alias("to")))
        left = same.where("kinds > 1").select("deal", "content", "r", (F.col("kinds") > MANY).alias("many"))
        left = made.join(left, ["deal", "content"]).where((F.col("key") == F.col("r.key")) & (F.col("at") == F.col("r.at"))).select(F.col("deal").alias("anchor"), "key", "at", "data", "lead", "many")
        left = stored(left, "band-pieces")
        fitting.append(left.where("NOT many").select("anchor", "key", "at", "data"))
        pieces = left.where("many").drop("many")
    return spans_found, fitting


def repeated_spans(rows: DataFrame, length: int, levels: list[Level] = ()) -> tuple[DataFrame, DataFrame]:
    """rows(key, text) -> stored tables: (key, from, to), the spans of bytes to remove, which may overlap, and the stretches of rows.

    levels: what earlier batches hold; the spans of these are among the result too.
    """
    spark = rows.sparkSession
    own = stored(stretch_table(rows, length), "stretches")
    occ = own
    for level in levels:  # a merge-scan: both sides are in order of anchor
        occ = occ.unionByName(level.stretches.join(own.select("anchor").distinct(), "anchor", "left_semi"))
        rows = rows.unionByName(level.texts)
    anchors = occ.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi")).where("n > 1")
    shared = stored(occ.join(anchors.select("anchor", (F.col("lo") != F.col("hi")).alias("mixed")), "anchor"), "shared")
    contents = shared.where("mixed").groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("key", "at", "size")).alias("r"))
    contents = stored(contents, "contents")
    alike = shared.join(contents.where("copies > 1").select("anchor", "content"), ["anchor", "content"], "left_semi").unionByName(shared.where("NOT mixed"))
    whole = alike.select("key", F.col("at").alias("from"), (F.col("at") + F.col("size")).alias("to"))
    # Each content once, cut from one text that holds it.
    many = contents.groupBy("anchor").count().where(F.col("count") > MANY).select("anchor", F.lit(True).alias("many"))
    cuts = contents.join(many, "anchor", "left").select("r.key", F.struct("anchor", "r.at", "r.size", F.coalesce("many", F.lit(False)).alias("many")).alias("cut"))
    cuts = cuts.groupBy("key").agg(F.collect_list("cut").alias("cuts")).withColumnRenamed("key", "k")
    texts = rows.join(cuts.hint("shuffle_hash"), F.col("key") == F.col("k")).select("key", "text", "cuts").dropDuplicates(["key"])

    def cut(batches):
        hasher = Hasher(length)
        for batch in batches:
            out = []
            for key, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                out += [(c["anchor"], key, c["at"], data[c["at"] : c["at"] + c["size"]], c["many"]) for c in own]
            if out:
                a, k, at, data, is_many = zip(*out, strict=True)
                places = [lead(x, hasher) if m else 0 for x, m in zip(data, is_many, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(k, pa.int64()), pa.array(at, pa.int64()), pa.array(data, pa.binary()), pa.array(places, pa.int32()), pa.array(is_many, pa.bool_())], names=["anchor", "key", "at", "data", "lead", "many"])

    small_batches(spark)
    pieces = stored(texts.mapInArrow(cut, "anchor long, key long, at long, data binary, lead int, many boolean"), "pieces")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    found, fitting = dealt_anew(pieces.where("many").drop("many"), length)
    cold = pieces.where("NOT many").select("anchor", "key", "at", "data")
    for more in fitting:
        cold = cold.union(more)
    cold = cold.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda b: indexed(b, length), "key long, from long, to long")
    for more in (cold, *found):
        whole = whole.union(more)
    return stored(whole.distinct(), "spans"), own


class Level(NamedTuple):
    """Batches of an index: their stretches in order of anchor, their texts by key, and the number of stretches."""

    stretches: DataFrame
    texts: DataFrame
    size: int


class Index:
    """A logarithmic family over batches that come one after the other, each level being a pair of stored tables.

    A batch is met with itself and with every level; then it becomes a level of its own, and levels of like size
    merge, so that a stretch is written O(log n) times and a batch meets O(log n) tables.
    """

    def __init__(self, length: int = 200):
        self.length, self.levels = length, []

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
        """remove_repeats() of a batch, for which strings of all earlier batches count as starting elsewhere."""
        small_batches(docs.sparkSession)
        rows = keyed(docs, text)
        with scratch() as keep:
            found, own = repeated_spans(rows, self.length, self.levels)
            new = self.level(own, rows)
            while self.levels and self.levels[-1].size <= 2 * new.size:
                last = self.levels.pop()
                merged = self.level(last.stretches.unionByName(new.stretches), last.texts.unionByName(new.texts))
                for df in (last.stretches, last.texts):
                    forget(df)
                new = merged
            self.levels.append(new)
            for df in (found, new.stretches, new.texts):
                keep(df)
        return without(docs, found, doc_id, text, with_text)

    @staticmethod
    def level(stretches: DataFrame, texts: DataFrame) -> Level:
        made = stored(stretches.repartitionByRange("anchor").sortWithinPartitions("anchor"), "level")
        return Level(made, stored(texts.dropDuplicates(["key"]), "level-texts"), made.count())


def keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(text).alias("text"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]): a row per document. kept is binary: a cut may split a character."""
    small_batches(docs.sparkSession)
    with scratch() as keep:
        found, _ = repeated_spans(keyed(docs, text), length)
        keep(found)
    return without(docs, found, doc_id, text, with_text)


def without(docs: DataFrame, found: DataFrame, doc_id: str, text: str, with_text: bool) -> DataFrame:
    """docs without the spans found, as remove_repeats() returns them."""
    spark = docs.sparkSession
    own = found.groupBy("key").agg(F.collect_list(F.struct("from", "to")).alias("spans")).withColumnRenamed("key", "k")
    joined = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"))
    joined = joined.join(own.hint("shuffle_hash"), F.col("key") == F.col("k"), "left").select("doc_id", "t", "spans")

    def run(batches):
        for batch in batches:
            cols = [[] for _ in range(5)]
            for t, mine in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (t or "").encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                for s in sorted((s["from"], s["to"]) for s in mine or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append([s[0], s[1]])
                at, kept = 0, []
                for a, b in merged:
                    kept.append(data[at:a])
                    at = b
                left = b"".join([*kept, data[at:]])
                for c, v in zip(cols, (len(data), len(data) - len(left), len(merged), hashlib.sha256(left).hexdigest(), left), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 4 + with_text]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    small_batches(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    return joined.mapInArrow(trimmed(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
