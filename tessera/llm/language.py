"""Language identification by interpolated Kneser-Ney character models.

Model. Words (runs of letters, which are the Unicode categories L*, lower case) with a start and an end mark give character n-grams
up to ORDER; contexts stay within a word. Per language and order the discounted, interpolated
log-probabilities lie in arrays sorted by n-gram hash, with the log of each context's share for
the next lower order beside them. A hash keeps BITS bits, so a language's arrays are bounded
by ORDER * 2**BITS entries whatever the corpus; that is the proven bound of what the driver
gathers and of the broadcast. Counts cover every training document.

Decision. The language of lowest cross-entropy per character. A scale for the log-likelihoods
is fitted on training documents held back from the counts (one in HOLD by hash of the id), and
so is each language's rejection bound: the 99.9th percentile of the cross-entropy of its own
held-back documents plus MARGIN nats. A language with fewer than FEW rightly predicted ones has the percentile, over all
languages, of the excess over a language's mean, added to its own mean; without any such document the highest mean
of a language counts as its own, and if no document at all was held back or none rightly predicted, the training documents stand in. So
every language has a finite bound. `rejected` is true for documents above it and for those
without any letter.

Null or letterless text: `und`, score 0, rejected. No training rows: all are `und`.
Rows with a null language or id never train. Repeated rows count as often as they occur.
Very long texts are taken in parts that end behind white space, whole. Columns of any name may stand beside id, text and lang;
those named like an output are replaced.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.base import append_columns, parts_of, small_batches, trimmed

ORDER = 4
BITS = 20
HOLD = 8
MARGIN = 0.5
FEW = 20
RUN = 100_000
SCORED = 16_384  # words at once, which bounds the arrays of their n-grams
SCALES = [2.0**-k for k in range(0, 9)]
LETTERS = re.compile(r"[^\W\d_]+")
#: Numerals that this class holds and that are no letters; a set finds them in a text faster than a pattern of so many.
NUMERALS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("No", "Nl"))
START, END = 2, 3
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]


def words_of(text: str):
    """Lists of the words of a text, a part at a time."""
    for part in parts_of(text):
        if not part.isascii() and (odd := NUMERALS.intersection(part)):
            part = part.translate({ord(c): " " for c in odd})
        yield LETTERS.findall(part.lower())


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def grams(words: list[str]):
    """For each order n: hashes of the n-grams, of their contexts and of their lower grams, the
    word of each, and whether it begins with the start mark."""
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    base = np.uint64(0x100000001B3)
    with np.errstate(over="ignore"):
        sums = [np.zeros(len(codes), np.uint64)]  # sums[n][i]: of the n codes that end at i
        power = np.uint64(1)
        for n in range(1, ORDER + 1):
            new = np.zeros(len(codes), np.uint64)
            new[n - 1 :] = sums[n - 1][n - 1 :] + (codes[: len(codes) - n + 1] + np.uint64(1)) * power
            sums.append(new)
            power = power * base
        short = np.uint64(64 - BITS)
        key = [mixed(s + np.uint64(n * 7919)) >> short for n, s in enumerate(sums)]
    for n in range(1, ORDER + 1):
        at = np.flatnonzero((place >= max(1, n - 1)))
        yield n, at, key[n][at], key[n - 1][at - 1], key[n - 1][at], owner[at], place[at] == n - 1


def gram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, ord, gram, ctx, low, starts, n): counts of n-grams, made in each task before the shuffle."""
    schema = "lang string, ord int, gram long, ctx long, low long, starts boolean, n long"

    def run(batches):
        held, size = {}, 0

        def flush():
            for name, counter in held.items():
                if not counter:
                    continue
                words, times = list(counter), np.fromiter(counter.values(), np.int64, len(counter))
                for n, _, gram, ctx, low, owner, starts in grams(words):
                    uniq, first, back = np.unique(gram, return_index=True, return_inverse=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(uniq), pa.string()), pa.array(np.full(len(uniq), n, np.int32)), pa.array(uniq.astype(np.int64)), pa.array(ctx[first].astype(np.int64)), pa.array(low[first].astype(np.int64)), pa.array(starts[first]), pa.array(np.bincount(back, times[owner]).astype(np.int64))],
                        names=["lang", "ord", "gram", "ctx", "low", "starts", "n"],
                    )
            held.clear()

        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counter = held.setdefault(name, Counter())
                for words in words_of(t or ""):
                    counter.update(words)
            size = sum(map(len, held.values()))
            if size > 400_000:
                yield from flush()
        yield from flush()

    small_batches(docs.sparkSession)
    made = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).mapInArrow(trimmed(run), schema)
    return made.groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n"), F.min("ctx").alias("ctx"), F.min("low").alias("low"), F.max("starts").alias("starts"))


class Model:
    """Sorted hash arrays of all languages; bounds and scale are filled in by calibration."""

    def __init__(self, counts: pa.Table):
        names = counts.column("lang").to_numpy(zero_copy_only=False).astype(str) if counts.num_rows else np.array([], str)
        self.langs = sorted(set(names.tolist()))
        self.scale, self.bound = 1.0, np.full(len(self.langs), np.inf)
        col = {c: counts.column(c).to_numpy(zero_copy_only=False) for c in ("ord", "gram", "ctx", "low", "starts", "n")}
        self.grams, self.ctxs, self.base = [], [], []
        for lang in self.langs:
            mine = names == lang
            rows = {n: {c: v[mine & (col["ord"] == n)] for c, v in col.items()} for n in range(1, ORDER + 1)}
            below = None
            g_arrays, c_arrays = [], []
            for n in range(1, ORDER + 1):
                r = rows[n]
                order = np.argsort(r["gram"])
                r = {c: v[order] for c, v in r.items()}
                count = r["n"].astype(float)
                if n < ORDER:
                    # Continuations: different symbols before the gram. One that begins a word has none.
                    kinds, found = np.unique(rows[n + 1]["low"], return_counts=True)
                    at = np.clip(np.searchsorted(kinds, r["gram"]), 0, max(0, len(kinds) - 1))
                    hit = (kinds[at] == r["gram"]) if len(kinds) else np.zeros(len(at), bool)
                    cont = np.where(hit, found[at] if len(kinds) else 0, 0).astype(float)
                    starts = r["starts"].astype(bool) if n > 1 else np.zeros(len(at), bool)
                    count = np.where(starts | (cont == 0), count if n > 1 else np.maximum(cont, 1), cont)
                ones, twos = (count == 1).sum(), (count == 2).sum()
                cut = ones / (ones + 2 * twos) if ones and twos else 0.5
                ctx, where = np.unique(r["ctx"], return_inverse=True)
                total, kinds = np.bincount(where, count, len(ctx)), np.bincount(where, minlength=len(ctx))
                left = cut * kinds / np.maximum(total, 1e-300)
                lower = np.full(len(count), 1.0 / max(2, len(rows[1]["gram"]) + 1)) if below is None else below(r["low"])
                p = (count - cut) / np.maximum(total[where], 1e-300) + left[where] * lower
                keys, logs = r["gram"], np.log(np.maximum(p, 1e-12))
                g_arrays.append((keys, logs.astype(np.float32)))
                c_arrays.append((ctx, np.log(np.maximum(left, 1e-12)).astype(np.float32)))

                def below(low, keys=keys, p=p):
                    at = np.clip(np.searchsorted(keys, low), 0, len(keys) - 1)
                    return np.where(keys[at] == low, p[at], 1e-6)

            self.grams.append(g_arrays)
            self.ctxs.append(c_arrays)
            self.base.append(-np.log(max(2, len(rows[1]["gram"]) + 1)) - 3)

    def score(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word by language."""
        out = np.zeros((len(words), len(self.langs)))
        # Each distinct hash is looked up once for all its places, in ascending order.
        rows = list(grams(words))
        parts = [(n, at, distinct(gram), distinct(ctx)) for n, at, gram, ctx, _, _, _ in rows]
        total = parts[0][1][-1] + 1
        for k in range(len(self.langs)):
            logs = np.full(total, self.base[k], np.float64)
            for n, at, (gram, g), (ctx, c) in parts:
                keys, values = self.grams[k][n - 1]
                cs, lefts = self.ctxs[k][n - 1]
                if not len(keys):
                    continue
                i = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
                j = np.minimum(np.searchsorted(cs, ctx), len(cs) - 1)
                known, left = keys[i] == gram, np.where(cs[j] == ctx, lefts[j], 0)
                logs[at] = np.where(known[g], values[i][g], left[c] + logs[at])
            out[:, k] = np.bincount(rows[0][5], logs[rows[0][1]], len(words))
        return out


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of BITS bits in ascending order, and the place of each hash among them."""
    at = hashes.astype(np.int64)
    seen = np.zeros(1 << BITS, bool)
    seen[at] = True
    place = np.cumsum(seen, dtype=np.int32) - 1
    return np.flatnonzero(seen), place[at]


class Scorer:
    """Sums of word scores, each word's remembered while memory lasts."""

    def __init__(self, model: Model, memory: int = 300_000):
        self.m, self.memory = model, memory
        self.clear()

    def clear(self):
        self.rows, self.values = {}, np.zeros((1024, len(self.m.langs) + 1))

    def sums(self, texts: list[str]) -> np.ndarray:
        """Per text: log-likelihood by language, then the number of characters predicted."""
        out = np.zeros((len(texts), len(self.m.langs) + 1))
        words, owners, sizes = [], [], []
        for i, text in enumerate(texts):
            for part in words_of(text):
                words += part
                owners.append(i)
                sizes.append(len(part))
                if len(words) >= RUN:
                    self.add(out, words, np.repeat(owners, sizes))
                    words, owners, sizes = [], [], []
        self.add(out, words, np.repeat(owners, sizes))
        return out

    def add(self, out: np.ndarray, words: list[str], owner: np.ndarray):
        """Add to row owner[i] of out what word i scores; unknown words are scored together."""
        if not words:
            return
        new = list(set(words).difference(self.rows))
        if len(self.rows) + len(new) > self.memory:
            self.clear()
            new = list(set(words))
        if new:
            n = len(self.rows)
            while n + len(new) > len(self.values):
                self.values = np.concatenate([self.values, np.zeros_like(self.values)])
            for i in range(0, len(new), SCORED):
                self.values[n + i : n + min(i + SCORED, len(new)), :-1] = self.m.score(new[i : i + SCORED])
            self.values[n : n + len(new), -1] = [len(w) + 1 for w in new]
            self.rows.update(zip(new, range(n, n + len(new)), strict=True))
        at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        for c in range(out.shape[1]):
            out[:, c] += np.bincount(owner, self.values[at, c], len(out))


def decided(model: Model, sums: np.ndarray):
    """Best language (-1: none), score and cross-entropy of each row of sums."""
    size = sums[:, -1]
    if not model.langs:
        return np.full(len(sums), -1), np.zeros(len(sums)), np.full(len(sums), np.nan)
    own = sums[:, :-1]
    best = own.argmax(1)
    top = own[np.arange(len(own)), best]
    score = 1 / np.exp((own - top[:, None]) * model.scale).sum(1)
    return np.where(size > 0, best, -1), np.where(size > 0, score, 0.0), np.where(size > 0, -top / np.maximum(size, 1), np.nan)


def fit(train: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """A calibrated model of the languages in train."""
    rows = train.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull())
    held = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(HOLD)) == 0
    model = Model(gram_counts(rows.where(~held), text, lang).toArrow())
    if not model.langs:
        model = Model(gram_counts(rows, text, lang).toArrow())
    if not model.langs:
        return model
    sent = train.sparkSession.sparkContext.broadcast(model)
    width = 0.02

    def run(batches):
        m = sent.value
        scorer, index = Scorer(m), {k: i for i, k in enumerate(m.langs)}
        loss, hist = np.zeros(len(SCALES)), Counter()
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            sums = scorer.sums(texts)
            best, _, entropy = decided(m, sums)
            truth = np.array([index.get(x, -1) for x in batch.column(1).to_pylist()])
            ok = (truth >= 0) & (best >= 0)
            if ok.any():
                own, t = sums[ok, :-1], truth[ok]
                for s, scale in enumerate(SCALES):
                    z = (own - own.max(1, keepdims=True)) * scale
                    loss[s] += (np.log(np.exp(z).sum(1)) - z[np.arange(len(t)), t]).sum()
                right = ok & (best == truth)
                hist.update(zip(best[right].tolist(), (entropy[right] / width).astype(int).tolist(), strict=True))
        keys = [(-1, s, float(v)) for s, v in enumerate(loss)] + [(k, b, float(n)) for (k, b), n in hist.items()]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.float64())], names=["lang", "bucket", "n"])

    small_batches(train.sparkSession)

    def measured(some: DataFrame):
        found = some.select(F.col(text).alias("t"), F.col(lang).alias("l")).mapInArrow(trimmed(run), "lang int, bucket int, n double")
        return found.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()

    found = measured(rows.where(held))
    losses = found[found["lang"] < 0].set_index("bucket")["n"]
    if len(losses) and losses.max() > 0:
        model.scale = SCALES[int(losses.idxmin())]
    own = found[found["lang"] >= 0]
    if not len(own):
        own = measured(rows)
        own = own[own["lang"] >= 0]
    model.bound = bounds(len(model.langs), own["lang"].to_numpy(), own["bucket"].to_numpy(), own["n"].to_numpy(), width)
    return model


def bounds(n: int, langs: np.ndarray, buckets: np.ndarray, counts: np.ndarray, width: float) -> np.ndarray:
    """The rejection bound of each of n languages, from histograms of the cross-entropies of their documents."""

    def percentile(at, times):
        order = np.argsort(at, kind="stable")
        share = np.cumsum(times[order]) / times.sum()
        return at[order][np.searchsorted(share, 0.999 - 1e-12)] + 1

    if not len(langs):
        return np.full(n, MARGIN)  # no training document has a letter that is predicted rightly
    sizes, sums = np.bincount(langs, counts, n), np.bincount(langs, counts * buckets, n)
    means = np.where(sizes > 0, sums / np.maximum(sizes, 1), (sums / np.maximum(sizes, 1)).max())
    pooled = means + percentile(buckets - means[langs], counts)
    full = [percentile(buckets[langs == k], counts[langs == k]) if sizes[k] >= FEW else pooled[k] for k in range(n)]
    return np.array(full) * width + MARGIN


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score, cross_entropy and rejected."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def make():
        m = sent.value
        scorer = Scorer(m)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            best, score, entropy = (np.concatenate(x) for x in zip(*(decided(m, scorer.sums(texts[i : i + 256])) for i in range(0, len(texts), 256)), strict=True)) if texts else (np.array([]),) * 3
            over = [bool(k < 0 or e > m.bound[k]) for k, e in zip(best, entropy, strict=True)]
            return [pa.array([m.langs[k] if k >= 0 else "und" for k in best.astype(int)], pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64(), from_pandas=True), pa.array(over, pa.bool_())]

        return work

    return append_columns(docs, FIELDS, make)


def held_out(doc_id: str = "doc_id"):
    """Documents that never train: crc32 of the id as text has remainder 1 by 3."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1
