"""Quality classifier by co-training two views.

Text view: hashed words and word shapes (case, trailing marks, length) as shares of a text, plus a few
figures of the whole text. Metadata view: source, language and length class. Each view has a logistic classifier.
Over ROUNDS rounds each classifier labels the unlabelled documents it is surest of, in the
proportion of the classes, for the other one to learn from. All documents but the labelled ones taken take part: the sparse rows of
all documents are stored once (prepare), each round scores them where they lie, a histogram over all of them gives the thresholds (ties at one
are split by a hash of the document), and both views go on with STEPS gradient steps over the labelled rows and the sums over all
pseudo-labelled ones. Sums are of integers, so they don't depend on partitions. On labelled documents held back
from that, each view's logit is calibrated (a scale and an offset) and a logistic on both combines them;
the result scores every document.

Bounds: LABELLED labelled documents, taken by hash of the id, go to the driver (a parameter), and their ids to all tasks; of the
others, those with labels beyond that number included, it gets histograms and sums of a fixed size. Scoring reads all documents, or
their stored rows, in one pass without a shuffle.

Null text counts as empty, null metadata as a value of its own. Labels that are null or without a
document are not used; of several labels of one id the largest counts. With labels of one class only, or none,
all scores are that class's share (0.5 without labels). Rows with equal ids are scored each by itself, and so
they are as unlabelled documents; of labelled ones with equal ids the least row trains. Those with null ids are unlabelled. An empty
table gives an empty result. Other columns of docs and labels, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.base import append_columns, parts_of, scratch, small_batches, stored, trimmed

LABELLED = 6000
ROUNDS = 4
STEPS = 12
GROWTH = 0.05
SURE = 0.9
FINE = 50  # buckets of a histogram in one unit of a logit
TOP = 2000
UNIT = 1 << 24  # of a gradient sum
WIDTH = 1 << 12
MARKS = re.compile(r"[^\w\s]+$")
FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("quality_pred", T.IntegerType()), T.StructField("text_score", T.DoubleType()), T.StructField("meta_score", T.DoubleType()), T.StructField("keep", T.BooleanType())]


def word_slots(word: str) -> tuple[int, int]:
    """Feature of the bare lower-case word, and of its shape."""
    tail = MARKS.search(word)
    bare = word[: tail.start()] if tail else word
    case = "U" if len(bare) > 1 and bare.isupper() else "C" if bare[:1].isupper() else "l" if bare.isalpha() else "o"
    shape = f"{case}{tail.group() if tail else ''}|{min(len(bare), 20) // 4}"
    return zlib.crc32(bare.lower().encode("utf-8", "surrogatepass")) % (WIDTH - 512), WIDTH - 512 + zlib.crc32(shape.encode("utf-8", "surrogatepass")) % 512


class TextView:
    """Sparse rows: WIDTH hashed shares and 4 figures."""

    SIZE = WIDTH + 4

    def __init__(self, memory: int = 200_000):
        self.known, self.memory = {}, memory

    def slots(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.memory:
            known.clear()
        for w in set(words).difference(known):
            known[w] = word_slots(w)
        return np.array([known[w] for w in words], np.int64).reshape(-1)

    def row(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        counts, n, kinds, repeats = np.zeros(WIDTH), 0, 0, 0
        for part in parts_of(text or ""):
            words = part.split()
            if words:
                counts += np.bincount(self.slots(words), minlength=WIDTH)
                n += len(words)
                kinds += len(set(words))
                repeats += sum(map(str.__eq__, words, words[1:]))
        at = np.flatnonzero(counts)
        share = np.sqrt(counts[at] / max(n, 1))
        figures = [n == 0, kinds / max(n, 1) ** 0.8, repeats / max(n, 1), min(np.log1p(n) / 10, 1.5)]
        return np.concatenate([at, WIDTH + np.arange(4)]).astype(np.int32), np.concatenate([share, figures]).astype(np.float32)


def meta_row(source, lang, n_chars) -> tuple[np.ndarray, np.ndarray]:
    names = (f"s{source}", f"l{lang}", f"n{None if n_chars is None else int(np.log2(max(n_chars, 0) + 1))}", f"s{source}l{lang}")
    return np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) % 1024 for x in names], np.int32), np.ones(4, np.float32)


class Logistic:
    """Logistic regression on sparse rows, by gradient steps with momentum and a scale per feature."""

    def __init__(self, size: int):
        self.w, self.b = np.zeros(size), 0.0
        self.start()

    def start(self):
        self.t, self.m, self.v, self.mb, self.vb = 0, np.zeros_like(self.w), np.zeros_like(self.w), 0.0, 0.0

    def move(self, gw: np.ndarray, gb: float):
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * gw, 0.99 * self.v + 0.01 * gw * gw
        self.mb, self.vb = 0.9 * self.mb + 0.1 * gb, 0.99 * self.vb + 0.01 * gb**2
        fix = (1 - 0.99**self.t) ** 0.5 / (1 - 0.9**self.t)
        self.w -= 0.1 * fix * self.m / (self.v**0.5 + 1e-8)
        self.b -= 0.1 * fix * self.mb / (self.vb**0.5 + 1e-8)

    def fit(self, rows, y: np.ndarray, steps: int = 150, decay: float = 1e-4):
        at, value, owner = flat(rows)
        n, pos = len(rows), y.mean()
        weight = np.where(y > 0, 0.5 / max(pos, 1e-9), 0.5 / max(1 - pos, 1e-9)) / n
        self.start()
        for _ in range(steps):
            z = np.bincount(owner, value * self.w[at], n) + self.b
            g = (1 / (1 + np.exp(-z)) - y) * weight
            self.move(np.bincount(at, value * g[owner], len(self.w)) + decay * self.w, g.sum())
        return self

    def logits(self, at, value, owner, n: int) -> np.ndarray:
        return np.bincount(owner, value * self.w[at], n) + self.b


def flat(rows):
    at, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    return at, value, np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])


def columns(batch: pa.RecordBatch, at: str, value: str):
    """flat() of two list columns."""
    sizes = batch.column(at).value_lengths().to_numpy(zero_copy_only=False)
    return batch.column(at).flatten().to_numpy(), batch.column(value).flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)


def class_sums(w: np.ndarray, b: float, at, value, owner, y: np.ndarray) -> np.ndarray:
    """For each class, in units: gradient sums by feature, of the offset, and the number of rows."""
    n = len(y)
    miss = 1 / (1 + np.exp(-np.clip(np.bincount(owner, value * w[at], n) + b, -50, 50))) - y
    part = np.rint(value * miss[owner] * UNIT)
    on = (y > 0)[owner]
    return np.array([np.concatenate([np.bincount(at[k], part[k], len(w)), [np.rint(miss[c] * UNIT).sum(), c.sum()]]) for k, c in ((~on, y <= 0), (on, y > 0))])


class Pool:
    """The unlabelled documents (u, ta, tv, ma, mv), rows of a stored table, and what each view was given of them."""

    NAMES = (("ta", "tv"), ("ma", "mv"))

    def __init__(self, rows: DataFrame):
        self.rows, self.history, self.given = rows, [], []

    def sums(self, df: DataFrame, run) -> dict[int, int]:
        small_batches(df.sparkSession, 2000)
        found = df.mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
        return dict(zip(found.column("slot").to_pylist(), found.column("n").to_pylist(), strict=True))

    @staticmethod
    def marks(batch: pa.RecordBatch, history) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The labels given to each view so far (nan: none), and the numbers of the rounds."""
        n, u = batch.num_rows, batch.column("u").to_numpy()
        given, turn = [np.full(n, np.nan) for _ in (0, 1)], [np.full(n, -1) for _ in (0, 1)]
        sets = [columns(batch, *names) for names in Pool.NAMES]
        for r, (views, cuts) in enumerate(history):
            for k in (0, 1):
                at, value, owner = sets[k]
                z = np.bincount(owner, value * views[k][0][at], n) + views[k][1]
                for label in (0, 1):
                    bucket, (edge, share) = Pool.bucket(z if label else -z), cuts[k, label]
                    on = (bucket >= 0) & np.isnan(given[1 - k]) & ((bucket > edge) | ((bucket == edge) & (u < share)))
                    given[1 - k][on], turn[1 - k][on] = label, r
        return given, turn

    @staticmethod
    def bucket(side: np.ndarray) -> np.ndarray:
        """Below 0 where a view is not sure."""
        return np.minimum(np.floor((side - np.log(SURE / (1 - SURE))) * FINE), TOP - 1).astype(np.int64)

    def grow(self, views: list[Logistic], share: float) -> bool:
        """Give each view the documents that the other one is surest of; false if there are none at all."""
        history, now = list(self.history), [(v.w.copy(), v.b) for v in views]

        def count(batches):
            out = np.zeros(4 * TOP + 1, np.int64)
            for batch in batches:
                given, _ = Pool.marks(batch, history)
                out[-1] += batch.num_rows
                for k in (0, 1):
                    at, value, owner = columns(batch, *Pool.NAMES[k])
                    z = np.bincount(owner, value * now[k][0][at], batch.num_rows) + now[k][1]
                    for label in (0, 1):
                        bucket = Pool.bucket(z if label else -z)[np.isnan(given[1 - k])]
                        out[(2 * k + label) * TOP : (2 * k + label + 1) * TOP] += np.bincount(bucket[bucket >= 0], minlength=TOP)
            yield filled(out)

        found, cuts = self.sums(self.rows, count), {}
        n = found.get(4 * TOP, 0)
        if not n:
            return False
        for k in (0, 1):
            for label in (0, 1):
                left, cuts[k, label] = max(1, int(GROWTH * n * (share if label else 1 - share))), (-1, 0)
                for bucket in range(TOP - 1, -1, -1):
                    have = found.get((2 * k + label) * TOP + bucket, 0)
                    if have > left:
                        cuts[k, label] = (bucket, int(left / have * (1 << 20)))
                        break
                    left -= have
        self.history.append((now, cuts))
        history = list(self.history)

        def take(batches):
            for batch in batches:
                given, turn = Pool.marks(batch, history)
                for k in (0, 1):
                    on = np.flatnonzero(turn[k] == len(history) - 1)
                    mine = batch.take(pa.array(on))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), k, np.int32)), pa.array(given[k][on]), *(mine.column(c) for c in Pool.NAMES[k])], names=["k", "y", "at", "value"])

        small_batches(self.rows.sparkSession, 2000)
        self.given.append(stored(self.rows.mapInArrow(take, "k int, y double, at array<int>, value array<float>"), "pseudo-labelled"))
        return True

    def gradients(self, views: list[Logistic]) -> list[np.ndarray]:
        """class_sums of both views over all that was given so far."""
        now = [(v.w.copy(), v.b) for v in views]
        width = max(len(w) for w, _ in now) + 2
        rows = self.given[0]
        for more in self.given[1:]:
            rows = rows.unionAll(more)

        def run(batches):
            out = np.zeros((2, 2, width))
            for batch in batches:
                own = batch.column("k").to_numpy()
                for k in (0, 1):
                    on = np.flatnonzero(own == k)
                    if len(on):
                        mine = batch.take(pa.array(on))
                        sums = class_sums(*now[k], *columns(mine, "at", "value"), mine.column("y").to_numpy())
                        out[k, :, : sums.shape[1]] += sums
            yield filled(out.astype(np.int64).reshape(-1))

        found, flat_out = self.sums(rows, run), np.zeros(4 * width)
        flat_out[list(found)] = list(found.values())
        return [flat_out.reshape(2, 2, width)[k][:, : len(now[k][0]) + 2] for k in (0, 1)]


def filled(sums: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(sums)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["slot", "n"])


def dense_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Weights and offset by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, a.T @ (p - y) + ridge * w)
    return w[:-1], w[-1]


class Model:
    """Two views, their calibrations and the combination."""

    def __init__(self, share: float):
        self.share, self.views = share, None

    def train(self, text_rows, meta_rows, y, pool: Pool, decay: float = 1e-4):
        held = np.arange(len(y)) % 4 == 0
        pick = lambda rows, on: [r for r, k in zip(rows, on, strict=True) if k]
        own, sets = y[~held], [pick(text_rows, ~held), pick(meta_rows, ~held)]
        views = [Logistic(size).fit(rows, own) for size, rows in zip((TextView.SIZE, 1024), sets, strict=True)]
        known = [flat(rows) for rows in sets]
        for _ in range(ROUNDS):
            if not pool.grow(views, self.share):
                break
            for view in views:
                view.start()
            for _ in range(STEPS):
                for view, rows, more in zip(views, known, pool.gradients(views), strict=True):
                    sums = class_sums(view.w, view.b, *rows, own) + more
                    g = sum(0.5 / max(c[-1], 1) / UNIT * c for c in sums)
                    view.move(g[:-2] + decay * view.w, g[-2])
        logits = np.column_stack([view.logits(*flat(pick(rows, held)), int(held.sum())) for view, rows in zip(views, (text_rows, meta_rows), strict=True)])
        self.views = views
        self.scales = [dense_logistic(logits[:, k : k + 1], y[held]) for k in (0, 1)]
        self.mix = dense_logistic(self.calibrated(logits), y[held])
        return self

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        return np.column_stack([logits[:, k] * self.scales[k][0][0] + self.scales[k][1] for k in (0, 1)])

    def scores(self, text_rows, meta_rows, n: int) -> np.ndarray:
        """Columns: combined, text, metadata, of n flat rows of each view."""
        if self.views is None or not n:
            return np.full((n, 3), self.share)
        both = self.calibrated(np.column_stack([self.views[0].logits(*text_rows, n), self.views[1].logits(*meta_rows, n)]))
        z = np.column_stack([both @ self.mix[0] + self.mix[1], both])
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def features(rows: DataFrame, kept: str) -> DataFrame:
    """The kept column and the sparse rows (ta, tv, ma, mv) of rows (kept, t, s, l, n)."""

    def run(batches):
        view = TextView()
        for batch in batches:
            t, s, l, n = (c.to_pylist() for c in batch.columns[-4:])
            made, meta = [view.row(x) for x in t], [meta_row(*x) for x in zip(s, l, n, strict=True)]
            lists = (pa.array([r[k] for r in rows], kind) for rows in (made, meta) for k, kind in ((0, pa.list_(pa.int32())), (1, pa.list_(pa.float32()))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], *lists], names=[*batch.schema.names[:-4], "ta", "tv", "ma", "mv"])

    small_batches(rows.sparkSession)
    return rows.mapInArrow(trimmed(run), kept + ", ta array<int>, tv array<float>, ma array<int>, mv array<float>")


def prepare(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars") -> DataFrame:
    """A stored table (doc_id, i, u, ta, tv, ma, mv): the sparse rows of every document; u is a hash of it."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"), F.col(source).cast("string").alias("s"), F.col(lang).cast("string").alias("l"), F.col(n_chars).cast("long").alias("n"))
    place = F.pmod(F.xxhash64("i", "t"), F.lit(1 << 20)).cast("int")
    kind = docs.schema[doc_id].dataType.simpleString()
    return stored(features(rows.select("doc_id", "i", place.alias("u"), "t", "s", "l", "n"), f"doc_id {kind}, i long, u int"), "features")


def fit(rows: DataFrame, labels: DataFrame, target: str = "quality", doc_id: str = "doc_id", labelled: int = LABELLED) -> Model:
    """The model of prepared rows and labels(doc_id, target), the label being 0 or 1."""
    known = labels.select(F.col(doc_id).cast("long").alias("i"), F.col(target).cast("double").alias("y")).where("i IS NOT NULL AND y IS NOT NULL").groupBy("i").agg(F.max("y").alias("y"))
    chosen = known.join(rows.select("i").distinct(), "i", "left_semi").orderBy(F.xxhash64("i"), "i").limit(labelled)
    with scratch():
        chosen = F.broadcast(stored(chosen, "labelled"))  # that many rows at most
        got = rows.join(chosen, "i").groupBy("i", "y").agg(F.min(F.struct("u", "ta", "tv", "ma", "mv")).alias("r")).select("i", "y", "r.*").toArrow().sort_by("i")
        y = got.column("y").to_numpy(zero_copy_only=False)
        share = float(y.mean()) if len(y) else 0.5
        model = Model(share)
        if len(y) < 8 or not 0 < share < 1:
            return model
        lists = [[x.values.to_numpy() for x in got.column(c)] for c in ("ta", "tv", "ma", "mv")]
        text_rows, meta_rows = list(zip(lists[0], lists[1], strict=True)), list(zip(lists[2], lists[3], strict=True))
        mixed = np.random.default_rng(3).permutation(len(y))
        part = lambda rows, on: [rows[i] for i in on]
        pool = Pool(rows.join(chosen.select("i"), "i", "left_anti").select("u", "ta", "tv", "ma", "mv"))
        return model.train(part(text_rows, mixed), part(meta_rows, mixed), y[mixed], pool)


def score_rows(rows: DataFrame, model: Model, cut: float = 0.5) -> DataFrame:
    """(doc_id, score, quality_pred, text_score, meta_score, keep) of prepared rows."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            got = m.scores(columns(batch, "ta", "tv"), columns(batch, "ma", "mv"), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *judged(got, cut)], names=["doc_id", *(f.name for f in FIELDS)])

    small_batches(rows.sparkSession, 2000)
    return rows.select("doc_id", "ta", "tv", "ma", "mv").mapInArrow(run, T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *FIELDS]))


def judged(got: np.ndarray, cut: float) -> list[pa.Array]:
    keep = got[:, 0] >= cut
    return [pa.array(got[:, 0]), pa.array(keep.astype(np.int32)), pa.array(got[:, 1]), pa.array(got[:, 2]), pa.array(keep)]


def score(docs: DataFrame, model: Model, text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", cut: float = 0.5) -> DataFrame:
    """docs with score (that the document is of quality), quality_pred, the views' scores and keep (score >= cut)."""
    sent, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    at = [names.index(c) for c in (text, source, lang, n_chars)]

    def make():
        view, m = TextView(), sent.value

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            t, s, l, n = (batch.column(i).to_pylist() for i in at)
            if not t:
                return judged(np.zeros((0, 3)), cut)
            return judged(m.scores(flat([view.row(x) for x in t]), flat([meta_row(*x) for x in zip(s, l, n, strict=True)]), len(t)), cut)

        return work

    return append_columns(docs, FIELDS, make)
