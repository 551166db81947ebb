"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Equal vectors are one row with a count, so groups of copies cost nothing. Centroids are fitted on
SAMPLE vectors at most, taken by hash; there is one for CELL vectors, and MOST_CELLS at most, which bounds the
broadcast. Where that leaves more than CELL vectors to a cell, cells are clustered again, each on a sample of its own
vectors of about SAMPLE, so that cells grow in number and not in size; these centroids go to the
vectors of their cell only. Every vector goes to its nearest cell (home) and visits the PROBES nearest ones, its home among them.
Two vectors meet where one is at home and the other at home or visiting; a pair that meets in two cells counts in the
home of the smaller. A cell's home rows are cut into blocks of about BLOCK and all its rows into parts of about VISITORS; each block meets
each part in one product of double precision, so a row moves once for each cell it visits, unless the cell holds more than one
block or part, and no task holds more than these two. A product gives the number of links of its rows and
a spanning forest of them, not all pairs; components join the forests. The smallest id of a component is the one kept.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing; each is
its own component. Vectors of different lengths never link. Repeated ids are vectors of their own,
in the class of their vector; a null id names no class. An empty table gives an empty result; other columns are not looked at. Recall is
measured by tests against all pairs, with cells of one level and of two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.base import forget, scratch, stored
from tessera.llm.graph import components

SAMPLE = 20_000
MOST_CELLS = 2048
CELL = 400
PROBES = 8
NEAR = 4  # cells of the first level whose cells of the second are looked at
SLICE = 20_000  # rows of a cell that are dealt to the second level together
BLOCK = 1024
VISITORS = 4096
ROUNDS = 12


def spherical_kmeans(x: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """k unit centroids of unit rows x; an empty cell takes a row far from its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = np.empty(len(x), np.int64)
        top = np.empty(len(x))
        for i in range(0, len(x), 4096):
            s = x[i : i + 4096] @ c.T
            near[i : i + 4096] = s.argmax(1)
            top[i : i + 4096] = s.max(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(size < 1e-12)
        sums[empty] = x[np.argsort(top)[: len(empty)]]
        size[empty] = 1.0
        c = sums / size[:, None]
    return c


def matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their norms; scaled first, so that neither tiny nor huge components are lost."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(x: np.ndarray, c: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the numbers of its nearest centroids and its cosines with them, the nearest first."""
    s = x @ c.T
    near = np.argpartition(-s, probes - 1, axis=1)[:, :probes] if probes < len(c) else np.tile(np.arange(len(c)), (len(x), 1))
    at = np.take_along_axis(s, near, 1)
    order = np.argsort(-at, axis=1, kind="stable")
    return np.take_along_axis(near, order, 1), np.take_along_axis(at, order, 1)


def linked_groups(table: pa.Table, threshold: float) -> pa.Table:
    """Links of a block of home rows with a part of all rows of their cell: (rep, n, peer) with the copies linked to rep and the smallest row its forest joins it to."""
    rep, copies, home, block, part = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("rep", "copies", "home", "block", "part"))
    cell, i, j = (table.column(c)[0].as_py() for c in ("cell", "i", "j"))
    lists = table.column("probes").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rep), -1)
    x = unit(matrix(table.column("v")))
    at_home = home == cell
    a, b = np.flatnonzero(at_home & (block == i)), np.flatnonzero(part == j)
    close = x[a] @ x[b].T >= threshold
    # Two rows at home meet in the block of the smaller one.
    close &= ~at_home[b][None, :] | (rep[a][:, None] < rep[b][None, :])
    p, q = np.nonzero(close)
    p, q = a[p], b[q]
    # A visitor that is the smaller one counts at its own home, if the larger is seen there.
    away = ~at_home[q] & (rep[q] < rep[p])
    away[away] = (lists[p[away]] == home[q[away]][:, None]).any(1)
    p, q = p[~away], q[~away]
    n = np.bincount(p, copies[q], len(rep)) + np.bincount(q, copies[p], len(rep))
    # Spanning forest: the smallest linked row, spread until it settles.
    label = rep.copy()
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        if (new == label).all():
            break
        label = new
    on = n > 0
    return pa.table({"rep": rep[on], "n": n[on].astype(np.int64), "peer": label[on]})


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row per vector."""
    spark = vectors.sparkSession
    v = F.col(embedding).cast("array<double>")
    sound = F.col(embedding).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(sound, F.transform(v, lambda x: x + F.lit(0.0))).alias("v")).withColumn("rep", F.xxhash64("v"))
    # Real numbers of single precision move as such; products are of double precision.
    small = isinstance(vectors.schema[embedding].dataType, T.ArrayType) and isinstance(vectors.schema[embedding].dataType.elementType, T.FloatType)
    kept = F.first(F.col("v").cast("array<float>")) if small else F.first("v")
    reps = stored(rows.where("v IS NOT NULL").groupBy("rep").agg(kept.alias("v"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first")), "vectors")
    with scratch() as keep:
        own = reps.select("rep", "copies", "first")
        links = pair_links(reps, threshold)
        if links is not None:
            links = stored(links, "vector-links")
            counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
            label = components(links.select(F.col("rep").alias("a"), F.col("peer").alias("b"))).withColumnRenamed("node", "rep")
            own = own.join(counts, "rep", "left").join(label, "rep", "left")
        else:
            own = own.withColumn("n", F.lit(0).cast("long")).withColumn("component", F.lit(None).cast("long"))
        own = stored(own.select("rep", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("comp")), "classes")
        keep(own)
    forget(reps)
    lows = own.groupBy("comp").agg(F.min("first").alias("component_id"))
    final = own.join(lows, "comp").select("rep", "n_links", "component_id")
    out = rows.select("vec_id", F.when(F.col("v").isNotNull(), F.col("rep")).alias("rep")).join(final, "rep", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def second_level(placed: DataFrame, k: int, per_cell: int) -> DataFrame:
    """(rep, home, probes): cells of cells. placed is (rep, v, copies, home, probes) with NEAR cells of the first level."""
    sizes = placed.groupBy("home").agg(F.count(F.lit(1)).alias("m")).select(F.col("home").alias("cell"), "m")
    taken = placed.join(sizes.withColumnRenamed("cell", "home"), "home").where(F.pmod(F.xxhash64("rep", F.lit(2)), F.ceil(F.col("m") / SAMPLE)) == 0).select(F.col("home").alias("cell"), "m", "rep", "v")

    def fit(group: pa.Table) -> pa.Table:
        x = unit(matrix(group.sort_by("rep").column("v")))
        c = spherical_kmeans(x, min(len(x), max(1, round(group.column("m")[0].as_py() / CELL)), per_cell))
        return pa.table({"cell": pa.array([group.column("cell")[0].as_py()], pa.int64()), "centroids": pa.array([c.ravel().tolist()], pa.list_(pa.float64()))})

    centroids = stored(taken.groupBy("cell").applyInArrow(fit, "cell long, centroids array<double>"), "centroids")
    slices = F.ceil(F.col("m") * NEAR / SLICE).cast("int")
    there = centroids.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), "centroids")
    visits = placed.select("rep", "v", F.explode("probes").alias("cell")).join(sizes, "cell").select("cell", F.pmod(F.xxhash64("rep", F.lit(3)), slices).cast("int").alias("slice"), "rep", "v")

    def assign(rows: pa.Table, fitted: pa.Table) -> pa.Table:
        if not rows.num_rows or not fitted.num_rows:
            return pa.table({"rep": pa.array([], pa.int64()), "found": pa.array([], pa.list_(pa.struct([("cosine", pa.float64()), ("cell", pa.int64())])))})
        x = unit(matrix(rows.column("v")))
        c = fitted.column("centroids")[0].values.to_numpy().reshape(-1, x.shape[1])
        near, cosine = nearest(x, c, min(PROBES, len(c)))
        cell = rows.column("cell")[0].as_py() * per_cell
        found = [[{"cosine": s, "cell": cell + j} for s, j in zip(*pair, strict=True)] for pair in zip(cosine.tolist(), near.tolist(), strict=True)]
        return pa.table({"rep": rows.column("rep"), "found": pa.array(found, pa.list_(pa.struct([("cosine", pa.float64()), ("cell", pa.int64())])))})

    made = visits.groupBy("cell", "slice").cogroup(there.groupBy("cell", "slice")).applyInArrow(assign, "rep long, found array<struct<cosine:double,cell:long>>")
    best = made.groupBy("rep").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found")), False), 1, PROBES).alias("best"))
    cells = F.transform("best", lambda x: x["cell"])
    # All lists have one length: a short one ends in its first cell again.
    return best.select("rep", F.get(cells, F.lit(0)).alias("home"), F.slice(F.concat(cells, F.array_repeat(F.get(cells, F.lit(0)), PROBES)), 1, PROBES).alias("probes"))


def pair_links(reps: DataFrame, threshold: float) -> DataFrame | None:
    """(rep, n, peer) from every block; None without vectors."""
    spark = reps.sparkSession
    dims = [(r[0], r["n"]) for r in reps.groupBy(F.size("v")).agg(F.count(F.lit(1)).alias("n")).collect()]  # a row per length of vectors
    out = None
    for dim, total in dims:
        mine = reps.where(F.size("v") == dim)
        sample = unit(matrix(mine.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("v").toArrow().column("v")))
        k = min(MOST_CELLS, max(1, round(total / CELL)), len(sample))
        again = total > 2 * CELL * k
        sent = spark.sparkContext.broadcast(spherical_kmeans(sample, k))
        probes = min(NEAR if again else PROBES, k)

        def assign(batches, sent=sent, probes=probes):
            c = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                near, _ = nearest(unit(matrix(batch.column(1))), c, probes)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near[:, 0].astype(np.int64)), pa.array(near.astype(np.int64).tolist(), pa.list_(pa.int64()))], names=["rep", "v", "copies", "home", "probes"])

        kind = mine.schema["v"].dataType.simpleString()
        placed = stored(mine.select("rep", "v", "copies").mapInArrow(assign, f"rep long, v {kind}, copies long, home long, probes array<long>"), "placed")
        if again:
            finer = stored(second_level(placed, k, max(1, -(-SAMPLE // 8))), "cells")
            placed = stored(placed.select("rep", "v", "copies").join(finer, "rep"), "placed")
        rows = placed.select("rep", "v", "copies", "home", "probes", F.explode(F.array_distinct("probes")).alias("cell"))
        count = lambda on, size: F.greatest(F.lit(1), F.ceil(F.count_if(on) / size)).cast("int")
        sizes = rows.groupBy("cell").agg(count(F.col("home") == F.col("cell"), BLOCK).alias("blocks"), count(F.lit(True), VISITORS).alias("parts"))
        rows = rows.join(sizes, "cell").withColumns({"block": F.pmod(F.xxhash64("rep", "cell"), "blocks").cast("int"), "part": F.pmod(F.xxhash64("cell", "rep"), "parts").cast("int")})
        upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        as_any = F.transform(upto("blocks"), lambda i: F.struct(i.alias("i"), F.col("part").alias("j")))
        as_home = F.transform(upto("parts"), lambda j: F.struct(F.col("block").alias("i"), j.alias("j")))
        met = F.when(F.col("home") == F.col("cell"), F.array_union(as_any, as_home)).otherwise(as_any)
        made = rows.select("*", F.explode(met).alias("m")).select("rep", "v", "copies", "home", "probes", "cell", "block", "part", "m.i", "m.j")
        made = made.groupBy("cell", "i", "j").applyInArrow(lambda t: linked_groups(t, threshold), "rep long, n long, peer long")
        out = made if out is None else out.union(made)
    return out
