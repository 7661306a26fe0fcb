"""Embedding near-deduplication by an inverted multi-index.

Two codebooks, one for each half of the vectors, make a grid of cells.  A
vector is stored in its own cell and visits the nearest cells in the order of
the sum of both halves' distances (the order of the multi-sequence
algorithm); the number of visits is set on a sample so that the target recall
is reached.  What meets in a cell is verified by cosine.  ``recall`` measures
what was found against brute force.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read
from .components import components

COSINE = 0.9
#: The codebooks and the number of visits are fitted on at most so many vectors, those with the smallest hashes.
SAMPLE = 20_000
#: Part of a sample's true links that the visits must find; visits at least.
TARGET_RECALL, LEAST_VISITS = 0.99, 4
#: Vectors that a cell has on average while codebooks can grow with their number.
#: A code needs four sampled vectors, so codebooks end at SAMPLE / 4 codes and cells grow beyond 4e8 vectors.
CELL_ROWS = 16
#: Rows of one block; fuller cells are compared block against block.
BLOCK = 1024
#: Numbers that one step of a traversal holds at a time.
STEP = 4_000_000


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = distances(x, centres).argmin(1)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None, :]


class Grid:
    """The product grid of two codebooks."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second, self.half = first, second, first.shape[1]

    def visits(self, x: np.ndarray, n: int) -> np.ndarray:
        """The first ``n`` cells of each vector's multi-sequence traversal.

        The t-th cell visited has ranks i, j in the two halves with
        (i + 1)(j + 1) <= t, so only such pairs are looked at; vectors go in
        slices, so memory is bounded whatever their number.
        """
        n = min(n, len(self.first) * len(self.second))
        pairs = np.array([(i, j) for i in range(min(n, len(self.first))) for j in range(min(n // (i + 1), len(self.second)))])
        width = max(len(pairs), len(self.first), len(self.second))
        rows = max(1, STEP // width)
        return np.concatenate([self._visits(x[at : at + rows], n, pairs) for at in range(0, max(len(x), 1), rows)])

    def _visits(self, x: np.ndarray, n: int, pairs: np.ndarray) -> np.ndarray:
        one, two = distances(x[:, : self.half], self.first), distances(x[:, self.half :], self.second)
        a, b = np.argsort(one, 1, kind="stable")[:, :n], np.argsort(two, 1, kind="stable")[:, :n]
        i, j = a[:, pairs[:, 0]], b[:, pairs[:, 1]]
        total = np.take_along_axis(one, i, 1) + np.take_along_axis(two, j, 1)
        order = np.argsort(total, 1, kind="stable")[:, :n]
        return np.take_along_axis(i * len(self.second) + j, order, 1)


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length one; large and small numbers are scaled first, so no square overflows or vanishes."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(sample: np.ndarray, rows: int, cosine: float = COSINE, target: float = TARGET_RECALL) -> tuple[Grid, int]:
    """The grid for ``rows`` vectors, and the visits that find ``target`` of a sample's links.

    A sample with fewer than 50 links tells too little (of a large corpus it
    has few neighbours): then neighbours made at cosines from the threshold to
    1 stand in for them, and the target stays.
    """
    x = unit(sample)
    codes = min(2 ** math.ceil(math.log2(max(1.0, math.sqrt(rows / CELL_ROWS)))), SAMPLE // 4, len(x))
    half = x.shape[1] // 2
    grid = Grid(kmeans(x[:, :half], codes), kmeans(x[:, half:], codes))
    links = []
    for at in range(0, len(x), 1000):
        a, b = np.nonzero(x[at : at + 1000] @ x.T >= cosine)
        links.append(np.stack([a + at, b])[:, a + at < b])
    a, b = np.concatenate(links, axis=1)
    if len(a) < 50:
        rng = np.random.default_rng(7)
        p = x[:2000]
        r = rng.normal(size=p.shape)
        r = r - (r * p).sum(1, keepdims=True) * p
        size = np.linalg.norm(r, axis=1, keepdims=True)
        near = rng.uniform(cosine, 1.0, (len(p), 1))
        x = np.concatenate([p, near * p + np.sqrt(1 - near**2) * r / np.where(size > 0, size, 1.0)])
        a, b = np.arange(len(p)), np.arange(len(p)) + len(p)
    keep = np.random.default_rng(3).permutation(len(a))[:20_000]
    a, b = a[keep], b[keep]
    used, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = where[: len(a)], where[len(a) :]
    n = LEAST_VISITS
    while True:  # ends at the whole grid at the latest, where everything is found
        seen = grid.visits(x[used], n)
        found = _among(seen[:, 0], seen, a, b) | _among(seen[:, 0], seen, b, a)
        if found.mean() >= target or n >= codes**2:
            return grid, n
        n *= 2


def _among(own: np.ndarray, cells: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the own cell of each ``a`` is one that its ``b`` visits; in slices."""
    out = np.empty(len(a), bool)
    rows = max(1, STEP // cells.shape[1])
    for at in range(0, len(a), rows):
        here = slice(at, at + rows)
        out[here] = (cells[b[here]] == own[a[here]][:, None]).any(1)
    return out


def _filed(grid: Grid, visits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = np.stack(part.column(2).to_numpy(zero_copy_only=False))
                seen = grid.visits(unit(x), visits)
                cells = pa.array(list(seen.astype(np.int32)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, cells], ["id", "copies", "v", "cells"])

    return run


def _verified(cosine: float):
    def block(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        stored = rows["query"] == 0
        m, q = np.flatnonzero(stored), np.flatnonzero(~stored)
        if not len(m) or not len(q):
            return (np.empty(0, np.int64),) * 4
        x = unit(np.stack(rows["v"]))
        cells = np.stack(rows["cells"])
        own = cells[:, 0]
        i, j = np.nonzero(x[q] @ x[m].T >= cosine)
        a, b = q[i], m[j]
        # a pair met in both vectors' cells counts in one of them alone
        here = own[m[0]]
        mutual = _among(own, cells, a, b)
        once = np.where(own[a] == here, rows["id"][a] < rows["id"][b], ~mutual | (here < own[a]))
        a, b = a[once], b[once]
        ids, copies = rows["id"], rows["copies"]
        who = np.concatenate([ids[a], ids[b]])
        vertex, at = np.unique(who, return_inverse=True)
        degree = np.bincount(at, np.concatenate([copies[b], copies[a]]), len(vertex)).astype(np.int64) if len(who) else np.empty(0, np.int64)
        return ids[a], ids[b], vertex, degree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .simhash import _forest

        held: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = {n: table.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in table.column_names}
            change = np.flatnonzero((np.diff(rows["cell"]) != 0) | (np.diff(rows["i"]) != 0) | (np.diff(rows["j"]) != 0)) + 1
            for s, e in zip(np.r_[0, change], np.r_[change, table.num_rows], strict=True):
                a, b, vertex, degree = block({n: c[s:e] for n, c in rows.items()})
                if len(a):
                    kept = _forest(a, b)
                    n = max(len(kept), len(vertex))
                    pad = lambda c: pa.array([*c.tolist(), *[None] * (n - len(c))], pa.int64())
                    yield pa.RecordBatch.from_arrays([pad(a[kept]), pad(b[kept]), pad(vertex), pad(degree)], ["a", "b", "vertex", "degree"])

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            keys = [table.column(c).combine_chunks().to_numpy() for c in ("cell", "i", "j")]
            change = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0))
            if len(change):
                end = int(change[-1]) + 1
                yield from out(table.slice(0, end))
                held = table.slice(end).combine_chunks().to_batches()
        if held:
            yield from out(pa.Table.from_batches(held))

    return run


def _finite(v: str) -> Column:
    return F.coalesce(
        F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists(v, lambda e: e != 0), F.lit(False)
    )


def _vectors(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """(id, v) of every row, and the type of v: floats stay floats, other numbers become doubles."""
    kind = vectors.select(vector_col).schema[0].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")), kind


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``.

    Links are pairs with a cosine of ``cosine`` or more, in double precision;
    all reported ones are verified, and the index finds at least the target
    recall of them.  Equal vectors are one class and link with each other; a
    class is indexed once.  Null, zero and non-finite vectors link with
    nothing; vectors link with those of their own length only, and each length
    has an index of its own.  Rows that repeat an id count as further vectors;
    a null id links with nothing.  No rows give no rows.
    """
    rows, kind = _vectors(vectors, id_col, vector_col)
    fine = _finite("v") & F.col("id").isNotNull()
    out = rows.filter(~fine).select(
        F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")
    )
    # one number for each length that occurs
    for (length,) in rows.filter(fine).groupBy(F.size("v").alias("n")).count().orderBy("n").select("n").collect():
        out = out.unionByName(_near_alike(rows.filter(fine & (F.size("v") == length)), kind, cosine))
    return out


def _near_alike(rows: DataFrame, kind: str, cosine: float) -> DataFrame:
    """The same of rows (id, v) of one length, all of them finite."""
    classes = cut(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "vector-classes")
    count = classes.count()
    sample = np.array([r[0] for r in classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()])
    grid, visits = fit(sample, count, cosine)
    filed = classes.select("id", "copies", "v").mapInArrow(_filed(grid, visits), f"id long, copies long, v {kind}, cells array<int>")
    filed = cut(filed, "vector-cells")
    stored = filed.withColumn("cell", F.element_at("cells", 1))
    full = stored.groupBy("cell").agg(F.count("*").alias("members"))
    asked = filed.withColumn("cell", F.explode("cells"))
    askers = asked.groupBy("cell").agg(F.count("*").alias("askers"))
    blocks = full.join(askers, "cell").select(
        "cell", F.ceil(F.col("members") / BLOCK).cast("int").alias("mi"), F.ceil(F.col("askers") / BLOCK).cast("int").alias("qj")
    )
    blocks = cut(blocks, "vector-blocks")  # a table, so that a full cell's rows can be split in the joins
    own = F.xxhash64("id")
    left = stored.join(blocks, "cell").select(
        "cell", F.pmod(own, "mi").cast("int").alias("i"), F.explode(F.expr("sequence(0, qj - 1)")).alias("j"), F.lit(0).alias("query"), "id", "copies", "v", "cells"
    )
    right = asked.join(blocks, "cell").select(
        "cell", F.explode(F.expr("sequence(0, mi - 1)")).alias("i"), F.pmod(own, "qj").cast("int").alias("j"), F.lit(1).alias("query"), "id", "copies", "v", "cells"
    )
    dealt = left.unionByName(right).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    found = cut(dealt.mapInArrow(_verified(cosine), "a long, b long, vertex long, degree long"), "vector-links")
    groups = components(found.select("a", "b")).withColumnRenamed("vertex", "id")
    degrees = found.filter("vertex is not null").groupBy(F.col("vertex").alias("id")).agg(F.sum("degree").alias("degree"))
    named = classes.join(groups, "id", "left").join(degrees, "id", "left").select(
        "v",
        (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    whole = rows.join(named, "v")
    return whole.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


#: Query vectors that one pass of ``recall`` compares with all rows.
QUERIES = 4096


def recall(vectors: DataFrame, found: DataFrame, every: int = 20, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(queries, links, found, recall): of the vectors whose id is divisible by ``every``, their true links and those in ``found``.

    Brute force in blocks: each pass sends QUERIES query vectors to the tasks,
    which hold them against all rows.  An evaluation, not a part of the index.
    """
    rows, _ = _vectors(vectors, id_col, vector_col)
    rows = rows.filter(_finite("v") & F.col("id").isNotNull())
    queries = cut(rows.filter(F.col("id") % every == 0).withColumn("n", F.monotonically_increasing_id()).orderBy("n"), "recall-queries")

    def against(block: np.ndarray):
        wide = unit(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vs = batch.column(1)
                alike = np.array([len(v) == block.shape[1] for v in vs], bool)
                hits = 0
                if alike.any():
                    x = unit(np.stack(vs.filter(pa.array(alike)).to_numpy(zero_copy_only=False)))
                    hits = int((x @ wide.T >= cosine).sum())
                yield pa.RecordBatch.from_arrays([pa.array([hits], pa.int64())], ["hits"])

        return run

    links, count, held = 0, 0, {}

    def flush(block: list) -> int:
        return rows.mapInArrow(against(np.array(block)), "hits long").agg(F.sum("hits")).first()[0] - len(block)

    for r in queries.select("v").toLocalIterator():
        block = held.setdefault(len(r.v), [])
        block.append(r.v)
        count += 1
        if len(block) == QUERIES:
            links += flush(held.pop(len(r.v)))
    links += sum(flush(block) for block in held.values())
    got = found.filter(F.col("vec_id") % every == 0)
    told = got.agg(F.lit(count).cast("long").alias("queries"), F.lit(links).cast("long").alias("links"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("found"))
    return told.withColumn("recall", F.when(F.col("links") > 0, F.col("found") / F.col("links")).otherwise(1.0))


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
