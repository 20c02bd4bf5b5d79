"""Approximate nearest neighbours by cross-polytope hashing.

1. Three rounds of random signs and a fast Hadamard transform turn a vector about like a random rotation does; the signed axis
   nearest to the turned vector is its hash. A cell of a table is PARTS such hashes, PARTS growing with the rows so that a cell has about CELL_ROWS;
   every row is in one cell of each of TABLES tables.
2. A query probes the cells nearest to it in all tables together, by the sum of its coordinates on their axes. How many, is measured: the exact
   neighbours of up to SAMPLE queries (by hash of their id) are found by one pass over all rows, and the probes that reach RECALL of them are taken for every query.
3. Rows and probes meet by cell; each cell gives a query its TOP best by exact cosine, and the best of all its cells are its result.

A cell of more than SLICE rows is dealt out in slices that each get its probes, and probes of more than BLOCK queries in blocks that each get
its rows, so a group in a task has a bound, even if a third of all rows are in one cell. Of equal vectors in a slice only the TOP + 1 smallest ids go on, as
no more can be among a query's best.

Scores are exact cosines in double precision of the original vectors (scaled by powers of two, which changes nothing); ties go to the smaller id. Rows with a null id, or with a vector that is null, zero
or has a null or non-finite component, take no part. Shorter vectors count as padded with zeros. Rows that repeat an id are one item with
several vectors, whose score is its best; a query never finds its own id. Other columns stay behind, whatever their names. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches

TOP = 5
TABLES, RECALL, SAMPLE = 6, 0.97, 200
CELL_ROWS, SLICE, BLOCK = 8192, 1024, 1024
#: Probes that are put in order for one query and table, where a cell has several parts.
MOST_ORDERED = 1 << 15
ROUNDS = 3
#: Matrix products differ from exact cosines by less; what is this near to a query's limit is worked out exactly.
SLACK = 1e-9


def hadamard(x: np.ndarray) -> np.ndarray:
    """The rows of x (as many columns as a power of two) times the orthonormal Hadamard matrix."""
    n, width, h = *x.shape, 1
    while h < width:
        pairs = x.reshape(n, -1, 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


@dataclass(frozen=True)
class Hashing:
    """The family of hashes for vectors of `width` components (a power of two)."""

    width: int
    parts: int
    tables: int = TABLES
    seed: int = 31

    def turned(self, x: np.ndarray) -> np.ndarray:
        """rows x tables x parts x width: the vectors after each pseudo-rotation."""
        signs = np.random.default_rng(self.seed).choice([-1.0, 1.0], (self.tables, self.parts, ROUNDS, self.width))
        out = np.empty((len(x), self.tables, self.parts, self.width))
        for t in range(self.tables):
            for p in range(self.parts):
                y = x
                for s in signs[t, p]:
                    y = hadamard(y * s)
                out[:, t, p] = y
        return out

    def cells(self, x: np.ndarray) -> np.ndarray:
        """rows x tables: the cell of each vector."""
        y = self.turned(x)
        axis = np.abs(y).argmax(axis=-1)
        signed = np.where(np.take_along_axis(y, axis[..., None], -1)[..., 0] > 0, axis, axis + self.width)
        return signed @ (2 * self.width) ** np.arange(self.parts)

    def probes(self, x: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(tables, cells), rows x probes: the cells of all tables from the nearest on, `most` of them or all that are put in order."""
        y = self.turned(x)
        both = np.concatenate([y, -y], axis=-1)  # the coordinate on each signed axis
        axes = max(2, min(2 * self.width, int(MOST_ORDERED ** (1 / self.parts) + 1e-9)))
        score, cell = np.zeros((*both.shape[:2], 1)), np.zeros((*both.shape[:2], 1), np.int64)
        for p in range(self.parts):
            near = np.argsort(-both[:, :, p], axis=-1, kind="stable")[..., :axes]
            there = np.take_along_axis(both[:, :, p], near, -1)
            score = (score[..., :, None] + there[..., None, :]).reshape(*both.shape[:2], -1)
            cell = (cell[..., :, None] + (near * (2 * self.width) ** p)[..., None, :]).reshape(*both.shape[:2], -1)
        per_table = score.shape[-1]
        score, cell = score.reshape(len(x), -1), cell.reshape(len(x), -1)
        most = min(most or score.shape[1], score.shape[1])
        if most < score.shape[1]:
            near = np.sort(np.argpartition(-score, most - 1, axis=1)[:, :most], axis=1)
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(score, near, 1), axis=1, kind="stable"), 1)
        else:
            near = np.argsort(-score, axis=1, kind="stable")
        return near // per_table, np.take_along_axis(cell, near, 1)


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of `width` doubles, padded with zeros and scaled by a power of two to at most 1."""
    sizes = vectors.value_lengths().to_numpy()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.zeros((len(sizes), width))
    x[np.arange(width) < sizes[:, None]] = flat
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) if len(x) else x


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def nearest_rows(query_id: np.ndarray, q: np.ndarray, vec_id: np.ndarray, x: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score): of each query the `top` nearest of other ids, in order; an id counts once."""
    rows = np.ascontiguousarray(x)
    _, same = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)
    by = np.lexsort((vec_id, same))
    vector = np.diff(same[by], prepend=-1) != 0
    new = vector | np.concatenate([[True], np.diff(vec_id[by]) != 0])[: len(by)]
    place = np.cumsum(new)
    keep = by[new & (place - np.maximum.accumulate(np.where(vector, place, 0)) <= top)]
    ids, vectors = vec_id[keep], x[keep]
    times = int(np.unique(ids, return_counts=True)[1].max()) if len(ids) else 1
    product = unit(q) @ unit(vectors).T
    product[query_id[:, None] == ids[None, :]] = -np.inf
    k = min(len(ids), top * times)
    limit = np.partition(product, len(ids) - k, axis=1)[:, len(ids) - k] - SLACK
    qi, di = np.nonzero((product >= limit[:, None]) & np.isfinite(product))
    score = np.concatenate([cosines(q[qi[a : a + 65536]], vectors[di[a : a + 65536]]) for a in range(0, len(qi), 65536)] or [np.zeros(0)])
    by = np.lexsort((ids[di], -score, qi))
    if times > 1:  # an id's best vector stands for it
        key = np.stack([qi[by], ids[di[by]]])
        by = by[np.sort(np.unique(key, axis=1, return_index=True)[1])]
    nth = np.arange(len(by)) - np.searchsorted(qi[by], qi[by])
    by = by[nth < top]
    return qi[by], keep[di[by]], score[by]


def _usable(points: DataFrame) -> DataFrame:
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))  # NaN is above every number
    return points.select(F.col("vec_id").cast("long").alias("vec_id"), v).where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def exact_nearest(points: DataFrame, query_id: np.ndarray, q: np.ndarray, top: int = TOP) -> DataFrame:
    """query (its number), vec_id, score and embedding of the `top` nearest rows of a bounded set of queries: all rows are compared, task by task."""
    shared = points.sparkSession.sparkContext.broadcast((query_id, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_id, q = shared.value
        best: pa.Table | None = None
        for b in batches:
            x = matrix(b.column(1), q.shape[1])
            if not len(x):
                continue
            qi, row, score = nearest_rows(query_id, q, b.column(0).to_numpy(), x, top)
            new = pa.table({"query": qi, "vec_id": b.column(0).take(pa.array(row)), "score": score, "embedding": b.column(1).take(pa.array(row))})
            t = pa.concat_tables([best, new]) if best is not None else new
            qi, ids, score = (t.column(c).to_numpy() for c in ("query", "vec_id", "score"))
            by = np.lexsort((ids, -score, qi))
            _, once = np.unique(np.stack([qi[by], ids[by]]), axis=1, return_index=True)
            by = by[np.sort(once)]
            best = t.take(pa.array(by[np.arange(len(by)) - np.searchsorted(qi[by], qi[by]) < top]))
        if best is not None:
            yield from best.cast(pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("embedding", b.column(1).type)])).combine_chunks().to_batches()

    kind = points.schema["embedding"].dataType.simpleString()
    found = points.mapInArrow(run, f"query long, vec_id long, score double, embedding {kind}")
    found = found.groupBy("query", "vec_id").agg(F.max_by(F.struct("score", "embedding"), "score").alias("best")).select("query", "vec_id", "best.*")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


def measured_probes(points: DataFrame, queries: DataFrame, hashing: Hashing, top: int) -> int:
    """The probes a query needs, to reach RECALL of the exact neighbours of a sample of queries."""
    sample = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    if not len(sample):
        return 1
    q = matrix(sample.column("embedding").combine_chunks(), hashing.width)
    found = exact_nearest(points, sample.column("vec_id").to_numpy(), q, top).select("query", "embedding").toArrow()  # at most SAMPLE x top rows
    if not len(found):
        return 1
    own = hashing.cells(matrix(found.column("embedding").combine_chunks(), hashing.width))
    query = found.column("query").to_numpy()
    needed = np.empty(len(query))
    for k in np.unique(query):
        table, cell = (a[0] for a in hashing.probes(q[k : k + 1]))
        for r in np.flatnonzero(query == k):
            hit = np.flatnonzero(own[r][table] == cell)
            needed[r] = hit[0] + 1 if len(hit) else len(cell)
    return int(np.sort(needed)[int(np.ceil(RECALL * len(needed))) - 1])


def _in_cells(points: DataFrame, hashing: Hashing, probes: int | None, vectors: bool) -> DataFrame:
    """place (table), cell and vec_id of each row's own cells, or with probes of those it probes; with vectors also the embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                x = matrix(b.column(1), hashing.width)
                if probes is None:
                    cell = hashing.cells(x)
                    table = np.broadcast_to(np.arange(hashing.tables), cell.shape)
                else:
                    table, cell = hashing.probes(x, probes)
                row = pa.array(np.repeat(np.arange(len(x)), cell.shape[1]))
                columns = [pa.array(table.ravel().astype(np.int32)), pa.array(cell.ravel()), b.column(0).take(row), *([b.column(1).take(row)] if vectors else [])]
                yield pa.RecordBatch.from_arrays(columns, names=["place", "cell", "vec_id", *(["embedding"] if vectors else [])])

    kind = points.schema["embedding"].dataType.simpleString()
    return points.mapInArrow(run, "place int, cell long, vec_id long" + f", embedding {kind}" * vectors)


def _crowded(points: DataFrame, hashing: Hashing, probes: int | None, most: int, name: str) -> DataFrame:
    """place, cell and in how many shares to deal out what is in it, of cells that hold more than `most`."""
    n = _in_cells(points, hashing, probes, False).groupBy("place", "cell").agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") > most).select("place", "cell", F.ceil(F.col("n") / most).cast("int").alias(name))


def _dealt(name: str, shares: str) -> Column:
    return F.pmod(F.xxhash64("vec_id", "embedding"), F.coalesce(F.col(shares), F.lit(1))).cast("int").alias(name)


def _each(name: str, shares: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(shares), F.lit(1)) - 1)).alias(name)


def nearest_neighbours(points: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id and score of the `top` nearest points found for each query, both tables with vec_id and embedding."""
    bounded_batches(points.sparkSession)
    points, queries = _usable(points), _usable(queries)
    empty = "query_id long, rank int, vec_id long, score double"
    n, longest = points.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    most = queries.agg(F.max(F.size("embedding"))).first()[0]
    if not n or not most:
        return points.sparkSession.createDataFrame([], empty)
    width = 1 << max(0, int(np.ceil(np.log2(max(longest, most)))))
    parts = 1
    while n > CELL_ROWS * (2 * width) ** parts and (2 * width) ** (parts + 1) < 1 << 62:
        parts += 1
    hashing = Hashing(width, parts)
    probes = measured_probes(points, queries, hashing, top)
    slices, blocks = _crowded(points, hashing, None, SLICE, "slices"), _crowded(queries, hashing, probes, BLOCK, "blocks")
    shares = slices.join(blocks, ["place", "cell"], "full")
    at, key = ["place", "cell"], ["place", "cell", "slice", "block"]
    once = ["vec_id", "embedding"]  # rows that are repeated whole could not be dealt out
    rows = _in_cells(points.dropDuplicates(once), hashing, None, True).join(shares, at, "left").select(*at, "vec_id", "embedding", _dealt("slice", "slices"), "blocks").select(*at, "vec_id", "embedding", "slice", _each("block", "blocks"))
    asked = _in_cells(queries.dropDuplicates(once), hashing, probes, True).join(shares, at, "left").select(*at, "vec_id", "embedding", _dealt("block", "blocks"), "slices").select(*at, "vec_id", "embedding", "block", _each("slice", "slices"))

    def meet(one: pa.Table, other: pa.Table) -> pa.Table:
        out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not len(one) or not len(other):
            return out.empty_table()
        q, x = (matrix(t.column("embedding").combine_chunks(), hashing.width) for t in (one, other))
        query_id, vec_id = one.column("vec_id").to_numpy(), other.column("vec_id").to_numpy()
        qi, row, score = nearest_rows(query_id, q, vec_id, x, top)
        return pa.table([query_id[qi], vec_id[row], score], schema=out)

    found = asked.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, score double")
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_neighbours(d, d.where("vec_id % 50 = 0"))
