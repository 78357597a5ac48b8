"""Operator 7, exact top-k search by a Voronoi kNN join.

Pivots part the space; every vector goes to the cell of its nearest pivot, and each cell's summary says how far its
vectors reach from the pivot, along its direction and across. For every query the summaries, and the query's scores with
a sample of the rows, give a score that its k-th best surely reaches; only cells whose summary allows as much are
needed. Queries are copied to the needed cells, data moves once, and each part of a cell is solved locally as blocked
matrix products. The best k of each part are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Factor of the quantisation, share of ids that are queries, results of a query (fixed values of the contract).
SCALE, EVERY, K = 256, 50, 5
#: Pivots at most, rows for each pivot, rows of the sample that they are fitted on for each pivot, rows of the sample that
#: queries are scored with first, rows of a cell's part, queries that are solved at once, copies of queries in a batch.
PIVOTS, ROWS, SAMPLE, SCORED, PART, QUERIES, COPIES = 1024, 512, 32, 4096, 16_384, 256, 1 << 16


def usable(name: str = "embedding") -> Column:
    """True unless the vector is null or holds a component that is null or not finite after scaling."""
    fine = F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float("inf")))
    return F.col(name).isNotNull() & F.coalesce(fine, F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Quantised vectors as rows; shorter ones end in zeros."""
    offsets = np.asarray(column.offsets, np.int64)
    values = np.floor(SCALE * np.asarray(column.values.slice(offsets[0], offsets[-1] - offsets[0]), np.float64))
    sizes = np.diff(offsets)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values
    return out


def choose_pivots(vectors: np.ndarray, count: int, seed: int = 42) -> np.ndarray:
    """Centres of a few Lloyd iterations over a bounded sample; they decide speed only, never results."""
    rng = np.random.default_rng(seed)
    different = np.unique(vectors, axis=0)
    pivots = different[rng.choice(len(different), min(count, len(different)), replace=False)]
    for _ in range(5):
        nearest = _nearest(vectors, pivots)[0]
        for i in np.unique(nearest):
            pivots[i] = vectors[nearest == i].mean(axis=0)
    return pivots


def _nearest(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = (pivots**2).sum(axis=1)[None, :] - 2 * vectors @ pivots.T
    cell = square.argmin(axis=1)
    return cell, np.sqrt(((vectors - pivots[cell]) ** 2).sum(axis=1))


@dataclass
class Cells:
    """Pivots and, for each, how many vectors its cell has, their largest distance from the pivot, the range of their
    components along the pivot and the largest of what lies across."""

    pivots: np.ndarray
    count: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray
    across: np.ndarray

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score (queries x cells) that a vector of the cell can have."""
        middle, norm = queries @ self.pivots.T, np.linalg.norm(queries, axis=1)[:, None]
        along = middle / _lengths(self.pivots)
        rest = np.sqrt(np.maximum(norm**2 - along**2, 0)) * self.across
        slack = 1e-9 * (np.abs(middle) + norm * (self.radius + self.across + np.abs(self.low) + np.abs(self.high))) + 1e-6
        ends = along * self.low, along * self.high
        least = np.maximum(middle - norm * self.radius, np.minimum(*ends) - rest) - slack
        return least, np.minimum(middle + norm * self.radius, np.maximum(*ends) + rest) + slack

    def needed(self, queries: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
        """Which cells (queries x cells) can hold one of a query's k best. The k+1 best cells by least score, and the
        k+1 best rows of the sample (k and the query itself), give a score that the k-th best reaches."""
        least, most = self.bounds(queries)
        order = np.argsort(-least, axis=1, kind="stable")
        upto = np.cumsum(self.count[order], axis=1)
        enough = np.minimum((upto <= k).sum(axis=1), len(self.count) - 1)
        reached = np.take_along_axis(least, np.take_along_axis(order, enough[:, None], 1), 1)[:, 0]
        reached = np.where(upto[:, -1] > k, reached, -np.inf)
        if len(sample) > k:
            scores = queries @ sample.T
            reached = np.maximum(reached, np.partition(scores, len(sample) - k - 1, axis=1)[:, len(sample) - k - 1] * (1 - 1e-9) - 1e-6 - 2e-9 * np.abs(scores).max(axis=1))
        return (most >= reached[:, None]) & (self.count > 0)


def _lengths(pivots: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(pivots, axis=1)
    return np.where(lengths > 0, lengths, 1.0)


def _assign(pivots: np.ndarray):
    """Cell of each vector, what its summary needs, and the quantised vector in 4 bytes a component where these are exact."""
    names = ["row", "vec_id", "cell", "radius", "along", "across", "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(pivots)
        for batch in batches:
            vectors = _matrix(batch.column("embedding"), pivots.shape[1])
            cell, radius = _nearest(vectors, pivots)
            along = np.einsum("ij,ij->i", vectors, pivots[cell]) / lengths[cell]
            across = np.sqrt(np.maximum(np.einsum("ij,ij->i", vectors, vectors) - along**2, 0))
            kind = "<f4" if np.abs(vectors).max(initial=0) < 1 << 24 else "<f8"
            raw, size = vectors.astype(kind).tobytes(), np.dtype(kind).itemsize * pivots.shape[1]
            rows = [raw[i * size : (i + 1) * size] for i in range(len(cell))]
            numbers = [pa.array(x) for x in (cell.astype(np.int32), radius, along, across)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), *numbers, pa.array(rows, pa.binary())], names)

    return run


DEALT = pa.schema([("target", pa.int32()), ("kind", pa.int32()), *((n, pa.binary()) for n in ("rows", "ids", "vectors"))])


def _deal(cells: Cells, first: np.ndarray, parts: np.ndarray, sample: np.ndarray, every: int, k: int):
    """Blocks of data (kind 0) for their part of a cell and of queries (kind 1) for every part of the cells they need."""
    width = cells.pivots.shape[1]

    def blocks(kind: int, target: np.ndarray, index: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: list[bytes]) -> pa.RecordBatch:
        order = np.argsort(target, kind="stable")
        target, index = target[order], index[order]
        names, begin = np.unique(target, return_index=True)
        cuts = list(zip(begin.tolist(), [*begin[1:].tolist(), len(target)], strict=True))
        out = [pa.array(names, pa.int32()), pa.array([kind] * len(names), pa.int32())]
        out += [pa.array([array[index[a:b]].tobytes() for a, b in cuts], pa.binary()) for array in (rows, ids)]
        wide = np.frombuffer(b"".join(vectors), f"V{len(vectors[0])}")  # one element a vector: vectors of a batch share a width
        out.append(pa.array([wide[index[a:b]].tobytes() for a, b in cuts], pa.binary()))
        return pa.RecordBatch.from_arrays(out, schema=DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.binary_length(whole.column("vector")).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                batch = whole.filter(pa.array(sizes == size))
                rows, ids, cell = (batch.column(n).to_numpy() for n in ("row", "vec_id", "cell"))
                vectors = batch.column("vector").to_pylist()
                part = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                yield blocks(0, first[cell] + (part % parts[cell].astype(np.uint64)).astype(np.int64), np.arange(len(rows)), rows, ids, vectors)
                asks = np.flatnonzero(ids % every == 0)
                for low in range(0, len(asks), QUERIES):
                    own = asks[low : low + QUERIES]
                    q = _vectors([vectors[i] for i in own], width)
                    which, needs = np.nonzero(cells.needed(q, sample, k))
                    times = parts[needs]
                    target = np.repeat(first[needs] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                    index, order = np.repeat(own[which], times), np.argsort(target, kind="stable")
                    for at in np.split(order, np.arange(COPIES, len(order), COPIES)):
                        yield blocks(1, target[at], index[at], rows, ids, vectors)

    return run


def _vectors(raw: list[bytes], width: int) -> np.ndarray:
    kinds = [np.frombuffer(r, "<f4" if len(r) == 4 * width else "<f8").astype(float) for r in raw]
    return np.stack(kinds) if kinds else np.empty((0, width))


def _block(raw: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<f4" if len(raw) == 4 * rows * width else "<f8").reshape(rows, width)


def _scores(queries: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, bool]:
    """Inner products and whether they are Python's integers, as they may be larger than a long."""
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * queries.shape[1]
    if largest < 1 << 24:  # every sum is an integer that four bytes hold exactly
        return (queries.astype(np.float32) @ data.astype(np.float32).T).astype(np.int64), False
    if largest < 1 << 53:
        return (queries.astype(float) @ data.astype(float).T).astype(np.int64), False
    exact = np.vectorize(int, otypes=[object])
    return exact(queries).dot(exact(data).T), True


def _sortable(score: int) -> bytes | None:
    """Bytes in the order of scores beyond a long; None within."""
    if -(1 << 63) <= score < 1 << 63:
        return None
    raw = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    raw = len(raw).to_bytes(4, "big") + raw
    return raw if score > 0 else bytes(255 - b for b in raw)


FOUND = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.int32()), ("big", pa.binary())])


def _solve(width: int, k: int):
    """The k best of each part for each of its queries, from rows in order of target and kind."""

    def best(queries, q_rows, q_ids, data, d_rows, d_ids) -> pa.RecordBatch:
        scores, large = _scores(queries, data)
        out: list[list] = [[], [], [], []]
        for i, row in enumerate(scores):
            most = min(len(row), k + 1)
            bar = np.sort(row)[len(row) - most] if large else np.partition(row, len(row) - most)[len(row) - most]
            at = np.flatnonzero(row >= bar)  # in order of id, so a stable sort keeps the smaller ids of ties
            at = at[d_rows[at] != q_rows[i]]
            at = at[np.argsort(-row[at], kind="stable")][:k]
            for column, values in zip(out, (np.full(len(at), q_rows[i]), np.full(len(at), q_ids[i]), d_ids[at], row[at]), strict=True):
                column.append(values)
        columns = [np.concatenate(c) for c in out]
        score = columns[3].tolist()
        big = [_sortable(x) for x in score] if large else [None] * len(score)
        beyond = [0 if b is None else (1 if x > 0 else -1) for b, x in zip(big, score, strict=True)]
        score = [min(max(x, -(1 << 63)), (1 << 63) - 1) for x in score] if large else score
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(score, pa.int64()), pa.array(beyond, pa.int32()), pa.array(big, pa.binary())], schema=FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, have, solved = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                rows, ids = np.frombuffer(row["rows"], np.int64), np.frombuffer(row["ids"], np.int64)
                vectors = _block(row["vectors"], len(rows), width)
                if row["target"] != target:
                    target, have, solved = row["target"], [], None
                if row["kind"] == 0:
                    have.append((vectors, rows, ids))
                    continue
                if not have:
                    continue
                if solved is None:
                    data, d_rows, d_ids = (np.concatenate(x) for x in zip(*have, strict=True))
                    order = np.argsort(d_ids, kind="stable")
                    solved, have = (data[order], d_rows[order], d_ids[order]), [True]
                yield best(vectors, rows, ids, *solved)

    return run


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose id ``every`` divides.

    Null vectors and those with null or non-finite components take no part, nor do rows with a null id. Vectors of
    different lengths count as if the shorter ended in zeros. Ties go to the smaller id; rows that repeat an id are
    candidates and queries of their own, and each query row has its own ranks. Scores of any size are ranked exactly;
    one beyond a long is given as the nearest long. Fewer candidates than k give fewer rows, an empty table none.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(usable()).filter("vec_id is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    total, width = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, 1)
    count = int(min(PIVOTS, max(1, total // ROWS)))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE * count).toArrow()["embedding"].combine_chunks()
    sample = _matrix(sample, width)
    pivots = choose_pivots(sample, count)
    count = len(pivots)
    columns = "row long, vec_id long, cell int, radius double, along double, across double, vector binary"
    placed = materialize(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_assign(pivots), columns))
    summary = placed.groupBy("cell").agg(F.count("*"), F.max("radius"), F.min("along"), F.max("along"), F.max("across"))
    table = np.zeros((5, count))
    for r in summary.collect():  # one row for each pivot
        table[:, r[0]] = r[1:]
    cells = Cells(pivots, table[0].astype(np.int64), *table[1:])
    parts = -(-cells.count // PART)
    first = np.cumsum(parts) - parts
    dealt = placed.mapInArrow(_deal(cells, first, parts, sample[:SCORED], every, k), "target int, kind int, rows binary, ids binary, vectors binary")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART)
    dealt = dealt.repartition(tasks, "target").sortWithinPartitions("target", "kind")
    best = dealt.mapInArrow(_solve(width, k), "row long, query_id long, vec_id long, score long, beyond int, big binary")
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.desc("beyond"), F.desc("score"), F.desc("big"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
      FROM v q JOIN v d ON q.n <> d.n WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
