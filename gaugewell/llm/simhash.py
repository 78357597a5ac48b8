"""Operator 10, SimHash near-dedup by tiled exact comparison.

Every pair of different fingerprints within the radius is found by exclusive-or and bit counts over tiles in numpy.
A tile holds fingerprints with equal population counts in four 16-bit segments; as each differing bit changes one
segment's count by one, tile pairs whose counts differ by more than the radius in sum can hold no link and are skipped.
Copies share a fingerprint, so a group of any size is one entry; a tile pair reports a spanning forest of its links,
never all pairs. Components are then found by alternating star contractions on tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, materialize, row_keyed, slices, trimmed

#: Bits that may differ, words of a shingle, seed of XXH64 (fixed values of the contract); fingerprints of a tile, about.
RADIUS, SHINGLE, SEED, TILE = 3, 3, 42, 2048
#: Elements of one block of the comparison, so about 20 MB of a worker's memory; shingles whose bits are counted at once.
BLOCK, COUNTED = 1 << 20, 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprints_of(column: pa.Array) -> np.ndarray:
    """The 64-bit SimHash of each text: bit b is 1 if it is set in over half of the hashes of the text's shingles."""
    words = Words(column)
    text, begin, end = words.joined(_LOWER)
    counts, first = words.counts, words.first[:-1]
    each = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    last = np.cumsum(each)
    begins = np.arange(last[-1] if len(last) else 0) + np.repeat(first - (last - each), each)  # word where each shingle begins
    ends = begins + np.repeat(np.minimum(counts, SHINGLE), each) - 1
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(each)
    ones, owner = np.zeros((len(some), 64), np.int64), np.repeat(np.arange(len(some)), each[some])
    for low in range(0, len(begins), COUNTED):  # a document of any length is counted part by part
        part = slice(low, low + COUNTED)
        spans = zip(begin[begins[part]].tolist(), end[ends[part]].tolist(), strict=True)
        hashes = np.fromiter((digest(text[a:b], SEED) for a, b in spans), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own, at = np.unique(owner[part], return_index=True)
        ones[own] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    if len(some):
        out[some] = np.packbits(2 * ones > each[some, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            marks = fingerprints_of(part.column("text")).view(np.int64)
            rest = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in rest), pa.array(marks)], [*rest, "mark"])


def fingerprints(keyed: DataFrame) -> DataFrame:
    """file, index and doc_id of each row, as ``row_keyed`` gives it, and the fingerprint as a signed long."""
    rows = keyed.select("file", "index", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(_fingerprint_batches), "file long, index long, doc_id long, mark long")


def _segment(i: int):
    return F.bit_count(F.shiftrightunsigned("mark", 16 * i).bitwiseAND(F.lit(0xFFFF)))


def _offsets() -> list[tuple[int, ...]]:
    """Differences of segment counts within the radius, one of each pair of opposite ones."""
    zero = (0, 0, 0, 0)
    return [d for d in product(range(-RADIUS, RADIUS + 1), repeat=4) if sum(map(abs, d)) <= RADIUS and d >= zero]


def forest(a: np.ndarray, b: np.ndarray | None) -> list[tuple[int, int]]:
    """A spanning forest of the links between fingerprints of ``a`` and ``b``, or within ``a``."""
    both = a if b is None else np.concatenate([a, b])
    parent, out = np.arange(len(both)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    right = both[len(a) :] if b is not None else a
    base = len(a) if b is not None else 0
    step = max(1, BLOCK // max(1, len(right)))
    for low in range(0, len(a), step):
        near = np.bitwise_count(a[low : low + step, None] ^ right[None, :]) <= RADIUS
        rows, cols = np.nonzero(near)
        rows, cols = rows + low, cols + base
        while True:
            labels = np.array([root(int(x)) for x in np.unique(np.concatenate([rows, cols]))]) if len(rows) else None
            if labels is None:
                break
            nodes = np.unique(np.concatenate([rows, cols]))
            left, other = labels[np.searchsorted(nodes, rows)], labels[np.searchsorted(nodes, cols)]
            open_ = left != other
            if not open_.any():
                break
            rows, cols = rows[open_], cols[open_]
            pairs, at = np.unique(np.stack([left[open_], other[open_]]), axis=1, return_index=True)
            for x, y, i in zip(*pairs.tolist(), at.tolist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((int(rows[i]), int(cols[i])))
    return [(int(both[i]), int(both[j])) for i, j in out]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        edges: list[tuple[int, int]] = []
        for i in range(batch.num_rows):
            a = batch.column("a")[i].values.to_numpy().view(np.uint64)
            same = batch.column("same")[i].as_py()
            edges += forest(a, None if same else batch.column("b")[i].values.to_numpy().view(np.uint64))
        table = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], ["x", "y"])


def links(marks: DataFrame) -> DataFrame:
    """(x, y) of different fingerprints that link all that are within the radius of each other.

    ``marks`` has each fingerprint once. Tiles are cut by a hash to about ``TILE`` entries and numbered; pairs of tiles
    meet by number first: every cut of a class lists its partners' numbers of cuts, so a class of any size is dealt by
    (class, cut). Members, 16 KB a tile, are then brought by number, and each pair is one row.
    """
    place = sum((_segment(i).cast("long") * 32**i for i in range(4)), F.lit(0).cast("long"))
    placed = marks.select("mark", place.alias("place"))
    cuts = materialize(placed.groupBy("place").agg(F.ceil(F.count("*") / TILE).cast("int").alias("cuts")))  # at most 17^4 rows
    tiles = (
        placed.join(F.broadcast(cuts), "place")
        .withColumn("cut", F.pmod(F.xxhash64("mark"), "cuts").cast("int"))
        .groupBy("place", "cut")
        .agg(F.collect_list("mark").alias("members"))
    )
    tiles = materialize(tiles)
    shifts = F.array(*[F.lit(sum(x * 32**i for i, x in enumerate(d))).cast("long") for d in _offsets()])
    names = tiles.select(F.col("place").alias("p"), F.col("cut").alias("c"), F.explode(shifts).alias("shift"))
    other = F.broadcast(cuts.withColumnRenamed("cuts", "others"))
    names = names.withColumn("place", F.col("p") + F.col("shift")).join(other, "place")
    first = F.when(F.col("shift") == 0, F.col("c")).otherwise(F.lit(0))  # within a class each pair once
    pairs = names.withColumn("cut", F.explode(F.sequence(first, F.col("others") - 1)))
    left = tiles.select(F.col("place").alias("p"), F.col("cut").alias("c"), F.col("members").alias("a"))
    same = (F.col("place") == F.col("p")) & (F.col("cut") == F.col("c"))
    pairs = pairs.join(tiles, ["place", "cut"]).join(left, ["p", "c"])
    pairs = pairs.select("a", F.when(~same, F.col("members")).alias("b"), same.alias("same"))
    return pairs.mapInArrow(trimmed(_compare), "x long, y long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (x, y): root is the smallest node of its component.

    Alternates large-star and small-star contractions (Kiveris et al., 2014), each a partial aggregation and an
    equi-join, until nothing changes: the logarithm of the largest component in rounds.
    """
    now = materialize(edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).filter("x <> y").distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        large = materialize(large)
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").filter("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        now = materialize(small.unionByName(low.select("x", F.col("m").alias("y"))).distinct())
        found = now.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if found == state or found[0] == 0:
            break
        state = found
    roots = now.select(F.col("x").alias("node"), F.col("y").alias("root"))
    return roots.unionByName(now.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null text, like one without words, has fingerprint zero, which links like any other. Rows with null doc_id take
    part; a component of such rows only has a null id. Repeated rows are documents of one component.
    """
    each = _classes(row_keyed(docs))
    return each.select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")


def _classes(keyed: DataFrame) -> DataFrame:
    """file, index, doc_id, mark, component_id and root (what tells components without any id apart) of each row."""
    each = materialize(fingerprints(keyed))
    owners = materialize(each.groupBy("mark").agg(F.min("doc_id").alias("least")))
    roots = components(links(owners))
    named = owners.join(roots, owners.mark == roots.node, "left").select("mark", "least", F.coalesce("root", "mark").alias("root"))
    named = materialize(named)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_mark = named.join(ids, "root").select("mark", "root", "component_id")
    return each.join(by_mark, "mark")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns of ``docs``: the one with the smallest doc_id, and of rows that repeat
    that id one of them. A component of rows with null ids only keeps one of these. Whether rows repeat ids or texts
    makes no difference: rows are told apart by where they stand. An empty table stays empty."""
    keyed = row_keyed(docs)
    each = materialize(_classes(keyed).select("file", "index", "doc_id", "root"))
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "file", "index")
    first = each.groupBy("root").agg(F.min(place).alias("first")).select("first.file", "first.index")
    gone = materialize(each.select("file", "index").join(first, ["file", "index"], "left_anti"))
    return keyed.join(gone, ["file", "index"], "left_anti").select("doc.*")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
