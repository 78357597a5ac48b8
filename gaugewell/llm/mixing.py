"""Operator 1, mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents fall into blocks of about ``block_words`` words by a seeded hash, so the order of blocks and of documents in
them is a random permutation that any executor can recompute. Targets give each source a quota of whole block draws.
A binary tree over the output shards splits the vector of quotas: each node draws its left half from the multivariate
hypergeometric law, seeded by the node, until every shard has an exact quota of each source. Groups of sources go down
the tree first, the sources of a group then share what their group was given. Shards own disjoint ranges of the
permuted blocks, and rows are put in random order within their shard.

Sources, blocks and draws are tables: there may be any number of each. The driver holds the quotas of groups of GROUP
sources only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize, numbered, row_keyed

#: Weights of the sources in code point order, repeating; share of all sizes that the mix takes; most epochs (fixed values of the contract).
WEIGHTS, TOTAL_SHARE, MOST_EPOCHS = (5, 2, 1), 1.5, 2.0
#: Words of a block, about; sources of a group; blocks that are ranked in one window, about.
BLOCK_WORDS, GROUP, RANKED = 1 << 16, 4096, 4096
#: Draws of a shard, as long as there are fewer shards than SHARDS.
SHARD_DRAWS, SHARDS = 16, 4096
#: numpy draws from populations below this; standard deviations of the table that larger ones are drawn from.
NUMPY_MOST, SPREAD = 10**9, 12


def word_count(name: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(name), F.lit(WORD)), F.lit(0)).cast("long")


def with_targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = TOTAL_SHARE, epochs: float = MOST_EPOCHS) -> DataFrame:
    """``sources`` (position, source_size, ...) with target: ``share`` of all sizes by weight, at most ``epochs`` times
    its size, the excess reshared by weight among the others until none is above. Positions repeat ``weights``.

    All targets follow from one level, words for each unit of weight, that rises until no further source is full.
    """
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod("position", F.lit(len(weights))).cast("int"))
    cap, rows = F.col("source_size") * F.lit(epochs), sources.withColumn("__weight", weight)
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, known = 0.0, -1
    while True:
        full = cap <= F.lit(level) * F.col("__weight")
        sums = rows.agg(F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("__weight")))).first()
        if sums[0] == known or not sums[2]:
            break
        known, level = sums[0], (share * total - (sums[1] or 0)) / sums[2]
    full = cap <= F.lit(level) * F.col("__weight")
    return rows.withColumn("target", F.when(full, cap).otherwise(F.lit(level) * F.col("__weight"))).drop("__weight")


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from ``good + bad`` are good. Beyond numpy's range the probabilities around the mode are
    tabled from their ratios; what lies SPREAD deviations away is below what a double can tell from 0."""
    if not good or not draws:
        return 0
    if good + bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, draws))
    total = good + bad
    mode = (draws + 1) * (good + 1) // (total + 2)
    sd = (draws * (good / total) * (bad / total) * ((total - draws) / max(total - 1, 1))) ** 0.5
    reach = int(SPREAD * sd) + 16
    low, high = max(draws - bad, 0, mode - reach), min(good, draws, mode + reach)
    x = np.arange(low, high)
    steps = np.log(good - x) + np.log(draws - x) - np.log(x + 1.0) - np.log(bad - draws + x + 1.0)
    log_p = np.concatenate(([0.0], np.cumsum(steps)))
    upto = np.cumsum(np.exp(log_p - log_p.max()))
    return low + int(np.searchsorted(upto, rng.random() * upto[-1], "right"))


def split_quotas(quotas: np.ndarray, shards: np.ndarray, seed: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, indices, counts) for every shard: a matrix with columns that sum to ``quotas`` and rows that sum to
    ``shards``. Every node of the tree gives its left half a multivariate hypergeometric draw of its own quotas."""
    upto = np.concatenate(([0], np.cumsum(shards)))
    stack = [(0, len(shards), np.flatnonzero(quotas), quotas[quotas > 0])]
    while stack:
        low, high, index, have = stack.pop()
        if high - low == 1:
            yield low, index, have
            continue
        middle = (low + high) // 2
        left, rest, pool = np.zeros_like(have), int(upto[middle] - upto[low]), int(have.sum())
        rng = np.random.default_rng([*seed, low, high])
        for i, n in enumerate(have.tolist()):  # one hypergeometric draw after another is the multivariate law
            pool -= n
            got = hypergeometric(rng, n, pool, rest) if rest else 0
            left[i], rest = got, rest - got
        right = have - left
        stack.append((middle, high, index[right > 0], right[right > 0]))
        stack.append((low, middle, index[left > 0], left[left > 0]))


def _ranges(seed: int):
    """Ranges of turns that each shard owns of the sources of one group."""

    def run(sources: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        sources, shards = sources.sort_values("position"), shards.sort_values("shard")
        position, names, group = sources["position"].to_numpy(), shards["shard"].to_numpy(), int(sources["group"].iloc[0])
        given, out = np.zeros(len(position), np.int64), []
        for shard, index, counts in split_quotas(sources["quota"].to_numpy(), shards["n"].to_numpy(), [seed, 1, group]):
            out.append((np.full(len(index), names[shard]), position[index], given[index], given[index] + counts))
            given[index] += counts
        columns = [np.concatenate([np.empty(0, np.int64), *(o[i] for o in out)]) for i in range(4)]
        return pd.DataFrame({"shard": columns[0].astype(np.int32), "position": columns[1], "low": columns[2], "high": columns[3]})

    return run


def _ranked(rows: DataFrame, words: bool) -> DataFrame:
    """``rows`` (position, block, h, bits, words) with nth, their number within the position in order of h, and
    ``before``, the words of those with smaller numbers. Each window holds the rows of one range of h, or one row for
    each range of a position."""
    part = F.when(F.col("bits") > 0, F.expr("shiftright(h, 64 - bits)")).otherwise(F.lit(0)).alias("part")
    rows = rows.select("*", part)
    amount = F.sum("words") if words else F.lit(0)
    parts = rows.groupBy("position", "part").agg(F.count("*").alias("n"), amount.alias("w"))
    earlier = W.partitionBy("position").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sum_of = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long")
    parts = parts.select("position", "part", sum_of("n", earlier).alias("n0"), sum_of("w", earlier).alias("w0"))
    order = W.partitionBy("position", "part").orderBy("h", "block")
    rows = rows.join(parts, ["position", "part"]).withColumn("nth", F.row_number().over(order) - 1 + F.col("n0"))
    if words:
        rows = rows.withColumn("before", sum_of("words", order.rowsBetween(W.unboundedPreceding, -1)) + F.col("w0"))
    return rows.drop("part", "n0", "w0")


def _source() -> Column:
    return F.col("doc.source").cast("string").alias("source")


def _order(seed: int) -> Column:
    return F.xxhash64("doc.doc_id", F.coalesce("doc.text", F.lit("")), F.lit(seed)).alias("order")


def _placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` (source, order, ...) with position and block in place of source."""
    known = sources.select(F.col("source").alias("of"), "position", "blocks")
    rows = rows.join(known, rows["source"].eqNullSafe(known["of"])).drop("of", "source")
    return rows.withColumn("block", F.pmod("order", "blocks")).drop("blocks")


def plan(keyed: DataFrame, shards: int | None = None, block_words: int = BLOCK_WORDS, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sources, draws) of the mix of ``keyed``, as ``row_keyed`` gives it.

    rows: file, index, doc_id, size, order, position, block for each document; sources: source, position, source_size,
    target, blocks; draws: position, block, epoch, shard, partial, fill, one row for each time that a shard draws a block.
    """
    spark = keyed.sparkSession
    rows = materialize(keyed.select("file", "index", "doc.doc_id", _source(), word_count("doc.text").alias("size"), _order(seed)))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = numbered(materialize(sizes), [F.col("source").isNull(), F.col("source")], "position")
    blocks = F.greatest(F.lit(1), F.round(F.col("source_size") / block_words)).cast("long")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(blocks / RANKED))).cast("int")
    sources = materialize(with_targets(sources).withColumns({"blocks": blocks, "bits": bits}))
    rows = materialize(_placed(rows, sources))

    # cumulative words over the permuted blocks of a source; the block in which the target falls is taken in part
    least = F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")
    sums = rows.groupBy("position", "block").agg(F.sum("size").alias("words"), least)
    sums = sums.withColumn("h", F.xxhash64("position", "block", F.lit(seed))).join(sources.select("position", "bits"), "position")
    epochs = F.least(F.floor(F.col("target") / F.col("source_size") + 1e-12), F.lit(int(MOST_EPOCHS)))
    sums = _ranked(sums, True).join(sources.select("position", "source_size", "target"), "position")
    sums = sums.withColumn("epochs", F.when(F.col("source_size") > 0, epochs).otherwise(0).cast("int"))
    rest = F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 1e-6).cast("long")
    fill = F.least(F.greatest(rest - F.col("before"), F.lit(0)), F.col("words"))
    sums = materialize(sums.withColumn("fill", fill).drop("source_size", "target"))
    further = _carried(rows, sums)
    sums = sums.join(further, ["position", "block"], "left").withColumn("fill", F.coalesce("carried", "fill")).drop("carried")

    # turns number the draws of a source: all its blocks once in each whole epoch, then those of the last one
    whole = sums.join(sums.groupBy("position").agg(F.count("*").alias("live")), "position")
    whole = whole.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1))).filter("epoch < epochs")
    names = ["position", "block", "epoch", "turn", "partial", "fill"]
    whole = whole.withColumns({"turn": F.col("epoch") * F.col("live") + F.col("nth"), "partial": F.lit(False), "fill": F.col("words")}).filter("epochs > 0").select(names)
    last = _ranked(sums.filter("fill > 0").drop("nth", "before"), False)
    last = last.join(sums.groupBy("position").agg(F.count("*").alias("live")), "position")
    last = last.withColumns({"epoch": F.col("epochs"), "turn": F.col("epochs") * F.col("live") + F.col("nth"), "partial": F.col("fill") < F.col("words")}).select(names)
    turns = materialize(whole.unionByName(last))

    # exact quotas of each source, split over the shards by groups of sources, then within each group
    quotas = turns.groupBy("position").agg(F.count("*").alias("quota")).withColumn("group", F.floor(F.col("position") / GROUP).cast("int"))
    groups = quotas.groupBy("group").agg(F.sum("quota").alias("n")).orderBy("group").collect()  # one row for GROUP sources
    total = sum(r.n for r in groups)
    shards = shards or max(1, min(SHARDS, total // SHARD_DRAWS))
    even = np.diff(np.arange(shards + 1) * total // shards)
    given = [(groups[i].group, j, n) for j, index, have in split_quotas(np.array([r.n for r in groups], np.int64), even, [seed, 0]) for i, n in zip(index.tolist(), have.tolist(), strict=True)]
    given = spark.createDataFrame(given, "group int, shard int, n long")
    owned = quotas.groupBy("group").cogroup(given.groupBy("group")).applyInPandas(_ranges(seed), "shard int, position long, low long, high long")
    owned = owned.select("position", "shard", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("turn"))
    return rows, sources, materialize(turns.join(owned, ["position", "turn"]).drop("turn"))


def _carried(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """position, block, carried: words that blocks behind a partly taken one get of what did not fit there.

    In each round every source that still has words left goes on in the order of its blocks: blocks without a document
    that fits are passed, whole blocks are taken while they fit, and the next one in part. A source ends when no
    document behind is small enough.
    """
    names = ["position", "block", "nth", "fill"]
    out, part = None, sums.filter("fill > 0 and fill < words").select(names)
    while True:
        filled = rows.filter("size > 0").join(part, ["position", "block"])
        left = filled.groupBy("position", "block").applyInPandas(_left, "position long, after long, left long")
        left = materialize(left.filter("left > 0"))
        behind = sums.join(left, "position").filter("nth > after")
        begin = behind.filter("least <= left").groupBy("position").agg(F.min_by("before", "nth").alias("base"), F.min("nth").alias("start"))
        fits = behind.join(begin, "position").filter("nth >= start and before - base < left")
        fits = fits.withColumn("fill", F.least("words", F.col("left") - F.col("before") + F.col("base"))).filter("fill > 0")
        found = materialize(fits.select(*names, (F.col("fill") < F.col("words")).alias("open")))
        if found.isEmpty():
            none = rows.sparkSession.createDataFrame([], "position long, block long, carried long")
            return none if out is None else materialize(out.select("position", "block", F.col("fill").alias("carried")))
        out = found if out is None else out.unionByName(found)
        part = found.filter("open").drop("open")


def _left(pdf: pd.DataFrame) -> pd.DataFrame:
    """What documents of one partly taken block leave of its words."""
    left = int(pdf["fill"].iloc[0]) - int(_chosen(pdf)["size"].sum())
    return pd.DataFrame({"position": pdf["position"].iloc[:1], "after": pdf["nth"].iloc[:1], "left": [left]})


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    return _chosen(pdf)[["file", "index", "epoch", "shard"]]


def _chosen(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one partly taken block: documents in their random order, each taken if it still fits."""
    pdf = pdf.sort_values(["order", "doc_id", "size"], na_position="last", kind="stable")
    left, chosen = int(pdf["fill"].iloc[0]), []
    for size in pdf["size"].tolist():
        chosen.append(size <= left)
        left -= size * chosen[-1]
    return pdf.loc[chosen]


def drawn(to: DataFrame, rows: DataFrame, draws: DataFrame) -> DataFrame:
    """``to`` (file, index, position, block, ...) with shards: the output shards that draw a row, one for each time.

    A block holds about ``block_words`` words whatever its source holds, so each partly taken block of a source is
    a bounded group once documents without words, of which there may be any number, are left out. Rows meet draws by
    block, of which there is one for thousands of words, and the few rows that are chosen one by one by place.
    """
    times = draws.filter("not partial").groupBy("position", "block").agg(F.sort_array(F.collect_list("shard")).alias("shards"))  # one for each epoch
    part = rows.filter("size > 0").join(draws.filter("partial"), ["position", "block"])
    part = part.groupBy("position", "block").applyInPandas(_fill, "file long, index long, epoch int, shard int")
    part = part.select("file", "index", F.array("shard").alias("more"))
    none = F.array().cast("array<int>")
    all_ = F.concat(F.coalesce("shards", none), F.coalesce("more", none))
    found = to.join(materialize(times), ["position", "block"], "left").join(materialize(part), ["file", "index"], "left")
    return found.withColumn("shards", all_).drop("more")


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards for each document: ``shards`` lists the output shards that draw
    it, and ``taken`` is its size for each of them.

    Size is the number of words, 0 for null text; null is a source of its own and comes last. Every source meets its
    target but for less than its smallest document left. Repeated rows (same id, text and source) are documents of
    their own and get the same choice where a block is taken whole; in a partly taken block each is chosen for itself.
    One text in two sources is two documents. Documents without words are never needed to fill a target: they are
    taken with whole blocks, at 0 words. An empty table gives no rows.
    """
    rows, sources, draws = plan(row_keyed(docs), **options)
    found = drawn(rows, rows, draws).join(sources.select("position", "source_size", "target"), "position")
    taken = (F.col("size") * F.size("shards")).cast("long")
    return found.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "shards")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: all columns of ``docs``, each row as often as ``mix_counts`` says, whatever repeats its id or text.
    A shard's rows lie in one partition, in random order."""
    keyed, seed = row_keyed(docs), options.get("seed", 42)
    rows, sources, draws = plan(keyed, **options)
    wide = _placed(keyed.select("doc", "file", "index", _source(), _order(seed)), sources)
    out = drawn(wide, rows, draws).select("doc", "file", "index", F.posexplode("shards").alias("time", "shard"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = out.repartition(partitions, "shard").sortWithinPartitions("shard", F.xxhash64("file", "index", "time", F.lit(seed)))
    return out.select("doc.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
