"""Operator 5, language ID by multilingual mixture inference.

Training counts byte trigrams of words for each language over every labelled training document. A document's trigrams
are then a mixture of the languages' likelihoods: expectation-maximisation estimates its proportions, and the language
set is grown from the most likely ones for as long as the penalised likelihood rises. Batches of documents are one
sparse array, so an iteration is a few numpy calls for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, slices, trimmed, utf8

#: Buckets of trigrams, added to each count, iterations of a fit.
BUCKETS, SMOOTHING, ITERATIONS = 1 << 15, 0.1, 10
#: Languages up to which the likelihoods are one full table; with more, counts are kept sparse and a document's
#: likelihoods are made in parts of so many numbers.
DENSE_LANGUAGES, NUMBERS = 256, 1 << 22
#: Each character is in three trigrams, so log-likelihoods count a third; weight of the penalty log(n)/2 for a language.
OVERLAP, PENALTY = 3.0, 3.0
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every trigram whose middle is in a word, and where each document's begin, with the end. ASCII is
    lower-cased, and its other characters part words; a document counts as if between spaces."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    text = np.full(len(data) + n + 1, 32, np.uint32)
    at = np.arange(len(data)) + doc + 1
    text[at] = _FOLD[data]
    middle = at[text[at] != 32]
    code = (text[middle - 1] << 16) | (text[middle] << 8) | text[middle + 1]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int64)
    return bucket, np.searchsorted(middle, offsets + np.arange(n + 1))


def sparse_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different buckets of each document, how often it has each, and where each document's begin, with the end."""
    bucket, begin = trigrams(column)
    keys, counts, sizes = [], [], [0]
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if b - a > BUCKETS // 8:
            all_ = np.bincount(bucket[a:b], minlength=BUCKETS)
            key = np.flatnonzero(all_)
            count = all_[key]
        else:
            key, count = np.unique(bucket[a:b], return_counts=True)
        keys.append(key)
        counts.append(count)
        sizes.append(len(key))
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *keys]), np.concatenate([empty, *counts]), np.cumsum(sizes)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in found.items():
            key = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(key), pa.string()), "bucket": pa.array(key, pa.int32()), "n": pa.array(counts[key], pa.int64())})
        found.clear()

    for batch in batches:
        for part in slices(batch):
            bucket, begin = trigrams(part.column("text"))
            codes = part.column("lang").dictionary_encode()
            which = np.repeat(codes.indices.to_numpy(zero_copy_only=False), np.diff(begin))
            for i, lang in enumerate(codes.dictionary.to_pylist()):
                counts = np.bincount(bucket[which == i], minlength=BUCKETS)
                found[lang] = found[lang] + counts if lang in found else counts
            if len(found) > 64:
                yield from flush()
    yield from flush()


def held_out(name: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5, is 0; a null id counts as the empty text, which is held out."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Model:
    """Likelihoods of trigrams in any number of languages, from the counts that are not 0 (language, bucket, n)."""

    def __init__(self, languages: list[str], lang: np.ndarray, bucket: np.ndarray, n: np.ndarray):
        self.languages, self.likelihood = languages, None
        order = np.lexsort((lang, bucket))
        self.lang, self.n = lang[order].astype(np.int32), n[order]
        self.begin = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        by_lang = np.argsort(lang, kind="stable")
        ends = np.searchsorted(lang[by_lang], np.arange(len(languages) + 1))
        self.total = np.empty(len(languages))
        for i in range(len(languages)):
            row, own = np.zeros(BUCKETS), by_lang[ends[i] : ends[i + 1]]
            row[bucket[own]] = n[own]
            self.total[i] = (row + SMOOTHING).sum()
        if len(languages) <= DENSE_LANGUAGES:
            self.likelihood = self.rows(np.arange(BUCKETS))  # buckets x languages

    def rows(self, key: np.ndarray) -> np.ndarray:
        """The likelihoods of some buckets in all languages."""
        if self.likelihood is not None:
            return self.likelihood[key]
        sizes = self.begin[key + 1] - self.begin[key]
        at = np.repeat(self.begin[key] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        out = np.zeros((len(key), len(self.languages)))
        out[np.repeat(np.arange(len(key)), sizes), self.lang[at]] = self.n[at]
        out += SMOOTHING
        out /= self.total
        return out

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The language's number and score of each document; -1 without trigrams or languages."""
        key, count, begin = sparse_counts(column)
        docs, some = len(begin) - 1, np.flatnonzero(np.diff(begin))
        best, score = np.full(docs, -1), np.zeros(docs)
        if not len(self.languages) or not len(some):
            return best, score
        starts, sizes = begin[some], np.diff(begin)[some]
        total = np.add.reduceat(count, starts)
        if self.likelihood is not None:
            p = self.rows(key)
            fit = Fit(p, count, starts, sizes, total)
            alone = np.add.reduceat(np.log(p) * count[:, None], starts, axis=0)
        else:
            fit = PartFit(self.rows, key, count, starts, sizes, total)
            alone = fit.alone(len(self.languages))
        share, _ = fit.run(np.ones((len(some), len(self.languages)), bool), ITERATIONS)
        order = np.argsort(-share, axis=1, kind="stable")
        single = alone / OVERLAP
        order[:, 0], keep = single.argmax(axis=1), order[:, 0].copy()
        swap = order[:, 1:] == order[:, :1]  # the likeliest alone leads; what it displaced takes its place
        order[:, 1:] = np.where(swap, keep[:, None], order[:, 1:])
        chosen = np.zeros_like(share)
        chosen[np.arange(len(some)), order[:, 0]] = 1
        value = single.max(axis=1) - PENALTY * np.log(total + 1) / 2
        open_ = np.arange(len(some))
        for k in range(2, len(self.languages) + 1):
            mask = np.zeros((len(open_), len(self.languages)), bool)
            np.put_along_axis(mask, order[open_, :k], True, axis=1)
            share, logl = fit.of(open_).run(mask, ITERATIONS)
            new = logl / OVERLAP - k * PENALTY * np.log(total[open_] + 1) / 2
            better = new > value[open_]
            open_ = open_[better]
            if not len(open_):
                break
            value[open_], chosen[open_] = new[better], share[better]
        top = chosen.argmax(axis=1)
        odds = np.exp(single - single.max(axis=1, keepdims=True))
        certain = np.maximum(odds[np.arange(len(some)), top] / odds.sum(axis=1), chosen.max(axis=1) * (chosen.max(axis=1) < 1))
        best[some], score[some] = top, np.clip(chosen.max(axis=1) * certain, 0, 1)
        return best, score


class Fit:
    """Proportions of languages in many documents at once: ``p`` has a row for each different trigram of each."""

    def __init__(self, p, count, starts, sizes, total):
        self.p, self.count, self.starts, self.sizes, self.total = p, count, starts, sizes, total

    def of(self, docs: np.ndarray) -> Fit:
        if len(docs) == len(self.sizes):
            return self
        sizes = self.sizes[docs]
        starts = np.cumsum(sizes) - sizes
        rows = np.repeat(self.starts[docs] - starts, sizes) + np.arange(sizes.sum())
        return Fit(self.p[rows], self.count[rows], starts, sizes, self.total[docs])

    def run(self, allowed: np.ndarray, iterations: int) -> tuple[np.ndarray, np.ndarray]:
        share = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(iterations):
            weight = self.p * np.repeat(share, self.sizes, axis=0)
            weight *= (self.count / weight.sum(axis=1))[:, None]
            share = np.add.reduceat(weight, self.starts, axis=0) / self.total[:, None]
        mixed = np.einsum("ij,ij->i", self.p, np.repeat(share, self.sizes, axis=0))
        return share, np.add.reduceat(self.count * np.log(mixed), self.starts)


class PartFit:
    """The same for models whose likelihoods don't fit at once: ``rows`` makes those of a part of the trigrams."""

    def __init__(self, rows, key, count, starts, sizes, total):
        self.rows, self.key, self.count, self.starts, self.sizes, self.total = rows, key, count, starts, sizes, total

    def of(self, docs: np.ndarray) -> PartFit:
        sizes = self.sizes[docs]
        starts = np.cumsum(sizes) - sizes
        at = np.repeat(self.starts[docs] - starts, sizes) + np.arange(sizes.sum())
        return PartFit(self.rows, self.key[at], self.count[at], starts, sizes, self.total[docs])

    def parts(self, languages: int):
        """(document, likelihoods, counts) of parts of one document at a time."""
        step = max(1, NUMBERS // languages)
        for d, (start, size) in enumerate(zip(self.starts.tolist(), self.sizes.tolist(), strict=True)):
            for low in range(start, start + size, step):
                part = slice(low, min(low + step, start + size))
                yield d, self.rows(self.key[part]), self.count[part]

    def alone(self, languages: int) -> np.ndarray:
        out = np.zeros((len(self.sizes), languages))
        for d, p, count in self.parts(languages):
            out[d] += count @ np.log(p)
        return out

    def run(self, allowed: np.ndarray, iterations: int) -> tuple[np.ndarray, np.ndarray]:
        share = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(iterations):
            new = np.zeros_like(share)
            for d, p, count in self.parts(share.shape[1]):
                new[d] += share[d] * ((count / (p @ share[d])) @ p)
            share = new / self.total[:, None]
        logl = np.zeros(len(self.sizes))
        for d, p, count in self.parts(share.shape[1]):
            logl[d] += count @ np.log(p @ share[d])
        return share, logl


def train(docs: DataFrame) -> Model:
    """A model from every row of ``docs`` with text and lang, of all languages. Counts are summed on the executors; the
    driver gets those that are not 0, at most BUCKETS for each language however long the corpus is."""
    rows = docs.filter("text is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    counts = rows.mapInArrow(trimmed(_count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.filter("n > 0").toArrow()
    names = table.column("lang").combine_chunks().dictionary_encode() if table.num_rows else pa.array([], pa.string()).dictionary_encode()
    known = names.dictionary.to_pylist()
    languages = sorted(known)
    number = {x: i for i, x in enumerate(languages)}
    place = np.array([number[x] for x in known], np.int64)
    lang = place[names.indices.to_numpy(zero_copy_only=False)] if len(known) else np.empty(0, np.int64)
    return Model(languages, lang, table.column("bucket").to_numpy(), table.column("n").to_numpy())


def _predict(model: Model, keep: bool):
    names = np.array([*model.languages, UNKNOWN], object)
    limit = SLICE_BYTES * 4 // max(4, len(model.languages))  # a fit holds a number for each trigram and language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", limit):
                best, score = model.predict(part.column("__text"))
                unknown = ~part.column("__letter").to_numpy(zero_copy_only=False) | (best < 0)
                best[unknown], score[unknown] = len(names) - 1, 0.0
                if keep:
                    wanted = [c for c in part.schema.names if c not in ("__text", "__letter")]
                    said = pa.array(names[best].tolist(), pa.string())
                    columns = [said.cast(part.column(c).type) if c == "lang" else part.column(c) for c in wanted]
                    yield pa.RecordBatch.from_arrays(columns, wanted).filter(pa.array(~unknown))
                else:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def _prepared() -> list[Column]:
    text = F.col("text").cast("string")
    return [text.alias("__text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("__letter")]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (share of the language times how sure it is).

    ``und`` at score 0 where text is null or has no letter, or where no language could be learned. Long texts count
    whole; repeated rows get equal results. Only the text is used.
    """
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), *_prepared())
    return rows.mapInArrow(trimmed(_predict(model, False)), "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that have a language, all columns, with the predicted language as ``lang`` if they have such
    a column; those that would be ``und`` (null text, no letter) go. Repeated rows and null ids are rows like others."""
    return docs.select("*", *_prepared()).mapInArrow(trimmed(_predict(model, True)), docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out())


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(training_rows(docs)))
