"""Operator 6, byte-level BPE encoding and decoding by corpus-level merge replay.

Texts are split and held as numbers of pieces until they make a corpus: as many texts of an Arrow batch as bring a given
number of new different pieces. Those lie end to end as byte tokens in one array with links to their neighbours. An
inverted index maps the rank of a token pair to the positions where it stands; merges are replayed over all pieces at
once in rank order, and a merge touches its two neighbours' entries only. Pieces that a worker has met before come from
its table of codes, so frequent words are merged once. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, slices, text_or_empty, trimmed

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces whose codes a worker keeps (about 15 MB); beyond it the last corpus's most frequent ones, half as many, stay,
#: which costs time but changes no result.
KEPT_PIECES = 60_000
#: New different pieces, and their characters, that end a corpus. Larger corpora take fewer steps and more memory.
CORPUS_PIECES = 80_000
CORPUS_CHARACTERS = 1 << 20
#: Pieces, repeats included, that end a corpus: what its split texts take is 4 bytes each.
CORPUS_LENGTH = 1 << 22
#: Tokens whose bytes are looked up at once.
DECODED = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


NONE = np.int32(-1)


class MergeReplay:
    """Codes of pieces under ``ranks``, the tokens' bytes by rank; every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.byte = ranks, np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        # every pair of tokens whose bytes are a token, by left * 2^32 + right, and what it merges to
        get, keys, values = ranks.get, [], []
        for rank, token in enumerate(tokens):
            for cut in range(1, len(token)):
                left, right = get(token[:cut]), get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        order = np.argsort(keys)
        self.keys, self.values = np.array([*keys, 1 << 62])[[*order, len(keys)]], np.array([*values, -1], np.int32)[[*order, len(keys)]]

    def merged(self, left: np.ndarray | int, right: np.ndarray | int) -> np.ndarray:
        """Rank of each pair's merge, -1 if it has none."""
        key = np.asarray(left, np.int64) << 32 | right
        at = self.keys.searchsorted(key)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Codes of each piece as little-endian unsigned 32-bit integers. A piece that is a token is that token, even
        where no merges lead to it."""
        whole = [self.ranks.get(p) for p in pieces]
        rest = iter(self._merge([p for p, rank in zip(pieces, whole, strict=True) if rank is None]))
        return [next(rest) if rank is None else rank.to_bytes(4, "little") for rank in whole]

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        if not pieces:
            return []
        text = np.frombuffer(b"".join(pieces), np.uint8)
        lengths = np.array([len(p) for p in pieces])
        first = np.cumsum(lengths) - lengths
        n = len(text)
        place = np.int32 if n < 1 << 31 else np.int64
        owner = np.repeat(np.arange(len(pieces), dtype=place), lengths)
        symbol = self.byte[text]
        after, before = np.arange(1, n + 1, dtype=place), np.arange(-1, n - 1, dtype=place)
        after[first + lengths - 1] = -1
        before[first] = -1
        pair = np.full(n, NONE)  # what the pair that starts here merges to; -2 where a token has been taken in
        paired = np.flatnonzero(after >= 0).astype(place)
        pair[paired] = self.merged(symbol[paired], symbol[paired + 1])

        index: dict[int, list[np.ndarray]] = {}  # the inverted index: a pair's rank -> positions
        heap: list[int] = []

        def add(ranks: np.ndarray, positions: np.ndarray) -> None:
            good = ranks >= 0
            ranks, positions = ranks[good], positions[good]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            begin = [0, *cuts.tolist()]
            for rank, a, b in zip(ranks[begin].tolist(), begin, [*begin[1:], len(ranks)], strict=True):
                if rank in index:
                    index[rank].append(positions[a:b])
                else:
                    index[rank] = [positions[a:b]]
                    heapq.heappush(heap, rank)

        add(pair[paired], paired)
        while heap:
            now = heapq.heappop(heap)
            found = index.pop(now)
            at = np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
            at = at[pair[at] == now]  # elsewhere a neighbour's merge took one of the pair's tokens
            if not len(at):
                continue
            valid = at
            gone, right, left = after[at], after[after[at]], before[at]
            chained = gone[:-1] == at[1:]
            if chained.any():  # of pairs that overlap (a run of one token), every other one from the left
                step = np.arange(len(at))
                take = (step - np.maximum.accumulate(np.where(np.concatenate(([True], ~chained)), step, 0))) % 2 == 0
                at, gone, right, left = at[take], gone[take], right[take], left[take]
            # merges of a piece go from the left until one makes a pair of lower rank, which has to be merged before the rest
            beside = np.concatenate(([False], (right[:-1] == at[1:])))  # the left neighbour is the merge just before
            from_left = np.where(left >= 0, self.merged(np.where(beside, now, symbol[left]), now), -1)
            to_right = np.where(right >= 0, self.merged(now, symbol[right]), -1)
            lower = ((from_left >= 0) & (from_left < now)) | ((to_right >= 0) & (to_right < now))
            if lower.any():
                own = owner[at]
                earlier = np.cumsum(lower) - lower
                first_of = np.concatenate(([True], own[1:] != own[:-1]))
                go = earlier == np.maximum.accumulate(np.where(first_of, earlier, 0))
                index[now] = [valid]
                heapq.heappush(heap, now)
                at, gone, right = at[go], gone[go], right[go]
            symbol[at], after[at], pair[gone] = now, right, -2
            before[right[right >= 0]] = at[right >= 0]
            left = before[at]
            apart = np.concatenate(([True], left[1:] != at[:-1]))
            touched = np.concatenate([at, left[apart & (left >= 0)]])
            follow = after[touched]
            ranks = np.where(follow >= 0, self.merged(symbol[touched], symbol[follow]), -1)
            pair[touched] = ranks
            add(ranks, touched)
        kept = pair != -2
        held = np.concatenate(([0], np.cumsum(kept)))
        raw = symbol[kept].astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(held[first].tolist(), held[first + lengths].tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ``ids`` end to end, and where each id's bytes begin, with the end."""
        begin = np.concatenate(([0], np.cumsum(self.lengths[ids])))
        out = np.empty(begin[-1], np.uint8)
        for at in range(0, len(ids), DECODED):
            some, start = ids[at : at + DECODED], begin[at : at + DECODED + 1]
            inside = np.arange(start[0], start[-1]) + np.repeat(self.starts[some] - start[:-1], self.lengths[some])
            out[start[0] : start[-1]] = self.bytes[inside]
        return out, begin


class _Numbers(dict):
    """Numbers pieces in the order in which they are first looked up, and counts their characters."""

    characters = 0

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.characters += len(piece)
        return number


class Encoder:
    """Splits texts by a pattern and encodes each match separately, without special tokens. A split text is held as the
    numbers of its pieces, 4 bytes each."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, kept: int = KEPT_PIECES):
        self.replay, self.split, self.kept = MergeReplay(ranks), regex.compile(pattern).findall, kept
        self.forget()

    def forget(self) -> None:
        self.numbers, self.codes = _Numbers(), []

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        return next(self.encode_parts([texts]))

    def encode_parts(self, parts: Iterable[list[str]], pieces: int = CORPUS_PIECES) -> Iterator[list[bytes]]:
        """Codes of the texts of each part, in order. Parts are merged together as one corpus, up to its limits."""
        waiting: list[list[array]] = []
        length = 0
        for texts in parts:
            number = self.numbers.__getitem__
            waiting.append([array("I", map(number, self.split(text))) for text in texts])
            length += sum(map(len, waiting[-1]))
            if len(self.numbers) - len(self.codes) >= pieces or self.numbers.characters >= CORPUS_CHARACTERS or length >= CORPUS_LENGTH:
                yield from self._corpus(waiting)
                waiting, length = [], 0
        yield from self._corpus(waiting)

    def _corpus(self, waiting: list[list[array]]) -> Iterator[list[bytes]]:
        codes = self.codes
        codes += self.replay.encode([p.encode() for p in islice(self.numbers, len(codes), None)])
        self.numbers.characters = 0
        if len(codes) > self.kept:
            self._keep_frequent(waiting)
        for split in waiting:
            yield [b"".join(map(codes.__getitem__, pieces)) for pieces in split]

    def _keep_frequent(self, waiting: list[list[array]]) -> None:
        counts = np.zeros(len(self.codes), np.int64)
        for split in waiting:
            for pieces in split:
                np.add.at(counts, np.frombuffer(pieces, np.uint32), 1)
        stay = np.argsort(-counts, kind="stable")[: self.kept // 2]
        names = list(self.numbers)
        self.numbers = _Numbers((names[i], n) for n, i in enumerate(stay.tolist()))
        self.codes = [self.codes[i] for i in stay.tolist()]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder_of(ranks: dict[bytes, int], pattern: str) -> Encoder:
    """An encoder that a worker's later tasks use again, but for its pieces: they go with the task, to free memory."""
    key = (hashlib.sha256(b"".join(b"%d %b\n" % (rank, token) for token, rank in ranks.items())).hexdigest(), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks, pattern)
    _ENCODERS[key].forget()
    return _ENCODERS[key]


def _encoded(ranks: dict[bytes, int], pattern: str, corpus_pieces: int, output: Callable[[MergeReplay, pa.RecordBatch, list[bytes]], pa.RecordBatch]):
    """For ``mapInArrow``: the output of each part of a batch and its texts' codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(ranks, pattern)
        for batch in batches:
            parts = list(slices(batch, limit=SLICE_BYTES))
            texts = (part.column("text").to_pylist() for part in parts)
            for part, coded in zip(parts, encoder.encode_parts(texts, corpus_pieces), strict=True):
                yield output(encoder.replay, part, coded)
        encoder.forget()

    return run


def _digests(replay: MergeReplay, part: pa.RecordBatch, coded: list[bytes]) -> pa.RecordBatch:
    counts = np.array([len(c) // 4 for c in coded])
    text, begin = replay.decode(np.frombuffer(b"".join(coded), "<u4"))
    raw = text.tobytes()
    ends = begin[np.cumsum(counts)]
    starts = begin[np.cumsum(counts) - counts]
    out = {
        **{c: part.column(c) for c in part.schema.names if c != "text"},
        "n_tokens": pa.array(counts, pa.int64()),
        "ids_sha256": pa.array([hashlib.sha256(c).hexdigest() for c in coded]),
        "decoded_sha256": pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]),
    }
    return pa.RecordBatch.from_pydict(out)


def _ids(replay: MergeReplay, part: pa.RecordBatch, coded: list[bytes]) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum([len(c) // 4 for c in coded]))).astype(np.int32)
    ids = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["doc_id", "ids"])


def _texts(ranks: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = encoder_of(ranks, public_tokenizers.PATTERN).replay
        for batch in batches:
            rows = [np.array(x if x is not None else [], np.int64) for x in batch.column("ids").to_pylist()]
            out = [replay.decode(x)[0].tobytes().decode("utf-8", "replace") for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return run


def _narrow(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), *(F.col(c).cast("string") for c in more), text_or_empty().alias("text"))


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids (array of int) of each document; null and empty texts have no ids."""
    ranks = read_ranks(path or public_tokenizers.path(VOCABULARY))
    return _narrow(docs).mapInArrow(trimmed(_encoded(ranks, pattern, CORPUS_PIECES, _ids)), "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give an empty text."""
    ranks = read_ranks(path or public_tokenizers.path(VOCABULARY))
    return coded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(_texts(ranks), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, more: tuple[str, ...] = (), corpus_pieces: int = CORPUS_PIECES) -> DataFrame:
    """doc_id, the columns ``more`` as text, n_tokens, ids_sha256, decoded_sha256 of each document: its ids and the bytes
    that they decode to. Smaller corpora take less memory and more time, and give the same results.

    Null counts as empty: no tokens, digests of nothing. A text of any length is encoded whole. Every row is encoded
    for itself, so repeated rows and null ids get their own results. An empty table gives no rows.
    """
    ranks = read_ranks(path or public_tokenizers.path(VOCABULARY))
    names = "".join(f"`{c}` string, " for c in more)
    schema = f"doc_id long, {names}n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _narrow(docs, more).mapInArrow(trimmed(_encoded(ranks, pattern, corpus_pieces, _digests)), schema)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
