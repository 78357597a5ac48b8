"""Operator 3, substring dedup by recompression.

A round of recompression names every maximal run of a symbol and every pair of a left and a right symbol; a symbol's
side is a bit of its name. Inside equal substrings the symbols of every round are the same, but for a few at either
end. For each window of words that loss is followed from both ends through the rounds, from the window's own words
alone; the symbol boundary that survives the most rounds is the window's anchor, and the words from there on are its
top symbol. Equal windows therefore always have equal top symbols, and neighbouring windows share theirs. Names of the
two lower rounds (runs and pairs of one to four words) are keyed hashes of their content, equal everywhere without an
exchange; Spark rounds settle what is above:

1. whole texts by digest, so that all copies but the smallest are settled at once;
2. packs of documents send the names of their different top symbols and learn which ones other packs have too;
3. windows with such symbols are named, and each name's smallest document becomes its owner; the others claim it;
4. the words of what is claimed are sent, adjoining windows as one passage, and every claimed window is compared with
   them word by word. An owner answers FANOUT packs at most, those answer FANOUT others each, and so on;
5. words covered by windows that passed go.

No decision on a window rests on a hash: one that is claimed and differs makes the operator start anew with other
names. A symbol or window sends one entry for each pack, whatever the number of its documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, bucketed, last_only, materialize, slices, text_bytes, utf8

#: Words of a window (fixed value of the contract) and of a top symbol; rounds of recompression below it.
WINDOW, KEY, ROUNDS = 13, 6, 2
#: Parts that each group of equal texts is dealt over; bytes of a text's digest.
SALTS, DIGEST = 16, 32
#: Bytes of text in a pack; a longer document is a pack alone. Names in a bucket, about, and names for each byte of text.
PACK_BYTES, BUCKET_NAMES, NAMES_A_BYTE = 2 << 20, 1 << 20, 0.05
#: Bytes of text for each task that packs meet their answers in; bytes of owners' words that are compared at once.
TASK_BYTES, COMPARED_BYTES = 32 << 20, 4 << 20
#: Words beyond so many bytes are named one by one. Packs that an owner answers for one window: those answer others.
LONG_WORD, FANOUT = 256, 64
#: Kinds of answers to a pack.
COPIES, PAYLOAD = 0, 1

_U = np.uint64
_BYTE, _WORD = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mix(left * _BYTE + _mix(right + _WORD))


def _ahead(names: np.ndarray, step: int) -> np.ndarray:
    """The name ``step`` words on; those beyond the end are never part of a window."""
    return np.concatenate([names[step:], names[:step]])


def word_names(different: pa.Array, seed: int) -> np.ndarray:
    """128 bits (two columns) for each different word, from all its bytes and the seed, eight bytes at a time."""
    width = np.int64 if pa.types.is_large_binary(different.type) else np.int32
    _, offsets, data = different.buffers()
    begin = np.frombuffer(offsets, width, len(different) + 1, different.offset * np.dtype(width).itemsize).astype(np.int64)
    raw = np.concatenate([np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))  # the eight bytes from every place on
    sizes = np.diff(begin)
    out = np.empty((len(sizes), 2), _U)
    out[:, 0] = _mix(sizes.astype(_U) + _U(2 * seed) * _WORD)
    out[:, 1] = _mix(sizes.astype(_U) + _U(2 * seed + 1) * _WORD)
    rest = np.flatnonzero(sizes <= LONG_WORD)
    step = 0
    while len(rest):
        left = sizes[rest] - step
        chunk = eight[begin[rest] + step]
        short = left < 8
        chunk[short] &= (_U(1) << (left[short] * 8).astype(_U)) - _U(1)
        out[rest, 0] = _mix((out[rest, 0] ^ _mix(chunk + _BYTE)) * _BYTE)
        out[rest, 1] = _mix((out[rest, 1] ^ _mix(chunk + _WORD)) * _WORD)
        rest, step = rest[left > 8], step + 8
    key = seed.to_bytes(8, "little")
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[i] = np.frombuffer(hashlib.blake2b(raw[begin[i] : begin[i + 1]], digest_size=16, key=key).digest(), _U)
    return out


class Pack:
    """Words of some documents with the names of their windows and of their top symbols."""

    def __init__(self, column: pa.Array, seed: int = 0):
        self.words = Words(column)
        coded = self.words.array().dictionary_encode()
        self.different, self.codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        names = word_names(self.different, seed)
        self.hashes, self._second = names[self.codes, 0], names[:, 1]
        counts = self.words.counts
        self.doc = np.repeat(np.arange(len(counts)), counts)
        windows = np.maximum(counts - WINDOW + 1, 0)
        self.starts = np.arange(windows.sum()) + np.repeat(self.words.first[:-1] - (np.cumsum(windows) - windows), windows)
        self.window_doc = np.repeat(np.arange(len(counts)), windows)
        two = _pair(self.hashes, _ahead(self.hashes, 1))
        self._two, self._four = two, _pair(two, _ahead(two, 2))

    def top(self, at: np.ndarray) -> np.ndarray:
        """Names of the KEY words from ``at`` on."""
        return _pair(self._four[at], self._two[at + 4])

    def marks(self, starts: np.ndarray | None = None) -> np.ndarray:
        """64-bit names of the windows at ``starts``, or of all."""
        at = self.starts if starts is None else starts
        eight = _pair(self._four[at], self._four[at + 4])
        return _pair(_pair(eight, self._four[at + 8]), self.hashes[at + 12])

    def checks(self, starts: np.ndarray) -> np.ndarray:
        """32 more bits of the windows at ``starts``, from the other half of the words' names."""
        out = np.zeros(len(starts), _U)
        for k in range(WINDOW):
            out = _pair(out, self._second[self.codes[starts + k]])
        return (out >> _U(32)).astype(np.uint32)

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the windows at ``a`` and ``b`` have the same words."""
        same = np.ones(len(a), bool)
        for k in range(WINDOW):
            same &= self.codes[a + k] == self.codes[b + k]
        return same

    def anchors(self) -> np.ndarray:
        """Word at which each window's anchor is: at most WINDOW - KEY after its start."""
        best = self.starts.copy()
        if not len(best):
            return best
        name, doc = self.hashes, self.doc
        at = np.arange(len(name))  # word where each symbol begins
        live = np.arange(len(best))  # windows that still have symbols of the round
        left, right = self.starts, self.starts + WINDOW  # their certain symbols
        for turn in range(ROUNDS):
            # runs: the first may begin before the window and the last may end after it
            new = np.ones(len(name), bool)
            new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
            run = np.cumsum(new) - 1
            head = np.flatnonzero(new)
            length = np.diff(np.append(head, len(name))).astype(_U)
            left, right = run[left] + 1, run[right - 1]
            name, doc, at = np.where(length > 1, _mix(name[head] + length * _BYTE), name[head]), doc[head], at[head]
            ok = left < right
            left, right, live = left[ok], right[ok], live[ok]
            # pairs: a right symbol may close a pair that begins before, a left symbol one that ends after
            side = (_mix(name ^ _U(turn + 1)) & _U(1)).astype(bool)
            left, right = left + side[left], right - ~side[right - 1]
            ok = left <= right
            left, right, live = left[ok], right[ok], live[ok]
            closes = np.zeros(len(name), bool)
            closes[1:] = side[1:] & ~side[:-1] & (doc[1:] == doc[:-1])
            head = np.flatnonzero(~closes)
            index = np.cumsum(~closes) - 1
            opens = np.append(closes[1:], False)[head]
            following = name[np.minimum(head + 1, len(name) - 1)]
            total, ends = len(head), len(name)
            name = np.where(opens, _mix(name[head] ^ _mix(following + _WORD)), name[head])
            at, doc = at[head], doc[head]
            left, right = np.where(left < ends, index[np.minimum(left, ends - 1)], total), np.where(right < ends, index[np.minimum(right, ends - 1)], total)
            ok = left < right
            left, right, live = left[ok], right[ok], live[ok]
            # of the window's certain symbols that begin early enough, the one whose name comes first in a random order
            rank, limit = _mix(name ^ _WORD), self.starts[live] + WINDOW - KEY
            here, symbol, least = np.arange(len(live)), left, np.full(len(live), ~_U(0))
            while len(here):
                ok = (symbol < right[here]) & (at[np.minimum(symbol, total - 1)] <= limit[here])
                here, symbol = here[ok], symbol[ok]
                lower = rank[symbol] < least[here]
                least[here[lower]] = rank[symbol[lower]]
                best[live[here[lower]]] = at[symbol[lower]]
                symbol = symbol + 1
            if not len(live):
                break
        return best

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Different keys of the pack, sorted, and the number of each window's key among them."""
        place, which = np.unique(self.anchors(), return_inverse=True)  # ascending: anchors never go back far, so few
        keys, number = np.unique(self.top(place), return_inverse=True)
        return keys, number[which]


def _cut(sorted_values: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of values that are cut into equal ranges of 64 bits."""
    if not len(sorted_values):
        return []
    bucket = ((sorted_values >> _U(32)) * _U(buckets)) >> _U(32)
    found, begin = np.unique(bucket, return_index=True)
    return list(zip(found.tolist(), begin.tolist(), [*begin[1:].tolist(), len(bucket)], strict=True))


def _packs(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, task, n = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, limit=limit):
                sink = pa.BufferOutputStream()
                clean = part.take(pc.sort_indices(part.column("doc_id")))  # by id, null ids last
                with pa.ipc.new_stream(sink, clean.schema) as out:
                    out.write_batch(clean)
                data, offsets = utf8(clean.column("text"))
                raw, offsets = memoryview(data), offsets.tolist()
                digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=DIGEST).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True))
                out = {
                    "pack": pa.array([task << 32 | n], pa.int64()),
                    "body": pa.array([squeeze.compress(sink.getvalue().to_pybytes())], pa.binary()),
                    "ids": pa.array([clean.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "digests": pa.array([digests], pa.binary()),
                    }
                yield pa.RecordBatch.from_pydict(out)
                n += 1

    return run


class Opened:
    """A pack's documents: words, ids and the rank of each document's id, ascending; null ids come last and have none (-1)."""

    def __init__(self, body: bytes, seed: int):
        table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body)).read_all().combine_chunks()
        batch = table.to_batches()[0]
        self.column, known = batch.column("doc_id"), batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        values = self.column.fill_null(0).to_numpy(zero_copy_only=False)
        self.ids = np.unique(values[known])
        self.rank = np.full(len(values), -1, np.int64)
        self.rank[known] = np.searchsorted(self.ids, values[known])
        self.pack = Pack(batch.column("text"), seed)


def _bytes(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def _short(keys: np.ndarray) -> bytes:
    """Keys travel without their two high bytes, of which the bucket knows one: keys only choose what is compared."""
    return _bytes(keys.view(np.uint8).reshape(-1, 8)[:, :6])


def _long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(_U)[:, 0]


_LOW = _U((1 << 48) - 1)


def _send_keys(buckets: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, body in zip(batch.column("pack").to_pylist(), batch.column("body"), strict=True):
                keys, _ = Opened(body.as_py(), seed).pack.keys()
                cuts = _cut(keys, buckets)
                out = {"bucket": [c[0] for c in cuts], "pack": [pack] * len(cuts), "keys": [_short(keys[a:b]) for _, a, b in cuts]}
                yield _batch(out, KEYS)

    return run


KEYS = pa.schema([("bucket", pa.int64()), ("pack", pa.int64()), ("keys", pa.binary())])
WINDOWS = pa.schema([("bucket", pa.int64()), ("pack", pa.int64()), *((n, pa.binary()) for n in ("marks", "checks", "ids", "owners"))])
MEETING = pa.schema([("pack", pa.int64()), ("kind", pa.int32()), ("by", pa.int64()), ("payload", pa.binary())])


def _batch(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _payloads(to: list[int], by: list[int], payloads: list[bytes]) -> pa.RecordBatch:
    return _batch({"pack": to, "kind": [PAYLOAD] * len(to), "by": by, "payload": payloads}, MEETING)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one bucket after another, from rows in order of bucket."""
    have: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if have and have[0]["bucket"] != row["bucket"]:
                yield have
                have = []
            have.append(row)
    if have:
        yield have


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each pack the names of its top symbols that other packs have."""
    for rows in _by_bucket(batches):
        parts = [_long(r["keys"]) for r in rows]
        keys, source = np.concatenate(parts), np.repeat(np.arange(len(rows)), [len(p) for p in parts])
        order = np.argsort(keys, kind="stable")
        keys, source = keys[order], source[order]
        shared = np.zeros(len(keys), bool)
        again = keys[1:] == keys[:-1]
        shared[1:] |= again
        shared[:-1] |= again
        keys, source = keys[shared], source[shared]
        if len(keys):
            order = np.argsort(source, kind="stable")
            keys, (which, begin) = keys[order], np.unique(source[order], return_index=True)
            ends = [*begin[1:].tolist(), len(keys)]
            to = [rows[i]["pack"] for i in which.tolist()]
            yield _payloads(to, to, [_short(keys[a:b]) for a, b in zip(begin.tolist(), ends, strict=True)])


def _answers(right: pa.Table, kind: int) -> list[bytes]:
    return right.column("payload").filter(pc.equal(right.column("kind"), kind)).to_pylist()


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    return table[np.minimum(at, len(table) - 1)] == values


def _flags(copies: list[bytes], docs: int) -> np.ndarray:
    """Which documents of a pack are copies of a smaller one."""
    out = np.zeros(docs, bool)
    out[np.frombuffer(b"".join(copies), ">u4").astype(np.int64)] = True
    return out


def _send_windows(buckets: int, seed: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        shared = _answers(right, PAYLOAD)
        if not shared or not left.num_rows:
            return WINDOWS.empty_table()
        number, opened = left.column("pack")[0].as_py(), Opened(left.column("body")[0].as_py(), seed)
        pack, ids, rank = opened.pack, opened.ids, opened.rank
        keys, which = pack.keys()
        asked = _among(keys & _LOW, np.sort(_long(b"".join(shared))))
        sends = (rank >= 0) & ~_flags(_answers(right, COPIES), len(rank))  # the smallest of equal texts sends for all
        wanted = np.flatnonzero(asked[which] & sends[pack.window_doc])
        starts, owner = pack.starts[wanted], rank[pack.window_doc[wanted]]
        marks = pack.marks(starts)
        marks, first = np.unique(marks, return_index=True)  # owners ascend, so the first is the smallest
        starts, owner = starts[first], owner[first]
        checks = pack.checks(starts)
        cuts = _cut(marks, buckets)
        out = {"bucket": [c[0] for c in cuts], "pack": [number] * len(cuts), "ids": [], "owners": []}
        for name, array in (("marks", marks), ("checks", checks)):
            out[name] = [_bytes(array[a:b]) for _, a, b in cuts]
        for _, a, b in cuts:  # ids of the documents that own windows of this bucket
            used, index = np.unique(owner[a:b], return_inverse=True)
            out["ids"].append(_bytes(ids[used]))
            out["owners"].append(_bytes(index.astype(np.uint32)))
        return pa.Table.from_batches([_batch(out, WINDOWS)])

    return run


def _claims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To a pack with a window: which packs, with larger documents, ask it for the words. Packs with a window are in
    order of their documents, and the i-th asks number i // FANOUT, whose words are compared in the same way."""
    for rows in _by_bucket(batches):
        marks = np.concatenate([np.frombuffer(r["marks"], _U) for r in rows])
        checks = np.concatenate([np.frombuffer(r["checks"], np.uint32) for r in rows])
        owner = np.concatenate([np.frombuffer(r["ids"], np.int64)[np.frombuffer(r["owners"], np.uint32)] for r in rows])
        pack = np.repeat(np.array([r["pack"] for r in rows], np.int64), [len(r["marks"]) // 8 for r in rows])
        order = np.lexsort((pack, owner, checks, marks))
        marks, checks, owner, pack = marks[order], checks[order], owner[order], pack[order]
        first = np.ones(len(marks), bool)
        first[1:] = (marks[1:] != marks[:-1]) | (checks[1:] != checks[:-1])
        least = np.flatnonzero(first)[np.cumsum(first) - 1]
        later = np.flatnonzero(owner > owner[least])
        if not len(later):
            continue
        asked = least[later] + (later - least[later]) // FANOUT
        to, by, marks = pack[asked], pack[later], marks[later]
        order = np.lexsort((by, to))
        to, by, marks = to[order], by[order], marks[order]
        begin = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        ends = [*begin[1:].tolist(), len(marks)]
        payloads = [_bytes(np.concatenate([by[a:b].view(_U), marks[a:b]])) for a, b in zip(begin.tolist(), ends, strict=True)]
        yield _payloads(to[begin].tolist(), to[begin].tolist(), payloads)


def _send_words(seed: int):
    """To each pack that asks for windows their words: adjoining windows as one passage a line."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return MEETING.empty_table()
        opened = Opened(left.column("body")[0].as_py(), seed)
        number, pack, squeeze = left.column("pack")[0].as_py(), opened.pack, zstandard.ZstdCompressor(level=3)
        owned = np.count_nonzero(opened.rank[pack.window_doc] >= 0)
        table, at = np.unique(pack.marks()[:owned], return_index=True)
        text, begin, end = pack.words.joined()
        halves = [np.frombuffer(p, _U).reshape(2, -1) for p in right.column("payload").to_pylist()]
        by, wanted = np.concatenate(halves, axis=1)
        place = at[np.searchsorted(table, wanted)]
        order = np.lexsort((place, by))
        by, place = by[order].view(np.int64), place[order]
        starts = pack.starts[place]
        # passages of windows that adjoin, and where those for another pack begin
        other = by[1:] != by[:-1]
        cut = np.flatnonzero(other | (np.diff(starts) != 1) | (np.diff(pack.window_doc[place]) != 0)) + 1
        firsts, lasts = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(starts) - 1]))
        passages = [text[a:b] for a, b in zip(begin[starts[firsts]].tolist(), end[starts[lasts] + WINDOW - 1].tolist(), strict=True)]
        to, first = np.unique(by[firsts], return_index=True)
        ends = [*first[1:].tolist(), len(passages)]
        out = [squeeze.compress(b"\n".join(passages[a:b])) for a, b in zip(first.tolist(), ends, strict=True)]
        return pa.Table.from_batches([_payloads(to.tolist(), [number] * len(to), out)])

    return run


def _compared(pack: Pack, order: np.ndarray, ordered: np.ndarray, payloads: list[bytes], seed: int) -> tuple[np.ndarray, int]:
    """Which windows have the words of a received one, and how many have only its name; ``order`` are the windows that
    take part, by name, and ``ordered`` their names."""
    gone, wrong = np.zeros(len(pack.starts), bool), 0
    if not payloads:
        return gone, wrong
    unpack, part, size = zstandard.ZstdDecompressor(), [], 0
    for i, payload in enumerate(payloads):
        part += unpack.decompress(payload).split(b"\n")
        size += sum(map(len, part))
        if size < COMPARED_BYTES and i + 1 < len(payloads):
            continue
        theirs = Pack(pa.array(part, pa.large_binary()), seed)
        part, size = [], 0
        known = pc.index_in(theirs.different, value_set=pack.different).fill_null(-1).to_numpy(zero_copy_only=False)
        codes, found = known[theirs.codes], theirs.marks()
        low, high = np.searchsorted(ordered, found, "left"), np.searchsorted(ordered, found, "right")
        times = high - low
        mine = order[np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        a, b, same = pack.starts[mine], np.repeat(theirs.starts, times), np.ones(len(mine), bool)
        for k in range(WINDOW):
            same &= pack.codes[a + k] == codes[b + k]
        gone[mine[same]] = True
        wrong += int((~same).sum())
    return gone, wrong


def _finish(full: bool, seed: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        opened = Opened(left.column("body")[0].as_py(), seed)
        pack, rank = opened.pack, opened.rank
        owner = rank[pack.window_doc]
        owner = owner[: np.count_nonzero(owner >= 0)]  # windows of null ids come last and take no part
        marks = pack.marks()[: len(owner)]
        order = np.argsort(marks, kind="stable")
        marks, owner = marks[order], owner[order]
        gone, wrong = _compared(pack, order, marks, _answers(right, PAYLOAD), seed)
        # windows that a smaller document of the same pack has
        first = np.ones(len(order), bool)
        first[1:] = marks[1:] != marks[:-1]
        least = np.flatnonzero(first)[np.cumsum(first) - 1] if len(order) else order
        wrong += int((~pack.equal(pack.starts[order], pack.starts[order[least]])).sum())
        gone[order[owner > owner[least]]] = True
        gone |= _flags(_answers(right, COPIES), len(rank))[pack.window_doc]
        n = len(pack.codes)
        begins = pack.starts[gone]
        edge = np.bincount(begins, minlength=n + 1) - np.bincount(begins + WINDOW, minlength=n + 1)
        removed = np.cumsum(edge[:-1]) > 0
        return pa.Table.from_batches([_result(opened.column, pack.words, removed, wrong, full)])

    return run


def _result(ids: pa.Array, words: Words, removed: np.ndarray, wrong: int, full: bool) -> pa.RecordBatch:
    text, begin, end = words.joined()
    lengths = np.where(removed, 0, end - begin + 1)
    kept = np.frombuffer(text, np.uint8)[np.repeat(~removed, end - begin + 1)].tobytes()
    upto = np.concatenate(([0], np.cumsum(lengths)))[words.first]
    parts = [kept[a : b - 1] if b > a else b"" for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
    gone = np.concatenate(([0], np.cumsum(removed)))[words.first]
    out = {"doc_id": ids, "n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(np.diff(gone), pa.int64())}
    out["wrong"] = pa.array([wrong] * len(ids), pa.int64())
    if not full:
        out["kept_sha256"] = pa.array([hashlib.sha256(p).hexdigest() for p in parts])
        return pa.RecordBatch.from_pydict(out)
    spans = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        step = np.flatnonzero(np.diff(np.concatenate(([0], removed[a:b].astype(np.int8), [0]))))
        spans.append(step.reshape(-1, 2).tolist())
    out["removed"] = pa.array(spans, pa.list_(pa.list_(pa.int64())))
    out["kept"] = pa.array([p.decode() for p in parts])
    return pa.RecordBatch.from_pydict(out)


def _copied(packs: DataFrame) -> DataFrame:
    """Rows for the packs with the numbers of documents that are copies of a smaller one, by a 256-bit digest."""
    texts = packs.select("pack", "digests", F.posexplode("ids").alias("i", "doc_id")).filter("doc_id is not null")
    texts = texts.select("pack", "i", "doc_id", F.expr(f"substring(digests, i * {DIGEST} + 1, {DIGEST})").alias("digest"))
    least = texts.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a large group of copies meets in many tasks
    salted = texts.withColumn("salt", F.pmod(F.xxhash64("pack", "i"), F.lit(SALTS)).cast("int"))
    copies = salted.join(least, ["digest", "salt"]).filter("doc_id > least")
    numbers = F.array_join(F.collect_list(F.lpad(F.hex("i"), 8, "0")), "")  # at most the documents of one pack
    return copies.groupBy("pack").agg(F.unhex(numbers).alias("payload")).select("pack", F.lit(COPIES).alias("kind"), F.col("pack").alias("by"), "payload")


def _deduplicated(packs: DataFrame, copies: DataFrame, size: int, full: bool, seed: int) -> DataFrame:
    least = int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, int(size * NAMES_A_BYTE) // BUCKET_NAMES)
    by_bucket = lambda df: df.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    # packs lie where the exchange by pack would bring them: only answers move
    meet = lambda answers, f, schema: packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(f, schema)
    shared = by_bucket(packs.mapInArrow(_send_keys(buckets, seed), _ddl(KEYS))).mapInArrow(_shared_keys, _ddl(MEETING))
    windows = by_bucket(meet(copies.unionByName(shared), _send_windows(buckets, seed), _ddl(WINDOWS)))
    words = meet(windows.mapInArrow(_claims, _ddl(MEETING)), _send_words(seed), _ddl(MEETING))
    schema = "doc_id long, n_words long, n_removed long, wrong long, " + ("removed array<array<long>>, kept string" if full else "kept_sha256 string")
    return meet(copies.unionByName(words), _finish(full, seed), schema)


def deduplicated(docs: DataFrame, full: bool = True, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed of each document and, if ``full``, the removed [from, to) ranges of words and the
    text of the kept words, else that text's SHA-256.

    Null and empty texts have no words. A window counts if a document with a smaller id has it anywhere; documents with
    equal ids are not smaller than each other, and rows with a null id neither lose words nor make others lose any.
    An empty table gives no rows. A very long document is a pack alone, so its words must fit one worker.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = text_bytes(docs)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)
    with last_only(spark):
        packs = bucketed(docs.mapInArrow(_packs(pack_bytes), "pack long, body binary, ids array<long>, digests binary"), "pack", tasks)
        copies, packs = materialize(_copied(packs)), packs.select("pack", "body")
        for seed in count():
            out = materialize(_deduplicated(packs, copies, size, full, seed))
            if out.filter("wrong > 0").isEmpty():  # else two windows share a name: other names, and once more
                return out.drop("wrong")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"), full=False)
