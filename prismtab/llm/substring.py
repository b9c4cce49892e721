"""Substring dedup: repeated word windows by prefix-partitioned suffix trees.

Every word of a document begins a suffix, a sequence of words, each a 64-bit symbol. A
node of the suffixes' tree at the depth of a window (20 words) with two or more suffixes
below it is a window that repeats; runs of such windows are the maximal repeats. The tree
is built in groups of suffixes that share a prefix, whose length varies with its count:

1. Short prefixes are counted. Of a window's 13 prefixes of 8 words the one with the least hash
   stands for it, so equal windows have equal such prefixes, and one position in seven is counted.
   Windows of a prefix that occurs once are leaves and are not looked at again.
2. The counts say how many windows are left, hence how many groups of at most `budget` windows are
   dealt, each group holding all suffixes of its prefixes. A prefix with more than a 32nd of the budget, or
   an eighth of what its task counts at a time, is lengthened to the whole window first, so that its suffixes part. There
   are at most 64 such prefixes for each group and for each partition: that list is what is broadcast.
3. A group's suffixes are put in order by their paths to the depth of a window; neighbours in that order are
   compared symbol by symbol, and a stretch of equal ones is a deep internal node. Before they are sent, a task's own
   suffixes are ordered the same way and only the earliest of each node goes on, so a passage in a third of all
   documents costs a row for each task. A group that is fed more than its budget is reduced to the earliest of each
   node whenever it is full.

Suffixes travel as packed stretches of symbols with their places, never as text; the documents' text
is shuffled once, for both joins back to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismtab.llm.common import cut, partitions, raw, row_key, small_batches, steps, table
from prismtab.llm.words import gram_hashes, mix, spans, word_hashes

WINDOW, PREFIX = 20, 8
#: Windows that a task holds at a time, at about 35 bytes sent and 200 in work for each; raise it with the executors' memory.
BUDGET = 1 << 20
#: A prefix with more than BUDGET / LONGER windows, or more than a HOT-th of its stretch, is lengthened; stretches of a partition, gathered one by one.
LONGER, HOT, SUBS = 32, 8, 8
_LAST = np.iinfo(np.int64).max
#: What one flush says of a prefix: its windows, and this bit if it occurs more than once.
_MANY, _MOST = np.uint32(1 << 31), (1 << 31) - 1


def pack(columns: list[np.ndarray]) -> bytes:
    return b"".join([len(columns[0]).to_bytes(8, "little"), *[np.ascontiguousarray(c).tobytes() for c in columns]])


def unpack(blobs: list[bytes], kinds: tuple[str, ...]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for b in blobs:
        n, at = int.from_bytes(b[:8], "little"), 8
        for p, k in zip(parts, kinds, strict=True):
            p.append(np.frombuffer(b, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds, strict=True)]


def partition_keys(n: int) -> list[int]:
    """For each of n partitions a whole number that hash partitioning puts there (Murmur3 of an int with seed 42), so that n parts fill n partitions."""
    out, found, at = np.zeros(n, np.int64), np.zeros(n, bool), 0
    while not found.all():
        k = np.arange(at, at + 4 * n, dtype=np.uint64)
        at += 4 * n
        m = np.uint64(0xFFFFFFFF)
        turn = lambda x, r: ((x << np.uint64(r)) | (x >> np.uint64(32 - r))) & m
        h = turn(k * np.uint64(0xCC9E2D51) & m, 15) * np.uint64(0x1B873593) & m
        h = (turn(np.uint64(42) ^ h, 13) * np.uint64(5) + np.uint64(0xE6546B64)) & m
        h ^= np.uint64(4)
        h = (h ^ (h >> np.uint64(16))) * np.uint64(0x85EBCA6B) & m
        h = (h ^ (h >> np.uint64(13))) * np.uint64(0xC2B2AE35) & m
        h ^= h >> np.uint64(16)
        p = h.astype(np.uint32).view(np.int32).astype(np.int64) % n
        new, first = np.unique(p, return_index=True)
        fresh = ~found[new]
        out[new[fresh]], found[new[fresh]] = k[first[fresh]].astype(np.int64), True
    return out.tolist()


def grouped(keys: np.ndarray, columns: list[np.ndarray], kinds: tuple[str, ...]) -> Iterator[tuple[int, bytes]]:
    """For each key the columns' rows, in the order given, packed."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    columns = [c[order].astype(k) for c, k in zip(columns, kinds, strict=True)]
    edges = [*np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1 if len(keys) else 0)).tolist(), len(keys)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield int(keys[a]), pack([c[a:b] for c in columns])


def ragged(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places at, at + 1, ... of stretches of n, one stretch after the other."""
    return np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _batch(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _batches(rows: Iterator[tuple], kinds: tuple, names: list[str], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    some, size = [], 0
    for r in rows:
        some.append(r)
        size += 64 + len(r[-1])
        if size >= most:
            yield _batch(some, kinds, names)
            some, size = [], 0
    if some:
        yield _batch(some, kinds, names)


def anchors(words: np.ndarray, row: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The prefix hashes of all words; each window's first word; and the word at which its chosen prefix begins."""
    grams = gram_hashes(words, prefix)
    starts = np.flatnonzero(row[: len(row) - window + 1] == row[window - 1 :]) if len(row) >= window else np.zeros(0, np.int64)
    if not len(starts):
        return grams, starts, starts
    width = window - prefix + 1
    least = grams[: len(grams) - width + 1].copy()
    where = np.zeros(len(least), np.int64)
    for j in range(1, width):  # the first of equal ones
        other = grams[j : j + len(least)]
        less = other < least
        np.copyto(least, other, where=less)
        where[less] = j
    return grams, starts, starts + where[starts]


# What tasks send each other: rows (part, sub, kind, blob). part says the partition, sub the stretch of it; kind 0 is worked on,
# 1 only passed on, to its document, and 2 is what a task says of its prefixes.
_SENT = "part int, sub int, kind int, blob binary"
_SENT_KINDS, _SENT_NAMES = (pa.int32(), pa.int32(), pa.int32(), pa.binary()), ["part", "sub", "kind", "blob"]


def _dealt(sent: DataFrame, n: int) -> DataFrame:
    return sent.repartition(n, "part").sortWithinPartitions("part", "sub", "kind")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(len(batch)):  # blobs are large: one at a time
            yield tuple(c[i].as_py() for c in batch.columns)


def _stretches(rows: Iterator[tuple], passed: list[tuple]) -> Iterator[list[bytes]]:
    """The blobs of kind 0 of each part and sub. The rows come sorted by these; those of other kinds are put into passed."""
    key, blobs = None, []
    for part, sub, kind, blob in rows:
        if kind:
            passed.append((part, sub, kind, blob))
            if len(passed) >= 64:
                yield []
            continue
        if (part, sub) != key:
            if blobs:
                yield blobs
            key, blobs = (part, sub), []
        blobs.append(blob)
    yield blobs


def slots(rk: np.ndarray, n: int) -> np.ndarray:
    """The part and sub of a document, as part * SUBS + sub."""
    return (np.ascontiguousarray(rk).view(np.uint64) % np.uint64(n * SUBS)).astype(np.int64)


def _to_documents(rk: np.ndarray, columns: list[np.ndarray], kinds: tuple[str, ...], n: int, part_key: list[int], kind: int) -> Iterator[tuple]:
    """Rows (part, sub, kind, blob) of columns, dealt by document."""
    for p, blob in grouped(slots(rk, n), columns, kinds):
        yield part_key[p // SUBS], p % SUBS, kind, blob


def _by_document(dealt: DataFrame, kinds: tuple[str, ...], keys: int) -> DataFrame:
    """rk, doc, kind, blob: one row for each document, from blobs whose first `keys` columns are rk and perhaps the doc_id; blobs of kind 2 pass."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            passed: list[tuple] = []
            for blobs in _stretches(_rows(batches), passed):
                yield from ((None, None, 2, b) for *_, b in passed)
                passed.clear()
                columns = unpack(blobs, kinds)
                if not len(columns[0]):
                    continue
                key = np.lexsort(columns[:keys][::-1])
                columns = [c[key] for c in columns]
                new = np.ones(len(columns[0]), bool)
                new[1:] = np.any([c[1:] != c[:-1] for c in columns[:keys]], 0)
                edges = [*np.flatnonzero(new).tolist(), len(new)]
                for a, b in zip(edges, edges[1:], strict=False):
                    yield int(columns[0][a]), int(columns[1][a]) if keys > 1 else None, 0, pack([c[a:b] for c in columns[keys:]])

        yield from _batches(rows(), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), ["rk", "doc", "kind", "blob"])

    return dealt.mapInArrow(gather, "rk long, doc long, kind int, blob binary")


def _keyed(docs: DataFrame, more: list[str]) -> DataFrame:
    return docs.select(row_key("doc_id", "text").alias("rk"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)


def repeated_prefixes(docs: DataFrame, window: int, prefix: int, budget: int) -> DataFrame:
    """rk, kind, blob: with kind 0 for each document the words at which a chosen prefix begins that occurs elsewhere too;
    with kind 2 the hashes of prefixes with more than budget / LONGER windows, after a 0 with the number of all windows of repeated ones."""
    n_parts = partitions(docs.sparkSession)
    part_key = partition_keys(n_parts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[tuple]:
            h, rk, pos, n = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.argsort(h, kind="stable")
            h, rk, pos, n = h[order], rk[order], pos[order], n[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            lead = np.flatnonzero(new)
            said = np.minimum(np.add.reduceat(n, lead), _MOST).astype(np.uint32) | np.where(np.diff(np.append(lead, len(h))) > 1, _MANY, np.uint32(0))
            part = ((h[lead] >> np.uint64(24)) % np.uint64(n_parts * SUBS)).astype(np.int64)
            for p, blob in grouped(part, [h[lead], rk[lead], pos[lead], said], ("u8", "i8", "i4", "u4")):
                yield part_key[p // SUBS], p % SUBS, 0, blob
            yield from _to_documents(rk[~new], [rk[~new], pos[~new]], ("i8", "i4"), n_parts, part_key, 1)

        size = 0
        for batch in batches:
            for some in steps(batch, "text"):
                body, offsets = raw(some.column(1))
                starts, ends, row = spans(body, offsets)
                words = word_hashes(body, starts, ends)
                grams, _, at = anchors(words, row, window, prefix)
                if not len(at):
                    continue
                at, n = np.unique(at, return_counts=True)
                first = np.searchsorted(row, np.arange(len(some)))
                held.append((grams[at], some.column(0).to_numpy()[row[at]], at - first[row[at]], n))
                size += len(at)
                if size >= budget:
                    yield from _batches(flush(), _SENT_KINDS, _SENT_NAMES)
                    size = 0
        if held:
            yield from _batches(flush(), _SENT_KINDS, _SENT_NAMES)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            passed: list[tuple] = []
            total, long = 0, []
            for blobs in _stretches(_rows(batches), passed):
                yield from ((p, s, 0, b) for p, s, _, b in passed)
                passed.clear()
                h, rk, pos, said = unpack(blobs, ("u8", "i8", "i4", "u4"))
                if not len(h):
                    continue
                order = np.argsort(h)
                h, rk, pos, said = h[order], rk[order], pos[order], said[order]
                lead = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                times = np.diff(np.append(lead, len(h)))
                n = np.add.reduceat((said & ~_MANY).astype(np.int64), lead)
                many = (times > 1) | (said[lead] >= _MANY)
                total += int(n[many].sum())
                long.append(h[lead][many & ((n > budget // LONGER) | (n > max(64, int(n.sum()) // HOT)))])
                many = np.repeat(many, times)
                yield from _to_documents(rk[many], [rk[many], pos[many]], ("i8", "i4"), n_parts, part_key, 0)
            if total:
                yield part_key[0], 0, 2, pack([np.concatenate(([total], *long)).astype(np.uint64)])

        yield from _batches(rows(), _SENT_KINDS, _SENT_NAMES)

    sent = docs.select("rk", "text").mapInArrow(send, _SENT)
    return _by_document(_dealt(_dealt(sent, n_parts).mapInArrow(merge, _SENT), n_parts), ("i8", "i4"), 1)


@dataclass
class Suffixes:
    """Stretches of words, each of n windows that start one word after the other: doc, rk, the first one's place, n; and the symbols of all stretches in turn."""

    doc: np.ndarray
    rk: np.ndarray
    pos: np.ndarray
    n: np.ndarray
    symbols: np.ndarray

    def __len__(self) -> int:
        return int(self.n.sum())

    def packed(self, some: np.ndarray, window: int) -> bytes:
        """These stretches as a blob."""
        words = self.n + window - 1
        at = np.cumsum(words) - words
        symbols = self.symbols[ragged(at[some], words[some])]
        return pack([self.doc[some].astype("i8"), self.rk[some].astype("i8"), self.pos[some].astype("i4"), self.n[some].astype("i4")]) + symbols.tobytes()

    @staticmethod
    def read(blobs: list[bytes]) -> Suffixes:
        kinds = ("i8", "i8", "i4", "i4")
        sizes = [8 + int.from_bytes(b[:8], "little") * 24 for b in blobs]
        doc, rk, pos, n = unpack(blobs, kinds)
        return Suffixes(doc, rk, pos.astype(np.int64), n.astype(np.int64), np.concatenate([np.frombuffer(b, "u8", -1, s) for b, s in zip(blobs, sizes, strict=True)]) if blobs else np.zeros(0, "u8"))

    @staticmethod
    def joined(many: list[Suffixes]) -> Suffixes:
        return many[0] if len(many) == 1 else Suffixes(*[np.concatenate([getattr(x, c) for x in many]) for c in ("doc", "rk", "pos", "n", "symbols")])


def nodes(symbols: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix, beginning at a place of symbols, the number of its node at this depth: equal where its first `depth` symbols are.

    Suffixes are put in order by a hash of their path, and each is compared with the one before it, symbol by
    symbol. Should two paths share a hash, all are put in order by their symbols.
    """
    path = gram_hashes(symbols, depth)[at]
    order = np.argsort(path, kind="stable")
    new = np.append(True, path[order][1:] != path[order][:-1])[: len(at)]
    same = np.flatnonzero(~new)
    one, other = at[order[same]], at[order[same - 1]]
    if not all(np.array_equal(symbols[one + k], symbols[other + k]) for k in range(depth)):
        rows = symbols[at[:, None] + np.arange(depth)]
        order = np.lexsort(rows.T[::-1])
        new = np.append(True, (rows[order][1:] != rows[order][:-1]).any(1))
    out = np.empty(len(at), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def earliest(s: Suffixes, window: int) -> tuple[np.ndarray, tuple[np.ndarray, ...], Suffixes]:
    """Of the windows of s: the stretch of each; rk, doc, start of those that also start earlier in s; and the stretches from their first to their last window that does not.

    Earlier is a smaller doc_id, then a smaller rk, then an earlier word. A window that is here twice with one place counts once.
    """
    words = s.n + window - 1
    off = np.cumsum(words) - words
    owner = np.repeat(np.arange(len(s.n)), s.n)
    at = ragged(off, s.n)
    start = at - off[owner] + s.pos[owner]
    name = nodes(s.symbols, at, window)
    twice = np.flatnonzero(np.bincount(name)[name] > 1)
    o = owner[twice]
    order = np.lexsort((start[twice], s.rk[o], s.doc[o], name[twice]))
    w = twice[order]
    o = owner[w]
    new = np.append(True, name[w][1:] != name[w][:-1])[: len(w)]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    same = (s.rk[o] == s.rk[o[lead]]) & (s.doc[o] == s.doc[o[lead]]) & (start[w] == start[w[lead]]) if len(w) else new
    old = w[~same]
    stays = np.ones(len(at), bool)
    stays[w[~new]] = False
    # Each stretch from its first to its last window that stays.
    i = np.flatnonzero(stays)
    some, first = np.unique(owner[i], return_index=True)
    last = np.append(first[1:], len(i)) - 1
    a, b = i[first], i[last]
    n = b - a + 1
    left = Suffixes(s.doc[some], s.rk[some], start[a], n, s.symbols[ragged(at[a], n + window - 1)])
    return some, (s.rk[owner[old]], s.doc[owner[old]], start[old]), left


def _runs(rk: np.ndarray, doc: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """rk, doc, first window and how many, of the stretches of these windows."""
    order = np.lexsort((start, doc, rk))
    rk, doc, start = rk[order], doc[order], start[order]
    fresh = np.ones(len(rk), bool)
    fresh[1:] = (rk[1:] != rk[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    at = np.flatnonzero(fresh)
    ends = start[np.append(at[1:], len(start)) - 1] + 1 if len(at) else start
    return [rk[at], doc[at], start[at], ends - start[at]]


_RUN = ("i8", "i8", "i4", "i4")


def repeated_windows(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, budget: int = BUDGET) -> DataFrame:
    """rk, doc, blob: for each document the runs (first window, how many) of windows that also start earlier.

    docs: rk, doc_id, text, as of _keyed. Earlier is a smaller doc_id, then a smaller rk, then an earlier word.
    """
    n_parts = partitions(docs.sparkSession)
    prefixes = cut(repeated_prefixes(docs, window, prefix, budget))
    # One row for each task that found any; its prefixes are at most LONGER for each budget of windows, so 2 * LONGER for each group, and HOT for each of SUBS stretches.
    said = [unpack([r["blob"]], ("u8",))[0] for r in prefixes.filter("kind = 2").select("blob").collect()]
    total = sum(int(x[0]) for x in said)
    long = np.sort(np.concatenate([np.zeros(0, "u8"), *[x[1:] for x in said]]))
    n_groups = max(n_parts, -(-2 * total // budget))
    part_key, group_key = partition_keys(n_parts), partition_keys(n_groups)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[Suffixes, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[tuple]:
            every = Suffixes.joined([x[0] for x in held])
            group, deep = (np.concatenate([x[k] for x in held]) for k in (1, 2))
            held.clear()
            some, old, left = earliest(every, window)
            runs = _runs(*old)
            for slot, blob in grouped(slots(runs[0], n_parts), runs, _RUN):
                yield group_key[slot % n_groups], slot, 1, blob  # only to be passed on
            group, deep = group[some], deep[some]
            if deep.any():
                # A lengthened prefix: each window is a stretch of its own and goes by all its words.
                k = np.flatnonzero(deep)
                words = left.n + window - 1
                at = ragged((np.cumsum(words) - words)[k], left.n[k])
                owner = np.repeat(k, left.n[k])
                single = Suffixes(left.doc[owner], left.rk[owner], left.pos[owner] + ragged(np.zeros(len(k), np.int64), left.n[k]), np.ones(len(at), np.int64), left.symbols[ragged(at, np.full(len(at), window))])
                whole = gram_hashes(single.symbols, window)[::window]
                for g, rows in _split((mix(whole) % np.uint64(n_groups)).astype(np.int64)):
                    yield group_key[g], 0, 0, single.packed(rows, window)
            k = np.flatnonzero(~deep)
            for g, rows in _split(group[k]):
                yield group_key[g], 0, 0, left.packed(k[rows], window)

        size = 0
        for batch in batches:
            for some in steps(batch, "text"):
                body, offsets = raw(some.column(2))
                starts, ends, row = spans(body, offsets)
                words = word_hashes(body, starts, ends)
                grams, begins, at = anchors(words, row, window, prefix)
                if not len(begins):
                    continue
                first = np.searchsorted(row, np.arange(len(some) + 1))
                marked = np.zeros(len(words) + 1, bool)
                for i, blob in enumerate(some.column(3).to_pylist()):
                    marked[np.minimum(first[i] + unpack([blob], ("i4",))[0], first[i + 1])] = True
                marked[-1] = False
                keep = marked[at]
                begins, at = begins[keep], at[keep]
                if not len(begins):
                    continue
                lead = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (begins[1:] != begins[:-1] + 1)))
                n = np.diff(np.append(lead, len(at)))
                head, h = begins[lead], grams[at[lead]]
                r = row[head]
                stretch = Suffixes(pc.fill_null(some.column(1), _LAST).to_numpy()[r], some.column(0).to_numpy()[r], head - first[r], n, words[ragged(head, n + window - 1)])
                held.append((stretch, (mix(h) % np.uint64(n_groups)).astype(np.int64), np.isin(h, long)))
                size += len(begins)
                if size >= budget:
                    yield from _batches(flush(), _SENT_KINDS, _SENT_NAMES)
                    size = 0
        if held:
            yield from _batches(flush(), _SENT_KINDS, _SENT_NAMES)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            key, held, size, kept_size = None, [], 0, 0

            def reduce() -> Iterator[tuple]:
                _, old, left = earliest(Suffixes.joined(held), window)
                runs = _runs(*old)
                yield from _to_documents(runs[0], runs, _RUN, n_parts, part_key, 0)
                held[:] = [left]

            for part, slot, kind, blob in _rows(batches):
                if kind:
                    yield part_key[slot // SUBS], slot % SUBS, 0, blob
                    continue
                if part != key and held:
                    yield from reduce()
                    held, size, kept_size = [], 0, 0
                key = part
                held.append(Suffixes.read([blob]))
                size += len(held[-1])
                if size >= max(budget, kept_size):
                    yield from reduce()
                    size, kept_size = 0, len(held[0])
            if held:
                yield from reduce()

        yield from _batches(rows(), _SENT_KINDS, _SENT_NAMES)

    # All columns go along, though only four are looked at: so both joins to the text can read one shuffle of it.
    others = [c for c in docs.columns if c not in ("rk", "doc_id", "text")]
    marks = prefixes.filter("kind = 0").select("rk", "blob")
    candidates = docs.join(marks.hint("shuffle_hash"), "rk").select("rk", "doc_id", "text", "blob", *others)
    found = _dealt(candidates.mapInArrow(send, _SENT), n_groups).mapInArrow(merge, _SENT)
    return _by_document(_dealt(found, n_parts), _RUN, 2).select("rk", "doc", "blob")


def _split(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each number, and where it stands."""
    order = np.argsort(group, kind="stable")
    edges = [*np.flatnonzero(np.diff(group[order], prepend=-1)).tolist(), len(order)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield int(group[order[a]]), order[a:b]


def kept(text: bytes, blob: bytes | None, window: int) -> tuple[int, int, list[bytes]]:
    """Words, removed words, and the words that are left."""
    words = text.split()
    if blob is None:
        return len(words), 0, words
    start, size = unpack([blob], ("i4", "i4"))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + size + window - 1, -1)
    stay = np.cumsum(edge[:-1]) == 0
    return len(words), int(len(words) - stay.sum()), list(compress(words, stay.tolist()))


def with_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, more: list[str] = (), budget: int = BUDGET) -> DataFrame:
    """rk, doc_id, text, blob and more of every document: blob has its runs of windows that also start earlier, null for none."""
    keyed = _keyed(docs, list(more))
    found = repeated_windows(keyed, window, prefix, budget).hint("shuffle_hash").alias("f")
    # The key is the hash; that the ids are equal too is a condition beside it, so the text's one shuffle does for both joins.
    same = (F.col("k.rk") == F.col("f.rk")) & (F.coalesce("k.doc_id", F.lit(_LAST)).bitwiseXOR(F.col("f.doc")) == 0)
    return keyed.alias("k").join(found, same, "left").select("k.rk", "k.doc_id", "k.text", "f.blob", *[F.col(f"k.{c}") for c in more])


def removed(docs: DataFrame, window: int = WINDOW, budget: int = BUDGET) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256.

    Words are runs of bytes other than ASCII white space. A word goes if a window of `window` words
    that covers it also starts earlier, in a smaller doc_id or at an earlier word of the same document;
    of documents with one doc_id but other text, the one with the smaller row key counts as earlier,
    and rows equal in doc_id and text count as one document, each returned. A null doc_id comes last;
    null text has no words; other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t, b in zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                n, gone, words = kept(t, b, window)
                rows.append((i, n, gone, hashlib.sha256(b" ".join(words)).hexdigest()))
            yield _batch(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string()), ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return with_repeats(docs, window, budget=budget).mapInArrow(work, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with its texts without the repeated words. A text that loses none stays as it is; else the words left are joined by a blank. Null text becomes empty."""
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    inner = {c: f"more_{i}" for i, c in enumerate(more)}  # a column of any name may come along

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if b:
                    _, gone, words = kept(t.encode(), b, window)
                    t = b" ".join(words).decode() if gone else t
                out.append(t)
            yield pa.record_batch([batch.column(1), pa.array(out, pa.string()), *batch.columns[4:]], names=["doc_id", "text", *batch.schema.names[4:]])

    fields = ", ".join(["doc_id long, text string", *[f"{inner[c]} {docs.schema[c].dataType.simpleString()}" for c in more]])
    renamed = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(inner[c]) for c in more])
    out = with_repeats(renamed, window, more=list(inner.values())).mapInArrow(work, fields)
    return out.select(*[F.col(inner[c]).alias(c) if c in inner else F.col(c) for c in docs.columns])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return removed(table(spark, sf_dir, "documents"))
