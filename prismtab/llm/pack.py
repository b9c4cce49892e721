"""Best-fit packing planned on the histogram of lengths.

The driver sees only how many pieces have each length (at most `size` counts),
places equal lengths in bulk by best fit, longest first, and so makes slots:
runs of ranks within a length that go to consecutive sequences. Pieces take
their slot by joining on length and rank. Neither the plan nor its cost grows
with the number of documents, only with the number of different lengths.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismtab.llm.common import cut, raw, small_batches, steps, table, texts, together
from prismtab.llm.words import LOWER, chunks, mix, spans

SIZE = 4096
END_ID = 1
#: Bytes of text that are encoded at a time.
STEP = 4 << 20
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, 0x09, 0x0A]] = True
#: The steps before the model of the tokenizers that runs are made for; others encode whole texts.
STEPS = (
    'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\\s+"), content=" "), Lowercase()])',
    """Sequence(pretokenizers=[Split(pattern=Regex("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"), behavior=Removed, invert=True), ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])""",
)
#: Letters below this code point are letters for every version of Unicode.
LETTERS = "\u0500"
#: Byte-level models write a byte as a printable sign: itself, or where it has none, the next one from 256 on.
_SIGNED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_SIGNS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(_SIGNED))} | {0x20: 0x20}
#: ASCII letters, digits, apostrophe, other signs; 0 is anything else.
_CLASS = np.array([1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 if c == 0x27 else 4 if 0x20 < c < 0x7F else 0 for c in range(128)] + [0] * 128, np.uint8)
#: Neighbours (class of the first * 5 + class of the second) between which one match of the pattern ends and another begins.
_PARTED = np.zeros(25, bool)
_PARTED[[1 * 5 + 2, 1 * 5 + 3, 1 * 5 + 4, 2 * 5 + 1, 2 * 5 + 2, 2 * 5 + 3, 2 * 5 + 4, 3 * 5 + 2, 4 * 5 + 1, 4 * 5 + 2]] = True
#: Slots of a worker's table of runs (22 bytes each), the slots that a run may be in, and ids after which all are forgotten.
SLOTS, PROBES, IDS = 1 << 22, 8, 1 << 24
#: Slices of one length that are ranked apart have about so many pieces, or all pieces / SLICES.
SLICE, SLICES = 256, 65536


class Words:
    """Ids of texts by a tokenizer that drops white space, memoised by runs.

    The tokenizer is used as its library does by default, so the strings of its special tokens are
    those tokens. A blank, tab or line feed ends every match of its pattern (words, single digits,
    signs, English contractions), and so do a letter before a sign, a sign but the apostrophe before a letter,
    and a digit, all of ASCII. Neither normalisation nor merges reach over such a place, so a text's ids are
    those of the runs between them in turn, and the case of ASCII letters does not matter. Texts that hold
    a special token's string are parted at blanks alone.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known_steps = (repr(self.tokenizer.normalizer), repr(self.tokenizer.pre_tokenizer)) == STEPS
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        """An empty table of runs up to 16 bytes: the bytes as two numbers, and where the ids are."""
        self.first, self.second = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.at, self.size = np.zeros(SLOTS, np.int32), np.full(SLOTS, -1, np.int16)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _found(self, first: np.ndarray, second: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The slot of each run, -1 where it isn't known."""
        out = np.full(len(first), -1, np.int64)
        left = np.arange(len(first))
        for _ in range(PROBES):
            here = slot[left]
            hit = (self.first[here] == first[left]) & (self.second[here] == second[left]) & (self.size[here] >= 0)
            out[left[hit]] = here[hit]
            left = left[~hit & (self.size[here] >= 0)]
            slot = slot + 1 & SLOTS - 1
        return out

    def _remember(self, first: np.ndarray, second: np.ndarray, slot: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        """Puts different runs that aren't known in; one that finds no free slot is not remembered."""
        left = np.flatnonzero(size < 1 << 15)
        for _ in range(PROBES):
            here = slot[left]
            free = np.flatnonzero(self.size[here] < 0)
            _, one = np.unique(here[free], return_index=True)
            put = free[one]
            k = left[put]
            self.first[slot[k]], self.second[slot[k]], self.at[slot[k]], self.size[slot[k]] = first[k], second[k], at[k], size[k]
            left = np.delete(left, put)
            slot = slot + 1 & SLOTS - 1

    def _encoded(self, runs: list[str], parted: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all runs in turn, and how many each has.

        parted: were runs parted at signs and digits too? Then one of ASCII without an apostrophe is one match of the
        pattern, as are letters, and goes to the tokenizer's model at once; the others go through all its steps.
        """
        ids: list[list[int] | None] = [None] * len(runs)
        tokenize = self.model.tokenize
        marked = []
        for k, r in enumerate(runs if parted else ()):
            if r.isascii():
                if "'" not in r and r.isprintable():
                    ids[k] = [t.id for t in tokenize(r.lower())]
            elif r.isalpha():
                marked.append(k)
        if marked:
            normal = self.tokenizer.normalizer.normalize_str(" ".join([runs[k] for k in marked]))
            words, signs = normal.split(" "), normal.encode().decode("latin-1").translate(_BYTE_SIGNS).split(" ")
            for k, w, b in zip(marked, words, signs, strict=True) if len(words) == len(marked) else ():
                if w.isalpha() and max(w) < LETTERS:  # a small letter may be two signs, of which one is no letter
                    ids[k] = [t.id for t in tokenize(b)]
        others = [k for k, i in enumerate(ids) if i is None]
        for k, e in zip(others, self.tokenizer.encode_batch_fast([runs[k] for k in others], add_special_tokens=False), strict=True):
            ids[k] = e.ids
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a string column in turn, and the n + 1 offsets of its rows in them."""
        body, offsets = raw(col)
        if not self.known_steps:
            each = [e.ids for e in self.tokenizer.encode_batch_fast(texts(col), add_special_tokens=False)]
            return np.array(list(chain.from_iterable(each)), np.uint32), np.concatenate(([0], np.cumsum([len(e) for e in each], dtype=np.int64)))
        starts, ends, row = spans(body, offsets, IS_BLANK)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        whole = body.tobytes()
        if parted := not any(t.encode() in whole for t in self.special):
            kind = _CLASS[body]
            # A mark that follows may join with a small letter where it does not with its capital.
            body = np.where(np.append(body[1:] < 0x80, True), LOWER[body], body)
            new = np.zeros(len(body) + 1, bool)
            new[1:-1] = _PARTED[kind[:-1] * np.uint8(5) + kind[1:]]
            new[offsets] = False
            more = np.flatnonzero(new)
            starts, ends = np.sort(np.concatenate((starts, more))), np.sort(np.concatenate((ends, more)))
            row = np.searchsorted(offsets, starts, "right") - 1
        if self.used > IDS:
            self._forget()
        length = ends - starts
        nul = np.flatnonzero(body == 0)
        if len(nul):  # past the end stand zeros too, so these runs aren't remembered
            length[np.searchsorted(starts, nul, "right") - 1] = 17
        first, second = chunks(body, starts, length)
        slot = (mix(first ^ second * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(SLOTS - 1)).astype(np.int64)
        place = self._found(first, second, slot)
        place[length > 16] = -1
        size = np.where(place < 0, 0, self.size[place]).astype(np.int64)
        at = self.at[place].astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            # Every second string of this column is a run, the others are what stands between two runs.
            edges = np.empty(2 * len(new), np.int64)
            edges[0::2], edges[1::2] = starts[new], ends[new]
            strings = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(body))])
            coded = strings.take(pa.array(np.arange(0, len(edges) - 1, 2))).dictionary_encode()
            code = coded.indices.to_numpy()
            ids, sizes = self._encoded(coded.dictionary.to_pylist(), parted)
            while len(self.ids) < self.used + len(ids):
                self.ids = np.resize(self.ids, 2 * len(self.ids))
            self.ids[self.used : self.used + len(ids)] = ids
            ats = self.used + np.cumsum(sizes) - sizes
            size[new], at[new] = sizes[code], ats[code]
            one = np.full(len(sizes), -1)
            one[code] = new
            short = np.flatnonzero(length[one] <= 16)
            self.used += len(ids)
            self._remember(first[one[short]], second[one[short]], slot[one[short]], ats[short], sizes[short])
        upto = np.cumsum(size)
        out = self.ids[np.repeat(at - (upto - size), size) + np.arange(int(upto[-1]))]
        return out, np.concatenate(([0], upto))[np.searchsorted(row, np.arange(len(offsets)))]


_LOADED: dict[str, Words] = {}


def loaded(path: str) -> Words:
    if path not in _LOADED:
        _LOADED[path] = Words(path)
    return _LOADED[path]


def pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Each document's ids, then end_id, cut into pieces of `size` ids; the last may be shorter.

    Null and empty texts are the end id alone. Every row gives its pieces, also a repeated one. A long
    text is encoded as a whole, so a worker holds the ids of one step's texts or of its longest text.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = loaded(path)
        for batch in together(batches, "text", STEP):
            for part in steps(batch, "text", STEP):
                ids, offsets = words.encode(part.column(1))
                # One more id for each row, its last.
                ids = np.insert(ids, offsets[1:], np.uint32(end_id)).astype("<u4")
                offsets = offsets + np.arange(len(offsets))
                n = -(-np.diff(offsets) // size)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                lo = offsets[row] + piece * size
                hi = np.minimum(lo + size, offsets[row + 1])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                yield pa.record_batch([part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(piece * size, pa.int64()), pa.array(hi - lo, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, past the last rank, first sequence, pieces in each, offset) for so many pieces of each length.

    Longest first, each piece goes to the open sequence with the least room that holds it. Sequences
    of equal content are placed together: one with room r takes r // length pieces before the next is touched.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []  # sorted
    groups: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, how many)
    made = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= size:
            raise ValueError(f"a piece of {length} does not fit a sequence of {size}")
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                room, first, n = size, made, -(-left // (size // length))
                made += n
            else:
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            each = room // length
            full = min(n, left // each)
            if full:
                slots.append((length, rank, rank + full * each, first, each, size - room))
                rank, left = rank + full * each, left - full * each
                put(room - each * length, first, full)
            first, n = first + full, n - full
            if n and left:  # fewer than `each`
                slots.append((length, rank, rank + left, first, left, size - room))
                put(room - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(room, first, n)
    return slots


def ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """pieces with `rank`, 0 to count - 1 within each length, no length being ranked by one task.

    A length's pieces are cut by hash into slices of about equal size; a slice's first rank is the
    number of pieces in the slices before it.
    """
    each = max(SLICE, sum(counts.values()) // SLICES)
    spark = pieces.sparkSession
    # One row for each length: at most as many as a sequence has ids.
    cuts = spark.createDataFrame([(k, -(-n // each)) for k, n in counts.items()], "length long, n_slices long")
    cutted = pieces.join(F.broadcast(cuts), "length").withColumn("slice", F.expr("pmod(xxhash64(doc_id, piece, ids_crc32), n_slices)")).drop("n_slices")
    sizes = cutted.groupBy("length", "slice").agg(F.count("*").alias("n"))
    firsts = sizes.select("length", "slice", (F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")).alias("first"))
    within = F.row_number().over(Window.partitionBy("length", "slice").orderBy(F.col("doc_id").asc_nulls_last(), "piece", "ids_crc32"))
    return cutted.withColumn("within", within).join(firsts, ["length", "slice"]).withColumn("rank", F.col("within") - 1 + F.col("first")).drop("within", "first", "slice")


def place(cut_pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """cut_pieces (doc_id, piece, length, ids_crc32, ...) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    slots = best_fit(counts, size)
    # The plan's rows depend on the different lengths alone, so it is small for any number of documents.
    plan = cut_pieces.sparkSession.createDataFrame(slots or [(0, 0, 0, 0, 1, 0)], "length long, lo long, hi long, first long, each long, base long")
    r, p = ranked(cut_pieces, counts).alias("r"), F.broadcast(plan).alias("p")
    placed = r.join(p, (F.col("r.length") == F.col("p.length")) & (F.col("r.rank") >= F.col("p.lo")) & (F.col("r.rank") < F.col("p.hi")))
    return placed.select("r.*", F.expr("p.first + (r.rank - p.lo) div p.each").alias("sequence_id"), F.expr("p.base + (r.rank - p.lo) % p.each * r.length").alias("offset")).drop("rank")


def pack(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Packs all documents into as few sequences of at most `size` ids as best fit finds.

    Only documents longer than a sequence are cut. One row per piece: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset. Null text counts as empty; a null doc_id stays null; repeated rows
    are packed as often as they occur; an empty table gives no rows; other columns are not read.
    """
    out = place(cut(pieces(docs, path, size, end_id)), size)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
