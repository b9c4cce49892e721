"""Byte-level BPE: encoding by backtracking over Aho-Corasick matches, and decoding.

Bytes are mapped to Latin-1 so that pyahocorasick, which works on str, finds
every vocabulary entry in a piece. From a piece's start the longest match is
taken as long as it is compatible with the token before it, that is, if the
merges of both tokens' bytes side by side would leave these two tokens; if not,
the next shorter match is tried, and when none is left the token before is taken
back. A position is given up at most once, so the time is linear in the piece's
length. Compatibility of two adjacent tokens is memoised, as are whole pieces.
The result is that of merging by rank, exactly.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from prismtab.llm.common import small_batches, steps, table, texts

#: Entries a worker keeps at most; then it starts anew.
MEMO = 600_000


class ByteBPE:
    """A rank file's vocabulary. A piece that is an entry itself is that entry."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.entries = {i: t for t, i in self.ranks.items()}
        # The white space of Unicode: Python's \s also takes the separators U+001C to U+001F.
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.machine = ahocorasick.Automaton()
        for t, i in self.ranks.items():
            self.machine.add_word(t.decode("latin-1"), (len(t), i))
        self.machine.make_automaton()
        self.split: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for t, i in sorted(self.ranks.items(), key=lambda x: x[1]):
            pair = self._last_merge(t, i)
            self.split[i] = pair or (i, i)
            if pair:
                self.joined[pair] = i
        self.shorter = {i: self._prefix(t) for t, i in self.ranks.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.names: dict[int, str] = {i: str(i) for i in self.entries}

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two entries that become this one, once its bytes are merged by the ranks below its own."""
        if len(token) == 1:
            return None
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best[0] >= rank:
                return None  # merging never makes it: only a whole piece is this entry
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _prefix(self, token: bytes) -> int:
        for n in range(len(token) - 1, 0, -1):
            if (i := self.ranks.get(token[:n])) is not None:
                return i
        return -1

    def _compatible(self, left: int, right: int) -> bool:
        """Do the merges of both tokens' bytes leave them apart?"""
        limit = 1 << 60
        a, b = left, right
        while True:
            made = self.joined.get((a, b))
            if made is not None and made < limit:
                return False
            if a > b:
                limit, a = a, self.split[a][1]
                if a == limit:
                    limit, b = b + 1, self.split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.split[b][0]
                if b + 1 == limit:
                    limit, a = a, self.split[a][1]
                    if a == limit:
                        return True

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        n = len(data)
        longest = [-1] * n
        for end, (size, i) in self.machine.iter(data.decode("latin-1")):
            longest[end - size + 1] = i  # ends only grow, so the last is the longest
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        entries, fits, shorter = self.entries, self.fits, self.shorter
        at, token = 0, longest[0]
        while True:
            end = at + len(entries[token])
            ok = open_at[end]
            if ok and out:
                key = (out[-1], token)
                if (ok := fits.get(key)) is None:
                    if len(fits) > MEMO:
                        fits.clear()
                    ok = fits[key] = self._compatible(*key)
            if ok and self.split[token][0] == token and len(entries[token]) > 1:
                ok = False  # no merge makes it
            if ok:
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
                continue
            token = shorter[token]
            if token < 0:
                open_at[at] = 0
                token = out.pop()
                at -= len(entries[token])
                token = shorter[token]
                while token < 0:  # that token has no shorter one either
                    open_at[at] = 0
                    token = out.pop()
                    at -= len(entries[token])
                    token = shorter[token]

    def _pieces(self, text: str) -> bytes:
        out, known = [], self.pieces
        for p in self.pattern.findall(text):
            ids = known.get(p)
            if ids is None:
                ids = np.array(self.piece(p.encode()), "<u4").tobytes()
                if len(p) < 64:
                    if len(known) > MEMO:
                        known.clear()
                    known[p] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """The text's ids, without special tokens.

        Without two blanks in a row, no piece reaches over a blank's left side, so runs
        between blanks are memoised as a whole, each with the blank before it.
        """
        if "  " in text:
            return np.frombuffer(self._pieces(text), "<u4")
        first, *rest = text.split(" ")
        known = self.chunks
        out = [self._pieces(first)]
        for x in rest:
            ids = known.get(x)
            if ids is None:
                ids = self._pieces(" " + x)
                if len(x) < 64:
                    if len(known) > MEMO:
                        known.clear()
                    known[x] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids))


_LOADED: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the ids of each text in column `out` (replaced if it is there). Null text counts as empty: no ids."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def ids(col):
        bpe = loaded(path)
        return col.map(lambda x: bpe.encode(x or "").astype(np.int64))

    return docs.withColumn(out, ids(F.col(text)))


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """docs with the bytes of each id list in column `out`; null and empty lists give no bytes."""
    from pyspark.sql import functions as F

    @F.pandas_udf("binary")
    def back(col):
        bpe = loaded(path)
        return col.map(lambda x: b"" if x is None else bpe.decode(list(x)))

    return docs.withColumn(out, back(F.col(ids)))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, number of ids, and the digests of the ids and of what they decode to.

    Null and empty texts have no ids. Rows stay rows, whatever doc_id is; other columns are not read.
    Each worker holds a batch's slice, its longest text and memos of bounded length.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for part in steps(batch, "text"):
                n, ids_digest, back = [], [], []
                for t in texts(part.column(1)):
                    ids = bpe.encode(t).tolist()
                    n.append(len(ids))
                    ids_digest.append(hashlib.sha256(",".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
