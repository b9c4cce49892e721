"""Vectorised words and word n-grams of many texts at once, as 64-bit hashes.

A word's bytes go through two 64-bit states in steps of 8, each state fully mixed after each
step, so no hash is a sum over bytes that some pattern of letters could cancel; long words
are hashed by BLAKE2. An n-gram's hash joins those of its halves and fourths, each join mixed again.
"""

from __future__ import annotations

import hashlib

import numpy as np

from prismtab.llm.common import SPACES

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word up to which it is hashed in steps.
STEPPED = 64
#: The lowest n bytes.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3 over uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def spans(body: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in body, and its row; no word reaches over a row's end. space: which bytes stand between words."""
    n = len(body)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~space[body]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def chunks(body: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 8 bytes of each word and the next 8, as little-endian numbers, bytes past its end being 0."""
    padded = np.concatenate((body, np.zeros(16, np.uint8)))
    eight = np.ndarray((len(body) + 9,), "<u8", padded, strides=(1,))
    first = eight[starts] & _KEEP[np.minimum(lengths, 8)]
    return first, eight[np.minimum(starts + 8, len(body))] & _KEEP[np.clip(lengths - 8, 0, 8)]


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    eight = np.ndarray((len(body) + 9,), "<u8", np.concatenate((body, np.zeros(16, np.uint8))), strides=(1,))
    a = lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    b = a ^ np.uint64(0x5851F42D4C957F2D)
    some = slice(None)
    for at in range(0, STEPPED, 8):
        if at:
            some = np.flatnonzero((lengths > at) & (lengths <= STEPPED))
            if not len(some):
                break
        chunk = eight[np.minimum(starts[some] + at, len(body))] & _KEEP[np.clip(lengths[some] - at, 0, 8)]
        with np.errstate(over="ignore"):
            a[some] = mix(a[some] ^ chunk)
            b[some] = mix((b[some] + chunk) * np.uint64(0xD6E8FEB86659FD93))
    with np.errstate(over="ignore"):
        out = mix(a + turned(b))
    for k in np.flatnonzero(lengths > STEPPED).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(body[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


def turned(x: np.ndarray) -> np.ndarray:
    return x << np.uint64(29) | x >> np.uint64(35)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0xD6E8FEB86659FD93) + turned(b))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive words, row ends not heeded: max(0, len(words) - n + 1) of them."""
    size = len(words) - n + 1
    if size < 1:
        return np.zeros(0, np.uint64)
    out, at, half, step = None, 0, words, 1
    while True:
        if n & step:
            part = half[at : at + size]
            out = part if out is None else _joined(out, part)
            at += step
        if 2 * step > n:
            return mix(out ^ np.uint64(n))
        half, step = _joined(half[: len(half) - step], half[step:]), 2 * step
