"""FLAC, encoded and decoded for all frames of a batch in step.

Every frame is a lane: the encoder lays the bit fields of all frames out at once,
and the decoder reads sample t of every frame in one vector step, so the work in
Python is for each sample position of a block and not for each sample. A seek
point for every frame gives the lanes' first bytes and the blocks' sample offsets;
a stream without seek points is decoded frame by frame.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np

BLOCK = 1152
ORDER, PRECISION = 4, 10
#: Fixed predictors by order, as coefficients of the samples before.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _table(poly: int, bits: int) -> np.ndarray:
    out = []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1) ^ (poly if x >> (bits - 1) else 0)
            x &= (1 << bits) - 1
        out.append(x)
    return np.array(out, np.uint32)


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)
LEADING = np.array([16, *(16 - int(x).bit_length() for x in range(1, 1 << 16))], np.int64)


def crc16(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The checksum of each span of data, all spans in step."""
    order = np.argsort(-sizes, kind="stable")
    at, left, crc = starts[order], sizes[order], np.zeros(len(sizes), np.uint32)
    live = np.searchsorted(-left, -np.arange(int(sizes.max(initial=0))), "left")  # spans longer than t
    for t, n in enumerate(live):
        c = crc[:n]
        crc[:n] = ((c << 8) & 0xFFFF) ^ CRC16[(c >> 8) ^ data[at[:n] + t]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _rice(fold: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The better parameter of two near the mean's, for each frame, and the bits it takes. fold: 0 where nothing is coded."""
    mean = fold.sum(1) / np.maximum(n, 1)
    k0 = np.clip(np.floor(np.log2(np.maximum(mean * 0.6931, 1))).astype(np.int32), 0, 13)
    best = None
    for k in (k0, k0 + 1):
        bits = (fold >> k[:, None]).sum(1) + n * (1 + k)
        best = (k, bits) if best is None else (np.where(bits < best[1], k, best[0]), np.minimum(bits, best[1]))
    return best


def _lpc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (frames x ORDER) and shifts by autocorrelation and Levinson-Durbin."""
    f = x.astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", f[:, j:], f[:, : f.shape[1] - j]) for j in range(ORDER + 1)], 1).astype(np.float64)
    err = np.maximum(r[:, 0], 1e-9) * 1.000001
    a = np.zeros((len(x), ORDER))
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / err
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        err = np.maximum(err * (1 - k * k), 1e-9)
    top = np.maximum(np.abs(a).max(1), 1e-6)
    shift = np.clip(np.floor(np.log2(((1 << (PRECISION - 1)) - 1) / top)), 0, 15).astype(np.int64)
    lim = 1 << (PRECISION - 1)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -lim, lim - 1).astype(np.int32), shift.astype(np.int32)


def _predicted(x: np.ndarray, coefs: np.ndarray, shift: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for j in range(coefs.shape[1]):
        out[:, j + 1 :] += coefs[:, j : j + 1] * x[:, : x.shape[1] - j - 1]
    return out >> shift[:, None]


def _frames(x: np.ndarray, n: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all frames one after another, and each frame's size. x: frames x BLOCK samples, 0 after each frame's n."""
    f, width = x.shape
    t = np.arange(width)
    inside = t < n[:, None]
    coefs = np.zeros((f, ORDER), np.int32)
    shift, order, kind, k = (np.zeros(f, np.int32) for _ in range(4))
    short = np.flatnonzero(n < width)
    folded = x
    # kind: 0 constant, 1 verbatim, 2 fixed, 3 linear prediction
    kind[:] = 1
    cost = 8 * n
    lpc, lpc_shift = _lpc(x)
    for o, c, s, what in ((0, coefs[:1], shift[:1], 2), (1, np.array([[1]], np.int32), shift[:1], 2), (ORDER, lpc, lpc_shift, 3)):
        res = x - _predicted(x, c, s) if o else x
        fold = (res << 1) ^ (res >> 31)
        if o:
            fold[:, :o] = 0
            fold[short] *= inside[short]
        kk, bits = _rice(fold, np.maximum(n - o, 0))
        bits += 8 * o + 10 + (9 + PRECISION * ORDER if what == 3 else 0)
        better = (bits < cost) & (n > o)
        kind[better], order[better], k[better] = what, o, kk[better]
        shift[better], coefs[better], cost[better] = 0, 0, bits[better]
        if what == 3:
            shift[better], coefs[better] = s[better], c[better]
        folded = fold if better.all() else np.where(better[:, None], fold, folded)
    same = (x == x[:, :1]).sum(1) == n
    same |= ((x == x[:, :1]) | ~inside).all(1)
    kind[same], order[same] = 0, 0
    predicted = kind >= 2
    head = 10 + 2  # bytes up to the frame number and block size
    v = np.zeros((f, head + 2 + ORDER + 2 + ORDER + 1 + width + 2), np.int32)
    w = np.zeros_like(v)
    plain = n == BLOCK
    v[:, 0], v[:, 1], v[:, 2], v[:, 3] = 0xFF, 0xF8, np.where(plain, 3, 7) << 4 | 4, 1 << 1
    w[:, :4] = 8
    more = np.searchsorted([1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26, 1 << 31], number, "right")  # bytes after the first
    first = np.where(more == 0, number, ((0xFF80 >> more) & 0xFF) | number >> (6 * more))
    v[:, 4], w[:, 4] = first, 8
    for j in range(1, 6):
        v[:, 4 + j] = np.where(j <= more, 0x80 | (number >> np.maximum(6 * (more - j), 0)) & 0x3F, 0)
        w[:, 4 + j] = np.where(j <= more, 8, 0)
    for j, s in ((10, 8), (11, 0)):
        v[:, j], w[:, j] = np.where(plain, 0, (n - 1) >> s & 0xFF), np.where(plain, 0, 8)
    crc = np.zeros(f, np.uint32)
    for j in range(head):
        crc = np.where(w[:, j] > 0, CRC8[(crc ^ v[:, j].astype(np.uint32)) & 0xFF], crc)
    v[:, head], w[:, head] = crc, 8
    v[:, head + 1] = np.choose(kind, [0, 1, 8 | order, 32 | np.maximum(order - 1, 0)]) << 1
    w[:, head + 1] = 8
    c = head + 2
    warm = t[:ORDER] < order[:, None]
    v[:, c : c + ORDER], w[:, c : c + ORDER] = np.where(warm, x[:, :ORDER] & 0xFF, 0), np.where(warm, 8, 0)
    c += ORDER
    linear = kind == 3
    v[:, c], w[:, c] = np.where(linear, PRECISION - 1, 0), np.where(linear, 4, 0)
    v[:, c + 1], w[:, c + 1] = np.where(linear, shift, 0), np.where(linear, 5, 0)
    v[:, c + 2 : c + 2 + ORDER] = np.where(linear[:, None], coefs & ((1 << PRECISION) - 1), 0)
    w[:, c + 2 : c + 2 + ORDER] = np.where(linear, PRECISION, 0)[:, None]
    c += 2 + ORDER
    v[:, c], w[:, c] = np.where(predicted, k, 0), np.where(predicted, 10, 0)  # method 0, partition order 0, parameter
    c += 1
    kc = k[:, None]
    v[:, c : c + width] = (folded & ((1 << kc) - 1)) | (1 << kc)
    w[:, c : c + width] = (folded >> kc) + (kc + 1)
    for o in (1, ORDER):
        some = order == o
        v[some, c : c + o] = w[some, c : c + o] = 0
    other = np.flatnonzero(~predicted)
    v[other, c : c + width], w[other, c : c + width] = x[other] & 0xFF, 8
    v[short, c : c + width] *= inside[short]
    w[short, c : c + width] *= inside[short]
    flat = np.flatnonzero(kind == 0)
    v[flat, c + 1 : c + width] = w[flat, c + 1 : c + width] = 0
    c += width
    w[:, c] = -w.sum(1) % 8
    w[:, c + 1] = 16
    sizes = w.sum(1) // 8
    data = _bits(v.ravel(), w.ravel())
    starts = np.cumsum(sizes) - sizes
    crc = crc16(data, starts, sizes - 2)
    data[starts + sizes - 2], data[starts + sizes - 1] = crc >> 8, crc & 0xFF
    return data, sizes


def _bits(value: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Fields one after another, the high bit first; a field's value has at most 32 bits, its width may be more."""
    end = np.cumsum(width, dtype=np.int64)
    used = np.flatnonzero(value)
    v, last = value[used].astype(np.uint64), end[used] - 1
    words = np.zeros(int(end[-1] // 64) + 2, np.uint64)
    if len(v):
        word, up = last >> 6, (63 - (last & 63)).astype(np.uint64)
        low = v << up
        high = np.where(up > 0, v >> (np.uint64(64) - np.maximum(up, np.uint64(1))), np.uint64(0))
        at = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[at] + 1] |= np.add.reduceat(low, at)
        words[word[at]] |= np.add.reduceat(high, at)
    return words[1:].byteswap().view(np.uint8)[: int(end[-1]) // 8].copy()


def encode(payloads: list[bytes], rate: int = 8000) -> list[bytes]:
    """Each payload (one byte at least) as a mono FLAC stream of 8-bit samples, byte - 128."""
    if not payloads:
        return []
    sizes = np.array([len(p) for p in payloads])
    blocks = -(-sizes // BLOCK)
    n = np.full(int(blocks.sum()), BLOCK)
    ends = np.cumsum(blocks)
    n[ends - 1] = sizes - (blocks - 1) * BLOCK
    number = np.arange(len(n)) - np.repeat(ends - blocks, blocks)
    whole = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128
    x = np.zeros((len(n), BLOCK), np.int32)
    x[np.arange(BLOCK) < n[:, None]] = whole
    data, size = _frames(x, n, number)
    at = np.cumsum(size) - size
    body = data.tobytes()
    out = []
    for i, p in enumerate(payloads):
        lo, hi = int(ends[i] - blocks[i]), int(ends[i])
        base, stop = int(at[lo]), int(at[hi - 1] + size[hi - 1])
        signed = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(size[lo:hi].min()).to_bytes(3, "big") + int(size[lo:hi].max()).to_bytes(3, "big")
        info += (rate << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        points = np.zeros(hi - lo, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        points["sample"], points["offset"], points["n"] = number[lo:hi] * BLOCK, at[lo:hi] - base, n[lo:hi]
        seek = points.tobytes()
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + body[base:stop])
    return out


@dataclass
class Stream:
    rate: int
    bits: int
    samples: int
    md5: bytes
    first: int
    #: Sample number, byte offset from the first frame, samples.
    points: list[tuple[int, int, int]]


def parse(data: bytes) -> Stream:
    """The stream's metadata; raises ValueError where it isn't FLAC or isn't mono with 8 bits."""
    if data[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, info, points, last = 4, None, [], False
    while not last:
        if at + 4 > len(data):
            raise ValueError("metadata ends early")
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        block = data[at + 4 : at + 4 + size]
        if kind == 0:
            info = block
        elif kind == 3:
            points = [p for j in range(0, size - 17, 18) if (p := struct.unpack(">QQH", block[j : j + 18]))[0] != (1 << 64) - 1]
        at += 4 + size
    if info is None or len(info) < 34:
        raise ValueError("no STREAMINFO")
    packed = int.from_bytes(info[10:18], "big")
    if packed >> 41 & 7 or (packed >> 36 & 31) != 7:
        raise ValueError("only mono streams of 8 bits a sample are read")
    return Stream(packed >> 44, 8, packed & ((1 << 36) - 1), info[18:34], at, points)


def _header(data: bytes, at: int) -> tuple[int, int]:
    """Where the subframe begins and the block's samples; checks sync code and CRC-8."""
    if data[at : at + 2] != b"\xff\xf8":
        raise ValueError("no frame here")
    code, p = data[at + 2] >> 4, at + 5
    lead = data[at + 4]
    while lead & 0xC0 == 0xC0:
        lead = lead << 1 & 0xFF
        p += 1
    n = 192 if code == 1 else 576 << (code - 2) if 2 <= code <= 5 else 256 << (code - 8) if code >= 8 else 0
    if code == 6:
        n, p = data[p] + 1, p + 1
    elif code == 7:
        n, p = (data[p] << 8 | data[p + 1]) + 1, p + 2
    rate = data[at + 2] & 15
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    crc = 0
    for b in data[at:p]:
        crc = int(CRC8[crc ^ b])
    if not n or crc != data[p]:
        raise ValueError("a frame header's checksum is wrong")
    return p + 1, n


class _Bits:
    """Reads of all lanes at their own places."""

    def __init__(self, data: np.ndarray) -> None:
        padded = np.concatenate((data, np.zeros(16, np.uint8))).astype(np.uint64)
        self.words = np.zeros(len(data) + 8, np.uint64)
        for j in range(8):
            self.words |= padded[j : j + len(self.words)] << np.uint64(56 - 8 * j)

    def peek(self, at: np.ndarray) -> np.ndarray:
        """From each place 57 bits or more, at the top of the word."""
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def read(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        width = np.broadcast_to(np.asarray(width, np.uint64), at.shape)
        return np.where(width > 0, self.peek(at) >> (np.uint64(64) - np.maximum(width, np.uint64(1))), np.uint64(0)).astype(np.int64)


def _signed(v: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    width = np.asarray(width, np.int64)
    return np.where(width > 0, v - ((v >> np.maximum(width - 1, 0) & 1) << width), 0)


def frames(data: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (lanes x longest block) of the subframes that begin at these bytes, and the bit after each."""
    order_of = np.argsort(-n, kind="stable")
    n = n[order_of]
    bits, at = _Bits(data), starts[order_of] * 8
    lanes, width = len(n), int(n.max(initial=0))
    out = np.zeros((lanes, width), np.int64)
    if not lanes:
        return out, at
    head = bits.read(at, 8)
    at = at + 8
    if (head & 0x81).any():
        raise ValueError("a subframe's header is wrong")
    kind = head >> 1
    constant, verbatim, fixed, linear = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | linear).all():
        raise ValueError("a reserved kind of subframe")
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    most = int(order.max())
    for t in range(most):
        some = order > t
        out[some, t] = _signed(bits.read(at[some], 8), 8)
        at[some] += 8
    coefs, shift = np.zeros((lanes, max(most, 4)), np.int64), np.zeros(lanes, np.int64)
    for o in range(1, 5):
        coefs[fixed & (order == o), :o] = FIXED[o]
    if linear.any():
        precision = np.where(linear, bits.read(at, 4) + 1, 0)
        at = at + 4 * linear
        shift = np.where(linear, _signed(bits.read(at, 5), 5), 0)
        at = at + 5 * linear
        if (shift < 0).any():
            raise ValueError("a negative shift")
        for t in range(most):
            some = linear & (order > t)
            coefs[some, t] = _signed(bits.read(at[some], precision[some]), precision[some])
            at[some] += precision[some]
    coded = fixed | linear
    method, parts = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    if coded.any():
        method = np.where(coded, bits.read(at, 2), 0)
        at = at + 2 * coded
        parts = np.where(coded, bits.read(at, 4), 0)
        at = at + 4 * coded
        if (method > 1).any():
            raise ValueError("a reserved residual method")
    if constant.any():
        out[constant] = np.where(np.arange(width) < n[constant, None], _signed(bits.read(at[constant], 8), 8)[:, None], 0)
        at = at + 8 * constant
    span = n >> parts  # samples of a partition
    next_part = np.where(coded, order, width + 1)
    k, raw = np.zeros(lanes, np.int64), np.zeros(lanes, bool)
    live = np.searchsorted(-n, -np.arange(width), "left")
    reversed_coefs = coefs[:, :most][:, ::-1]
    any_raw = False
    sixteen = np.uint64(48)
    rice_all = (coded & (n > 0)).all()
    for t in range(width):
        m = int(live[t])
        p = at[:m]
        fresh = np.flatnonzero(next_part[:m] == t) if t <= most or (parts[:m] > 0).any() else ()
        if len(fresh):
            bit = 4 + method[fresh]
            k[fresh] = bits.read(p[fresh], bit)
            p[fresh] += bit
            raw[fresh] = k[fresh] == (1 << bit) - 1
            if raw[fresh].any():
                any_raw = True
                some = fresh[raw[fresh]]
                k[some] = bits.read(p[some], 5)
                p[some] += 5
            next_part[fresh] = (t // span[fresh] + 1) * span[fresh]
        lane = coded[:m] & (order[:m] <= t)
        whole = rice_all and not any_raw and t >= most
        q = LEADING[(bits.peek(p) >> sixteen).astype(np.int64)]
        if (q == 16).any():
            need = (q == 16) & lane & ~raw[:m]
            while need.any():
                some = np.flatnonzero(need)
                if (p[some] + q[some] > 8 * len(data)).any():
                    raise ValueError("a residual has no end")
                extra = LEADING[(bits.peek(p[some] + q[some]) >> sixteen).astype(np.int64)]
                q[some] += extra
                need[some] = extra == 16
        kt = k[:m]
        p1 = p + q + 1
        folded = q << kt | bits.read(p1, kt)
        res = folded >> 1 ^ -(folded & 1)
        step = q + 1 + kt
        if not whole:
            if any_raw:
                rr = lane & raw[:m]
                res = np.where(rr, _signed(bits.read(p, kt), kt), res)
                step = np.where(rr, kt, step)
            v = verbatim[:m]
            res = np.where(lane, res, np.where(v, _signed(bits.read(p, 8), 8), out[:m, t]))
            step = np.where(lane, step, np.where(v, 8, 0))
        p += step
        if most:
            lo = max(0, t - most)
            past = out[:m, lo:t]
            guess = (past * reversed_coefs[:m, most - (t - lo) :]).sum(1) >> shift[:m] if t > lo else 0
            res = res + (guess if whole else np.where(lane, guess, 0))
        out[:m, t] = res
    end = np.empty_like(at)
    end[order_of] = at
    back = np.empty_like(out)
    back[order_of] = out
    return back, end


@dataclass
class Block:
    """A decoded block: where it begins among the stream's samples, and its PCM bytes (unsigned)."""

    offset: int
    pcm: bytes


def decode(streams: list[bytes]) -> list[list[Block]]:
    """The PCM blocks of each stream; raises ValueError where a header's or frame's checksum, or the MD5 of all samples, is wrong."""
    infos = [parse(s) for s in streams]
    data = np.frombuffer(b"".join(streams), np.uint8)
    base = np.cumsum([0, *map(len, streams)])
    begin, at, n, owner, stop = [], [], [], [], []
    for i, (s, info) in enumerate(zip(streams, infos, strict=True)):
        if not info.points:
            continue
        offsets = [info.first + p[1] for p in info.points]
        for p, a, b in zip(info.points, offsets, [*offsets[1:], len(s)], strict=True):
            sub, size = _header(s, a)
            if size != p[2]:
                raise ValueError("a seek point is wrong")
            begin.append(base[i] + a), at.append(base[i] + sub), n.append(size), owner.append((i, p[0])), stop.append(base[i] + b)
    out: list[list[Block]] = [[] for _ in streams]
    begin, at, n, stop = (np.array(x, np.int64) for x in (begin, at, n, stop))
    if len(n):
        crc = crc16(data, begin, stop - begin - 2)
        if (crc != (data[stop - 2].astype(np.uint32) << 8 | data[stop - 1])).any():
            raise ValueError("a frame's checksum is wrong")
        samples, end = frames(data, at, n)
        if ((end + 7) // 8 != stop - 2).any():
            raise ValueError("a frame ends elsewhere")
        pcm = ((samples + 128) & 0xFF).astype(np.uint8)
        for j, (i, offset) in enumerate(owner):
            out[i].append(Block(offset, pcm[j, : n[j]].tobytes()))
    for i, (s, info) in enumerate(zip(streams, infos, strict=True)):
        if not info.points:
            out[i] = _one_by_one(s, info)
        whole = b"".join(b.pcm for b in out[i])
        if len(whole) != info.samples or hashlib.md5((np.frombuffer(whole, np.uint8) ^ 0x80).tobytes()).digest() != info.md5:
            raise ValueError("the samples' MD5 is wrong")
    return out


def _one_by_one(s: bytes, info: Stream) -> list[Block]:
    data, at, done, out = np.frombuffer(s, np.uint8), info.first, 0, []
    while done < info.samples:
        sub, n = _header(s, at)
        samples, end = frames(data, np.array([sub]), np.array([n]))
        stop = int(end[0] + 7) // 8
        if int(crc16(data, np.array([at]), np.array([stop - at]))[0]) != int.from_bytes(s[stop : stop + 2], "big"):
            raise ValueError("a frame's checksum is wrong")
        out.append(Block(done, ((samples[0] + 128) & 0xFF).astype(np.uint8).tobytes()))
        at, done = stop + 2, done + n
    return out


def seek(data: bytes, sample: int) -> Block:
    """The block that holds a sample, without decoding the others."""
    info = parse(data)
    if not 0 <= sample < info.samples or not info.points:
        raise ValueError("no such sample, or no seek points")
    j = int(np.searchsorted([p[0] for p in info.points], sample, "right")) - 1
    a = info.first + info.points[j][1]
    b = info.first + info.points[j + 1][1] if j + 1 < len(info.points) else len(data)
    sub, n = _header(data, a)
    arr = np.frombuffer(data, np.uint8)
    if int(crc16(arr, np.array([a]), np.array([b - a - 2]))[0]) != int.from_bytes(data[b - 2 : b], "big"):
        raise ValueError("a frame's checksum is wrong")
    samples, _ = frames(arr, np.array([sub]), np.array([n]))
    return Block(info.points[j][0], ((samples[0] + 128) & 0xFF).astype(np.uint8).tobytes())
