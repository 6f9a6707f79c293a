"""FLAC coding of 8-bit mono samples, vectorised over all frames of a batch.

A stream is ``fLaC``, STREAMINFO (with the MD5 of the samples), a SEEKTABLE with one point per
frame and fixed-size frames. The writer chooses per frame between CONSTANT, VERBATIM, fixed
predictors of order 0 to 2 and one quantised linear predictor of order 2, with one Rice partition.
The reader decodes CONSTANT, VERBATIM, FIXED and LPC subframes, Rice partitions of any order and
escaped partitions, and checks header CRC-8, frame CRC-16 and the MD5. Frames are independent, so
sample j of all frames is decoded in one numpy step.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np

# Fixed values of the format: magic, sync code, CRC polynomials, coefficients of fixed predictors.
MAGIC, SYNC = b"fLaC", 0xFFF8
POLY8, POLY16 = 0x07, 0x8005
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))

RATE, BITS = 8000, 8
#: Quantised linear predictor tried besides the fixed ones: (coefficients, shift), of long-run use for text bytes.
LPC = ((6, 3), 4)


def _crc_table(poly: int, width: int) -> np.ndarray:
    top, mask = 1 << (width - 1), (1 << width) - 1
    table = np.zeros(256, np.uint16)
    for byte in range(256):
        reg = byte << (width - 8)
        for _ in range(8):
            reg = ((reg << 1) ^ poly if reg & top else reg << 1) & mask
        table[byte] = reg
    return table


_T8, _T16 = _crc_table(POLY8, 8), _crc_table(POLY16, 16)


def crc8(data: bytes) -> int:
    reg = 0
    for byte in data:
        reg = int(_T8[reg ^ byte])
    return reg


def crc16_all(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges at once, byte j of every range in step j."""
    order = np.argsort(-size, kind="stable")
    at, left = start[order], size[order]
    reg = np.zeros(len(order), np.uint16)
    live = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), "left")
    for j, n in enumerate(live):
        r = reg[:n]
        reg[:n] = (r << np.uint16(8)) ^ _T16[(r >> np.uint16(8)).astype(np.uint8) ^ data[at[:n] + j]]
    out = np.empty_like(reg)
    out[order] = reg
    return out


def _utf8_number(n: int) -> bytes:
    """The frame number in the format's extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x20
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        if n < limit:
            break
        limit >>= 1
    return bytes([(0xFF << (7 - len(tail))) & 0xFF | n, *reversed(tail)])


@functools.lru_cache(1 << 16)
def _header(number: int, block: int) -> bytes:
    """Frame header: fixed block size, rate and sample size from STREAMINFO's values, mono, CRC-8."""
    if block == 576:
        code, extra = 2, b""
    elif block <= 256:
        code, extra = 6, bytes([block - 1])
    else:
        code, extra = 7, (block - 1).to_bytes(2, "big")
    head = SYNC.to_bytes(2, "big") + bytes([code << 4 | 4, 0 << 4 | 1 << 1]) + _utf8_number(number) + extra
    return head + bytes([crc8(head)])


def _residuals(x: np.ndarray, coefficients: tuple[int, ...], shift: int = 0) -> np.ndarray:
    """Prediction errors of frames of equal size; the first samples stay 0 (they are warm-up)."""
    order, out = len(coefficients), np.zeros_like(x)
    guess = np.zeros_like(x[:, order:])
    for i, c in enumerate(coefficients):
        guess += x.dtype.type(c) * x[:, order - 1 - i:x.shape[1] - 1 - i]
    out[:, order:] = x[:, order:] - (guess >> shift)
    return out


def _folded(x: np.ndarray, coefficients: tuple[int, ...], shift: int = 0) -> np.ndarray:
    """Residuals as unsigned numbers: 0, -1, 1, -2, ... become 0, 1, 2, 3, ..."""
    r = _residuals(x, coefficients, shift)
    return (r << 1) ^ (r >> 15)


def _rice_parameter(u: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """A parameter near log2 of the mean folded residual, the better of two, and its coded bits."""
    body = u[:, order:]
    mean = body.sum(1, dtype=np.int64) / body.shape[1]
    low = np.clip(np.floor(np.log2(np.maximum(mean, 1))), 0, 13).astype(np.int16)
    bits = [(body >> k[:, None]).sum(1, dtype=np.int64) + body.shape[1] * (1 + k.astype(np.int64)) for k in (low, low + 1)]
    return np.where(bits[1] < bits[0], low + 1, low).astype(np.int64), np.minimum(*bits)


class _Bits:
    """Bits of all frames: one byte per bit while writing."""

    def __init__(self, total: int) -> None:
        self.raw = np.zeros(total, np.uint8)

    def put(self, at: np.ndarray, value: np.ndarray, width: int) -> None:
        for b in range(width):
            self.raw[at + (width - 1 - b)] = (value >> b) & 1


def _frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Subframes of equal-sized frames as bits: (bits of all frames, bit sizes, headers)."""
    n, block = samples.shape
    x = samples.astype(np.int16)
    plans = [(c, 0, o) for o, c in enumerate(FIXED[:3])] + [(LPC[0], LPC[1], -1)]
    plans = [p for p in plans if len(p[0]) < block]
    size = np.stack([np.abs(_residuals(x, c, s)).sum(1, dtype=np.int64) for c, s, _ in plans])
    choice = size.argmin(0)
    best_bits, best_kind, best_k = np.full(n, block * BITS + 8), np.full(n, -2), np.zeros(n, int)
    folded = {}
    for p, (coefficients, shift, kind) in enumerate(plans):
        i = np.flatnonzero(choice == p)
        if not len(i):
            continue
        order = len(coefficients)
        u = _folded(x[i], coefficients, shift)
        k, bits = _rice_parameter(u, order)
        bits = bits + 8 + order * BITS + 6 + 4 + (4 + 5 + 6 * order if kind == -1 else 0)
        better = bits < best_bits[i]
        i = i[better]
        best_bits[i], best_kind[i], best_k[i] = bits[better], kind, k[better]
        folded[kind] = u[better]
    constant = (x == x[:, :1]).all(1)
    for kind, u in folded.items():
        folded[kind] = u[~constant[best_kind == kind]]
    best_kind[constant], best_bits[constant] = -3, 8 + BITS
    head = [_header(int(i), block) for i in numbers]
    head_bits = np.array([8 * len(h) for h in head])
    sizes = (head_bits + best_bits + 7) // 8 * 8 + 16
    start = np.concatenate([[0], np.cumsum(sizes)])
    out = _Bits(int(start[-1]))
    at = start[:-1] + head_bits
    flat = np.unpackbits(np.frombuffer(b"".join(head), np.uint8))
    into = np.repeat(start[:-1], head_bits) + np.arange(len(flat)) - np.repeat(np.cumsum(head_bits) - head_bits, head_bits)
    out.raw[into] = flat

    def rows(kind: int) -> np.ndarray:
        return np.flatnonzero(best_kind == kind)

    if len(i := rows(-3)):
        out.put(at[i], np.zeros(len(i), int), 8)
        out.put(at[i] + 8, x[i, 0], BITS)
    if len(i := rows(-2)):
        out.put(at[i], np.full(len(i), 2), 8)
        out.put(at[i][:, None] + 8 + BITS * np.arange(block), x[i], BITS)
    for coefficients, shift, kind in plans:
        if not len(i := rows(kind)):
            continue
        order = len(coefficients)
        code = (32 + order - 1 if kind == -1 else 8 + order) << 1
        out.put(at[i], np.full(len(i), code), 8)
        p = at[i] + 8
        if order:
            out.put(p[:, None] + BITS * np.arange(order), x[i, :order], BITS)
        p = p + BITS * order
        if kind == -1:
            out.put(p, np.full(len(i), 6 - 1), 4)
            out.put(p + 4, np.full(len(i), shift), 5)
            for j, c in enumerate(coefficients):
                out.put(p + 9 + 6 * j, np.full(len(i), c), 6)
            p = p + 9 + 6 * order
        out.put(p, np.zeros(len(i), int), 6)  # Rice coding, one partition
        out.put(p + 6, best_k[i], 4)
        p = p + 10
        for k in np.unique(best_k[i]):
            j = best_k[i] == k
            u, k = folded[kind][j][:, order:], int(k)
            stop = np.cumsum((u >> k) + (1 + k), 1, dtype=np.int32) + (p[j][:, None] - 1 - k).astype(np.int32)
            out.raw[stop] = 1
            for b in range(k):
                out.raw[stop + np.int32(k - b)] = (u >> b) & 1
    return out.raw, sizes // 8, head


def encode(payloads: list[np.ndarray], block: int) -> list[bytes]:
    """One stream per payload of signed 8-bit samples; every payload is a whole number of blocks."""
    counts = np.array([len(p) // block for p in payloads])
    if any(len(p) % block or not len(p) for p in payloads):
        raise ValueError("payloads must be positive multiples of the block size")
    numbers = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    bits, sizes, _ = _frames(np.concatenate(payloads).reshape(-1, block), numbers)
    body = np.packbits(bits)
    start = np.cumsum(sizes) - sizes
    crc = crc16_all(body, start, sizes - 2)
    body[start + sizes - 2], body[start + sizes - 1] = crc >> 8, crc & 255
    out, first = [], 0
    for payload, n in zip(payloads, counts):
        s = sizes[first:first + n]
        lo, hi = int(start[first]), int(start[first] + s.sum())
        points = np.zeros(n, [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
        points["sample"], points["offset"], points["size"] = np.arange(n) * block, start[first:first + n] - lo, block
        info = (block.to_bytes(2, "big") * 2 + int(s.min()).to_bytes(3, "big") + int(s.max()).to_bytes(3, "big")
                + (RATE << 44 | 0 << 41 | (BITS - 1) << 36 | len(payload)).to_bytes(8, "big")
                + hashlib.md5(payload.tobytes()).digest())
        seek = points.tobytes()
        out.append(MAGIC + b"\x00" + len(info).to_bytes(3, "big") + info
                   + b"\x83" + len(seek).to_bytes(3, "big") + seek + body[lo:hi].tobytes())
        first += n
    return out


class Damaged(ValueError):
    """A stream whose structure or checksum does not hold."""


def _layout(stream: bytes) -> tuple[int, int, bytes, np.ndarray, np.ndarray]:
    """(samples, block size, MD5, frame offsets, first samples) from the metadata blocks."""
    if stream[:4] != MAGIC:
        raise Damaged("no FLAC stream")
    at, info, seek, last = 4, None, None, False
    while not last:
        last, kind, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1:at + 4], "big")
        body = stream[at + 4:at + 4 + size]
        if kind == 0:
            info = body
        elif kind == 3:
            seek = np.frombuffer(body, [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
        at += 4 + size
    if info is None:
        raise Damaged("no STREAMINFO")
    block, packed = int.from_bytes(info[:2], "big"), int.from_bytes(info[10:18], "big")
    if packed >> 41 & 7 or (packed >> 36 & 31) + 1 != BITS:
        raise Damaged("only 8-bit mono streams are read")
    total = packed & (1 << 36) - 1
    if seek is not None and len(seek) * block >= total > (len(seek) - 1) * block:
        return total, block, info[18:34], seek["offset"].astype(np.int64) + at, seek["sample"].astype(np.int64)
    found, number = [], 0  # without a full seek table: the next sync code with the right header
    place = at
    for number in range(-(-total // block)):
        head = _header(number, min(block, total - number * block))
        place = stream.find(head, place)
        if place < 0:
            raise Damaged(f"frame {number} not found")
        found.append(place)
        place += len(head)
    return total, block, info[18:34], np.array(found, np.int64), np.arange(len(found)) * block


def shape(stream: bytes) -> tuple[int, int]:
    """(samples, samples of a block) of a stream."""
    return _layout(stream)[:2]


class _Reader:
    """A bit position per frame over one shared buffer."""

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        self.data = np.concatenate([data, np.zeros(16, np.uint8)])
        self.words = np.ndarray((len(data) + 8,), ">u8", self.data, strides=(1,))
        self.at = at.astype(np.int64) * 8

    def peek(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits from each bit position, at the top of a 64-bit word."""
        return self.words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def take(self, i: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Unsigned numbers of at most 56 bits."""
        at = self.at[i]
        width = np.broadcast_to(np.asarray(width), at.shape).astype(np.int64)
        self.at[i] = at + width
        return np.where(width > 0, self.peek(at) >> np.minimum(64 - width, 63).astype(np.uint64), 0).astype(np.int64)

    def rice(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rice codes at bit positions: (residuals, positions after them)."""
        word = self.peek(at)
        zeros = 31 - ((word >> np.uint64(32)).astype(np.float64).view(np.int64) >> 52) + 1023
        odd = (zeros + k > 55) | (zeros > 31)
        if odd.any():
            for n in np.flatnonzero(odd):  # long runs of zeros, byte by byte
                place = int(at[n])
                while not self.data[place >> 3] >> (7 - (place & 7)) & 1:
                    place += 1 if place & 7 or self.data[place >> 3] else 8
                zeros[n] = place - at[n]
            stop = at + zeros + 1
            low = np.where(k > 0, self.peek(stop) >> np.minimum(64 - k, 63).astype(np.uint64), 0).astype(np.int64)
        else:
            low = (word << (zeros + 1).astype(np.uint64) >> np.uint64(1) >> (63 - k).astype(np.uint64)).astype(np.int64)
        u = zeros << k | low
        return u >> 1 ^ -(u & 1), at + zeros + 1 + k


def _signed(v: np.ndarray, width: int) -> np.ndarray:
    return v - ((v >> (width - 1)) << width)


def decode(streams: list[bytes], blocks: list[tuple[int, int]] | None = None) -> list[np.ndarray]:
    """Samples of every stream, all frames of all streams in lockstep.

    ``blocks`` asks for (first frame, frames) of each stream, found by their seek offsets; without
    it whole streams are read and their MD5 is checked. CRCs are checked either way.
    """
    data = np.frombuffer(b"".join(streams), np.uint8)
    base = np.cumsum([0, *map(len, streams)])
    starts, ends, numbers, lengths, counts, sums = [], [], [], [], [], []
    for n, stream in enumerate(streams):
        total, block, md5, offsets, first = _layout(stream)
        lo, k = blocks[n] if blocks else (0, len(offsets))
        end = np.append(offsets[1:], len(stream))
        starts.append(base[n] + offsets[lo:lo + k])
        ends.append(base[n] + end[lo:lo + k])
        numbers.append(first[lo:lo + k] // block)
        lengths.append(np.minimum(block, total - first[lo:lo + k]))
        counts.append(len(offsets[lo:lo + k]))
        sums.append(md5)
    start, end = np.concatenate(starts), np.concatenate(ends)
    number, length = np.concatenate(numbers), np.concatenate(lengths)
    crc = crc16_all(data, start, end - start - 2)
    stored = data[end - 2].astype(np.uint16) << np.uint16(8) | data[end - 1]
    if (crc != stored).any():
        raise Damaged("frame CRC-16 differs")
    heads = [_header(int(i), int(n)) for i, n in zip(number, length)]
    for s, h in zip(start, heads):
        if data[s:s + len(h)].tobytes() != h:
            raise Damaged("frame header or its CRC-8 differs")
    r = _Reader(data, start + np.array([len(h) for h in heads]))
    every = np.arange(len(start))
    size = int(length.max()) if len(length) else 0
    x = np.zeros((len(start), size), np.int32)
    kind = r.take(every, 8)
    if (kind & 0x81).any():
        raise Damaged("padding or wasted bits in a subframe header")
    kind >>= 1
    if len(i := every[kind == 0]):
        x[i] = _signed(r.take(i, BITS), BITS)[:, None]
    for j in range(size):
        if len(i := every[(kind == 1) & (length > j)]):
            x[i, j] = _signed(r.take(i, BITS), BITS)
        else:
            break
    predicted = every[kind >= 8]
    order = np.where(kind >= 32, kind - 31, kind - 8)
    for j in range(int(order[predicted].max()) if len(predicted) else 0):
        i = predicted[order[predicted] > j]
        x[i, j] = _signed(r.take(i, BITS), BITS)
    weights, shift = np.zeros((len(start), 33), np.int64), np.zeros(len(start), np.int64)
    for o in range(1, len(FIXED)):
        weights[kind == 8 + o, :o] = FIXED[o]
    if len(i := every[kind >= 32]):
        precision = r.take(i, 4) + 1
        shift[i] = r.take(i, 5)
        for j in range(int(order[i].max())):
            m = order[i] > j
            v = r.take(i[m], precision[m])
            weights[i[m], j] = v - ((v >> (precision[m] - 1)) << precision[m])
    if len(predicted):
        if (order[predicted] >= length[predicted]).any():
            raise Damaged("a predictor longer than its frame")
        _residual_samples(r, x, predicted, order, weights, shift, length)
    out, first = [], 0
    for n, k in enumerate(counts):
        rows = x[first:first + k]
        samples = rows.reshape(-1)[:int(length[first:first + k].sum())].astype(np.int8)
        if not blocks and hashlib.md5(samples.tobytes()).digest() != sums[n]:
            raise Damaged("MD5 of the samples differs")
        out.append(samples)
        first += k
    return out


def _residual_samples(r: _Reader, x: np.ndarray, i: np.ndarray, order: np.ndarray, weights: np.ndarray,
                      shift: np.ndarray, length: np.ndarray) -> None:
    """Add Rice residuals to predictions, sample by sample over all frames ``i``."""
    wide = np.where(r.take(i, 2) == 1, 5, 4)
    parts = np.left_shift(1, r.take(i, 4))
    order, length, shift = order[i], length[i], shift[i]
    w = np.ascontiguousarray(weights[i, :int(order.max())].T)
    k, raw = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    step = length // parts
    rows = np.ascontiguousarray(x[i].T).astype(np.int64)
    at, size = r.at[i], x.shape[1]
    bounds = np.unique(np.concatenate([np.arange(0, int(n), int(s)) for s, n in set(zip(step.tolist(), length.tolist()))]))
    bounds, even = set(bounds.tolist()), bool((length == size).all())
    for j in range(size):
        if j in bounds:
            new = np.flatnonzero((j % step == 0) & (j < length))
            r.at[i] = at
            k[new] = r.take(i[new], wide[new])
            escaped = new[k[new] == (1 << wide[new]) - 1]
            k[escaped] = -1
            raw[escaped] = r.take(i[escaped], 5)
            at, plain = r.at[i], not (k < 0).any()
        if even and plain and j >= len(w):
            e, at = r.rice(at, k)
            guess = w[0] * rows[j - 1] if len(w) else 0
            for o in range(1, len(w)):
                guess = guess + w[o] * rows[j - 1 - o]
            rows[j] = e + (guess >> shift)
            continue
        live = np.flatnonzero((order <= j) & (length > j))
        rice, escaped = live[k[live] >= 0], live[k[live] < 0]
        e = np.zeros(len(i), np.int64)
        e[rice], at[rice] = r.rice(at[rice], k[rice])
        r.at[i] = at
        e[escaped] = _signed(r.take(i[escaped], raw[escaped]), np.maximum(raw[escaped], 1))
        at = r.at[i]
        guess = np.zeros(len(i), np.int64)
        for o in range(min(len(w), j)):
            guess += w[o] * rows[j - 1 - o]
        rows[j, live] = (e + (guess >> shift))[live]
    x[i] = rows.T
