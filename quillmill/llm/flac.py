"""FLAC media columns: 8-bit mono streams, written and read many frames at a time.

The codec works on all frames of a batch side by side: a numpy lane is a frame, and a step handles
one sample (or one Rice code) of every lane. Frames can be taken apart independently because every
stream carries a seek point for each frame; streams of other writers need one too, or are
refused. The reader handles constant, verbatim, fixed and LPC subframes, both Rice parameter widths, any
partition order and escaped partitions, and verifies the header's CRC-8, the frame's CRC-16 and
the stream's MD5. The writer picks between constant, verbatim, fixed predictors and a quantised LPC.

Decoded audio comes as PCM blocks with their sample offsets, so a reader can seek without
touching the frames before.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import as_bytes, slices

BLOCK = 1024
UNIT = 64
RATE = 8000
LPC_ORDER = 4
LPC_SHIFT = 10
LPC_PRECISION = 12
PARTITIONS = 2  # 2 ** PARTITIONS Rice partitions a frame
#: Payload bytes that are coded side by side; bounds a worker's memory.
BATCH_BYTES = 4 << 20
#: The predictors that FLAC defines by order.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_table(poly: int, width: int, bits: int) -> np.ndarray:
    """CRC of every value of ``bits`` bits."""
    crc = np.arange(1 << bits, dtype=np.uint32) << np.uint32(max(0, width - bits))
    for _ in range(bits):
        crc = np.where(crc >> np.uint32(width - 1) & np.uint32(1), (crc << np.uint32(1)) ^ np.uint32(poly), crc << np.uint32(1)) & np.uint32((1 << width) - 1)
    return crc


_CRC8 = _crc_table(0x07, 8, 8).tolist()
_CRC16_BYTE = _crc_table(0x8005, 16, 8)
_CRC16_WORD = _crc_table(0x8005, 16, 16)
#: Leading zeros of 16-bit values.
_ZEROS = np.array([16 - int(i).bit_length() for i in range(1 << 16)], np.int64)


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = _CRC8[crc ^ b]
    return crc


def crc16(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges at once, two bytes a step."""
    order = np.argsort(-lengths, kind="stable")
    at, half = starts[order], lengths[order] // 2
    words = (data[:-1].astype(np.uint16) << np.uint16(8)) | data[1:]
    crc = np.zeros(len(starts), np.uint32)
    steps = int(half.max(initial=0))
    active = np.searchsorted(-half, -np.arange(1, steps + 1), side="right")
    for i in range(steps):
        k = active[i]
        crc[:k] = _CRC16_WORD[crc[:k] ^ words[at[:k] + 2 * i]]
    odd = np.flatnonzero(lengths[order] & 1)
    last = data[at[odd] + lengths[order][odd] - 1]
    crc[odd] = ((crc[odd] << np.uint32(8)) & np.uint32(0xFFFF)) ^ _CRC16_BYTE[(crc[odd] >> np.uint32(8)) ^ last]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """UTF-8-like coding of a frame number."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while n >= 1 << (6 - len(tail)):
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
    lead = (0xFF << (7 - len(tail))) & 0xFF
    return bytes([lead | n, *reversed(tail)])


_headers: dict[tuple[int, int], bytes] = {}


def _header(number: int, size: int) -> bytes:
    got = _headers.get((number, size))
    if got is None:
        code, extra = (10, b"") if size == 1024 else (6, bytes([size - 1])) if size <= 256 else (7, struct.pack(">H", size - 1))
        head = bytes([0xFF, 0xF8, code << 4, 1 << 1]) + _number(number) + extra
        got = head + bytes([crc8(head)])
        if len(_headers) < 100_000:
            _headers[(number, size)] = got
    return got


# -- writing -----------------------------------------------------------------------------------


def _lpc(s: np.ndarray) -> np.ndarray:
    """Quantised predictor of each row, by Levinson-Durbin on the autocorrelation."""
    x = s.astype(np.float64)
    r = np.stack([(x[:, k:] * x[:, : x.shape[1] - k]).sum(axis=1) for k in range(LPC_ORDER + 1)])
    err = np.maximum(r[0], 1e-9)
    a = np.zeros((LPC_ORDER, len(s)))
    for i in range(LPC_ORDER):
        k = (r[i + 1] - (a[:i] * r[i:0:-1]).sum(axis=0)) / err
        a[:i] -= k * a[:i][::-1]
        a[i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    limit = (1 << (LPC_PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << LPC_SHIFT)), -limit, limit).astype(np.int32).T


def _residuals(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per frame the residual of the best predictor, its subframe type and LPC coefficients."""
    best = s.copy()
    cost = np.abs(best).sum(axis=1, dtype=np.int64)
    kind = np.full(len(s), 8, np.int64)
    for order in (1, 2):
        r = s.copy()
        r[:, order:] = np.diff(s, n=order, axis=1)
        c = np.abs(r[:, order:]).sum(axis=1, dtype=np.int64)
        better = c < cost
        best[better], cost[better], kind[better] = r[better], c[better], 8 + order
    coefficients = _lpc(s)
    guess = np.zeros((len(s), s.shape[1] - LPC_ORDER), np.int32)
    for j in range(LPC_ORDER):
        guess += coefficients[:, j : j + 1] * s[:, LPC_ORDER - 1 - j : s.shape[1] - 1 - j]
    r = s.copy()
    r[:, LPC_ORDER:] -= guess >> LPC_SHIFT
    better = np.abs(r[:, LPC_ORDER:]).sum(axis=1, dtype=np.int64) + 8 * LPC_ORDER < cost
    best[better], kind[better] = r[better], 32 + LPC_ORDER - 1
    kind[(s == s[:, :1]).all(axis=1)] = 0
    return best, kind, coefficients


class _Bits:
    """Collects (bit position, width, value) triples of at most 16 bits and ORs them into bytes."""

    def __init__(self, n_bytes: int):
        self.data = np.zeros(n_bytes + 4, np.uint8)

    def put(self, at: np.ndarray, width, value: np.ndarray) -> None:
        word = value.astype(np.uint32) << (24 - width - (at & 7)).astype(np.uint32)
        first = at >> 3
        for k in range(3):
            # bits of different values never overlap, so bytes add up without carries
            self.data += np.bincount(first + k, weights=(word >> np.uint32(16 - 8 * k)) & np.uint32(0xFF), minlength=len(self.data)).astype(np.uint8)


def encode_frames(samples: np.ndarray, numbers: list[int]) -> list[bytes]:
    """Frames of equal length: rows of signed 8-bit samples (as int32), with their numbers."""
    n_frames, size = samples.shape
    residual, kind, coefficients = _residuals(samples)
    order = np.where(kind >= 32, LPC_ORDER, np.where(kind >= 8, kind - 8, 0))
    u = ((residual << 1) ^ (residual >> 31)).astype(np.int32)
    parts = 1 << PARTITIONS
    width = size // parts
    warm = np.arange(size) < order[:, None]
    u[warm] = 0
    grouped = u.reshape(n_frames, parts, width)
    mean = grouped.mean(axis=2)
    guess = np.clip(np.floor(np.log2(np.maximum(mean, 1))).astype(np.int32), 0, 13)
    fits = np.stack([(grouped >> k[:, :, None]).sum(axis=2) + width * (1 + k) for k in (np.maximum(guess - 1, 0), guess, guess + 1)])
    rice = np.choose(fits.argmin(axis=0), [np.maximum(guess - 1, 0), guess, guess + 1]).astype(np.int32)
    k = np.repeat(rice, width, axis=1)
    bits = (u >> k) + 1 + k
    bits[warm] = 0
    side = np.where(kind >= 32, 8 * LPC_ORDER + 9 + LPC_PRECISION * LPC_ORDER, 8 * order) + 6 + 4 * parts
    coded = side + bits.sum(axis=1)
    kind = np.where((kind != 0) & (coded >= 8 * size), 1, kind)
    heads = [_header(i, size) for i in numbers]
    head_bytes = np.array([len(h) for h in heads])
    body = 8 + np.where(kind == 0, 8, np.where(kind == 1, 8 * size, coded))
    lengths = head_bytes + (body + 7) // 8 + 2
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    out = _Bits(int(lengths.sum()))
    for s, h in zip(starts.tolist(), heads, strict=True):
        out.data[s : s + len(h)] = np.frombuffer(h, np.uint8)
    at = 8 * (starts + head_bytes)
    out.put(at, 8, kind << 1)
    at = at + 8
    raw = samples & 0xFF
    rows = np.flatnonzero(kind == 0)
    out.put(at[rows], 8, raw[rows, 0])
    rows = np.flatnonzero(kind == 1)
    out.put((at[rows][:, None] + 8 * np.arange(size)).ravel(), 8, raw[rows].ravel())
    rows = np.flatnonzero(kind >= 8)
    for j in range(LPC_ORDER):
        with_j = rows[order[rows] > j]
        out.put(at[with_j] + 8 * j, 8, raw[with_j, j])
    at = at + 8 * order
    lpc = rows[kind[rows] >= 32]
    out.put(at[lpc], 9, np.full(len(lpc), ((LPC_PRECISION - 1) << 5) | LPC_SHIFT))
    for j in range(LPC_ORDER):
        out.put(at[lpc] + 9 + LPC_PRECISION * j, LPC_PRECISION, coefficients[lpc, j] & ((1 << LPC_PRECISION) - 1))
    at[lpc] += 9 + LPC_PRECISION * LPC_ORDER
    out.put(at[rows], 6, np.full(len(rows), PARTITIONS))
    at = at + 6
    # one parameter before each partition's codes
    bits, k, u = bits[rows], k[rows], u[rows]
    bits[:, ::width] += 4
    ends = np.cumsum(bits, axis=1) + at[rows][:, None]
    first = ends[:, ::width] - bits[:, ::width]
    out.put(first.ravel(), 4, rice[rows].ravel())
    live = ~warm[rows]
    k, u = k[live], u[live]
    stop = ends[live]
    out.put(stop - 1 - k, 1 + k, (1 << k) | (u & ((1 << k) - 1)))
    sums = crc16(out.data, starts, lengths - 2)
    out.data[starts + lengths - 2] = sums >> 8
    out.data[starts + lengths - 1] = sums & 0xFF
    data = out.data.tobytes()
    return [data[s : s + n] for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads whose lengths are positive multiples of ``UNIT``; a byte b is the sample b - 128."""
    by_size: dict[int, list[tuple[int, int]]] = {}
    for d, p in enumerate(payloads):
        for i in range(0, len(p), BLOCK):
            by_size.setdefault(min(BLOCK, len(p) - i), []).append((d, i))
    frames: list[list] = [[None] * -(-len(p) // BLOCK) for p in payloads]
    for size, where in by_size.items():
        step = max(1, BATCH_BYTES // size)
        for a in range(0, len(where), step):
            some = where[a : a + step]
            block = np.frombuffer(b"".join(payloads[d][i : i + size] for d, i in some), np.uint8).reshape(-1, size).astype(np.int32) - 128
            for (d, i), frame in zip(some, encode_frames(block, [i // BLOCK for _, i in some]), strict=True):
                frames[d][i // BLOCK] = frame
    out = []
    for p, own in zip(payloads, frames, strict=True):
        sizes = [len(f) for f in own]
        offset, points = 0, []
        for i, n in enumerate(sizes):
            points.append(struct.pack(">QQH", i * BLOCK, offset, min(BLOCK, len(p) - i * BLOCK)))
            offset += n
        digest = hashlib.md5(bytes(p).translate(_SIGNED)).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += ((RATE << 44) | (0 << 41) | (7 << 36) | len(p)).to_bytes(8, "big") + digest
        table = b"".join(points)
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(own))
    return out


#: Unsigned to signed bytes and back: the sign bit turns.
_SIGNED = bytes(b ^ 0x80 for b in range(256))


# -- reading -----------------------------------------------------------------------------------


class DamagedStream(ValueError):
    """A stream that isn't FLAC as this reader knows it, or whose checksums disagree."""


@dataclass
class Stream:
    data: bytes
    samples: int
    md5: bytes
    points: list[tuple[int, int, int]]  # first sample, byte in data, samples


def open_stream(data: bytes) -> Stream:
    """Metadata of a mono 8-bit stream with a seek point for each frame."""
    if data[:4] != b"fLaC":
        raise DamagedStream("no FLAC marker")
    at, last, info, table = 4, False, None, b""
    while not last:
        head, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        last, body = bool(head & 0x80), data[at + 4 : at + 4 + size]
        info, table = (body, table) if head & 0x7F == 0 else (info, body) if head & 0x7F == 3 else (info, table)
        at += 4 + size
    if info is None or len(info) != 34:
        raise DamagedStream("no stream information")
    packed = int.from_bytes(info[10:18], "big")
    samples = packed & ((1 << 36) - 1)
    if (packed >> 41) & 7 or ((packed >> 36) & 31) != 7:
        raise DamagedStream("only mono 8-bit streams")
    points = [(first, at + offset, n) for first, offset, n in struct.iter_unpack(">QQH", table) if first != (1 << 64) - 1]
    if [p[0] for p in points] != [0, *np.cumsum([p[2] for p in points])[:-1].tolist()] or sum(p[2] for p in points) != samples:
        raise DamagedStream("the seek points don't cover the stream")
    return Stream(data, samples, info[18:], points)


def _frame_start(data: bytes, at: int, size: int) -> int:
    """Byte after a frame's header, once sync code, length and CRC-8 agree."""
    if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise DamagedStream("no frame where a seek point leads")
    code, lead = data[at + 2] >> 4, data[at + 4]
    tail = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    p = at + 5 + tail
    if code == 6:
        n, p = data[p] + 1, p + 1
    elif code == 7:
        n, p = int.from_bytes(data[p : p + 2], "big") + 1, p + 2
    else:
        n = 192 if code == 1 else 576 << (code - 2) if 2 <= code <= 5 else 256 << (code - 8) if code >= 8 else 0
    rate = data[at + 2] & 15
    p += 1 if rate == 12 else 2 if rate in (13, 14) else 0
    if n != size or data[at + 3] >> 4 or crc8(data[at:p]) != data[p]:
        raise DamagedStream("a frame header's checksum or size is wrong")
    return p + 1


class _Reader:
    """A bit position for each lane over one buffer."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
        n = len(data)
        self.words = np.zeros(n, np.uint64)
        for k in range(5):
            self.words = (self.words << np.uint64(8)) | padded[k : k + n]
        self.at = at  # bits

    def take(self, lanes: np.ndarray, width) -> np.ndarray:
        """Up to 32 unsigned bits from each of some lanes."""
        p = self.at[lanes]
        width = np.broadcast_to(np.asarray(width), p.shape)
        got = (self.words[np.minimum(p >> 3, len(self.words) - 1)] >> (40 - width - (p & 7)).astype(np.uint64)).astype(np.int64) & ((np.int64(1) << width) - 1)
        self.at[lanes] = p + width
        return got

    def rice(self, lanes: np.ndarray | slice, k: np.ndarray) -> np.ndarray:
        p = self.at[lanes]
        top = (self.words[p >> 3] >> (np.uint64(24) - (p & 7).astype(np.uint64))).astype(np.int64) & 0xFFFF
        zeros = _ZEROS[top]
        if (zeros == 16).any():
            more = np.flatnonzero(zeros == 16)
            while len(more):
                q = p[more] + zeros[more]
                if (q >> 3 >= len(self.words)).any():
                    raise DamagedStream("a code runs past its frame")
                step = _ZEROS[(self.words[q >> 3] >> (np.uint64(24) - (q & 7).astype(np.uint64))).astype(np.int64) & 0xFFFF]
                zeros[more] += step
                more = more[step == 16]
        p = p + zeros + 1
        low = (self.words[np.minimum(p >> 3, len(self.words) - 1)] >> (40 - k - (p & 7)).astype(np.uint64)).astype(np.int64) & ((np.int64(1) << k) - 1)
        self.at[lanes] = p + k
        u = (zeros << k) | low
        return (u >> 1) ^ -(u & 1)


def _signed(value: np.ndarray, width) -> np.ndarray:
    half = np.int64(1) << (np.asarray(width, np.int64) - 1)
    return (value ^ half) - half


def decode_frames(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Samples (rows) of frames of one length, from the byte after each header."""
    n = len(starts)
    every = np.arange(n)
    reader = _Reader(data, 8 * starts.astype(np.int64))
    head = reader.take(every, 8)
    kind = head >> 1
    if (head & 0x81).any():
        raise DamagedStream("reserved or wasted bits in a subframe")
    order = np.where(kind >= 32, kind - 31, np.where((kind >= 8) & (kind <= 12), kind - 8, 0))
    if (~((kind <= 1) | ((kind >= 8) & (kind <= 12)) | (kind >= 32))).any():
        raise DamagedStream("a reserved subframe type")
    samples = np.zeros((size, n), np.int64)  # a row a step, so that a step is contiguous
    constant, verbatim, lanes = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1), np.flatnonzero(kind >= 8)
    if len(constant):
        samples[:, constant] = _signed(reader.take(constant, 8), 8)
    if len(verbatim):
        at = (reader.at[verbatim] >> 3)[None, :] + np.arange(size)[:, None]
        samples[:, verbatim] = data[at].astype(np.int8)
    if not len(lanes):
        return samples.T
    order = order[lanes]
    most = int(order.max())
    own = np.zeros((size, len(lanes)), np.int64)
    for j in range(most):
        with_j = np.flatnonzero(order > j)
        own[j, with_j] = _signed(reader.take(lanes[with_j], 8), 8)
    coefficients, shift = np.zeros((most, len(lanes)), np.int64), np.zeros(len(lanes), np.int64)
    for o in range(1, 5):
        if len(fixed := np.flatnonzero(kind[lanes] == 8 + o)):
            coefficients[:o, fixed] = np.array(FIXED[o])[:, None]
    lpc = np.flatnonzero(kind[lanes] >= 32)
    if len(lpc):
        precision = reader.take(lanes[lpc], 4) + 1
        shift[lpc] = _signed(reader.take(lanes[lpc], 5), 5)
        for j in range(most):
            at = np.flatnonzero(order[lpc] > j)
            coefficients[j, lpc[at]] = _signed(reader.take(lanes[lpc[at]], precision[at]), precision[at])
    method, partitions = reader.take(lanes, 2), reader.take(lanes, 4)
    if (method > 1).any() or (shift < 0).any():
        raise DamagedStream("a reserved residual method or shift")
    bits = 4 + method
    per = size >> partitions
    k, raw = np.zeros(len(lanes), np.int64), np.full(len(lanes), -1, np.int64)
    turns = {int(o): True for o in np.unique(order)} | {j: True for w in np.unique(per) for j in range(0, size, int(w))}
    whole = len(lanes) == n and (lanes == every).all()
    escaped = False
    for j in range(size):
        if j in turns:
            new = np.flatnonzero(((j % per == 0) & (j > order)) | (j == order))
            if len(new):
                k[new] = reader.take(lanes[new], bits[new])
                raw[new] = -1
                esc = new[k[new] == (1 << bits[new]) - 1]
                if len(esc):
                    raw[esc] = reader.take(lanes[esc], 5)
                escaped = bool((raw >= 0).any())
        if j >= most and not escaped:
            value = reader.rice(slice(None) if whole else lanes, k)
            if most:
                guess = coefficients[0] * own[j - 1]
                for i in range(1, most):
                    guess += coefficients[i] * own[j - 1 - i]
                value += guess >> shift
            own[j] = value
            continue
        live = np.flatnonzero(order <= j)
        if not len(live):
            continue
        value = np.zeros(len(live), np.int64)
        plain, esc = np.flatnonzero(raw[live] < 0), np.flatnonzero(raw[live] > 0)
        value[plain] = reader.rice(lanes[live[plain]], k[live[plain]])
        if len(esc):
            value[esc] = _signed(reader.take(lanes[live[esc]], raw[live[esc]]), raw[live[esc]])
        guess = np.zeros(len(live), np.int64)
        for i in range(min(most, j)):
            guess += coefficients[i, live] * own[j - 1 - i, live]
        own[j, live] = value + (guess >> shift[live])
    samples[:, lanes] = own
    return samples.T


def decode_points(streams: list[Stream], wanted: list[tuple[int, int]]) -> list[bytes]:
    """Signed 8-bit PCM of some frames, given as (stream, point) pairs; checksums are verified."""
    out: list[bytes] = [b""] * len(wanted)
    by_size: dict[int, list[int]] = {}
    for w, (s, p) in enumerate(wanted):
        by_size.setdefault(streams[s].points[p][2], []).append(w)
    for size, group in by_size.items():
        step = max(1, BATCH_BYTES // size)
        for a in range(0, len(group), step):
            some = group[a : a + step]
            pieces, starts, heads, at = [], [], [], 0
            for w in some:
                s, p = wanted[w]
                stream = streams[s]
                begin = stream.points[p][1]
                end = stream.points[p + 1][1] if p + 1 < len(stream.points) else len(stream.data)
                heads.append(at + _frame_start(stream.data, begin, size) - begin)
                starts.append(at)
                pieces.append(stream.data[begin:end])
                at += end - begin
            data = np.frombuffer(b"".join(pieces), np.uint8)
            lengths = np.array([len(x) for x in pieces])
            if crc16(data, np.array(starts), lengths).any():  # a frame followed by its CRC leaves nothing
                raise DamagedStream("a frame's checksum is wrong")
            for w, row in zip(some, decode_frames(data, np.array(heads), size).astype(np.int8), strict=True):
                out[w] = row.tobytes()
    return out


def decode(streams: list[bytes]) -> list[bytes]:
    """Payloads of whole streams, every checksum verified."""
    opened = [open_stream(s) for s in streams]
    wanted = [(s, p) for s, x in enumerate(opened) for p in range(len(x.points))]
    parts: list[list[bytes]] = [[] for _ in streams]
    for (s, _), pcm in zip(wanted, decode_points(opened, wanted), strict=True):
        parts[s].append(pcm)
    out = []
    for x, own in zip(opened, parts, strict=True):
        pcm = b"".join(own)
        if hashlib.md5(pcm).digest() != x.md5:
            raise DamagedStream("the stream's MD5 is wrong")
        out.append(pcm.translate(_SIGNED))
    return out


def seek(data: bytes, sample: int, count: int) -> bytes:
    """PCM of ``count`` samples from ``sample`` on (fewer at the end, none beyond it), decoding only the frames that hold them."""
    stream = open_stream(data)
    hit = [p for p, (first, _, n) in enumerate(stream.points) if first < sample + count and first + n > sample]
    pcm = b"".join(decode_points([stream], [(0, p) for p in hit]))
    skip = sample - stream.points[hit[0]][0] if hit else 0
    return pcm[skip : skip + count]


# -- columns -----------------------------------------------------------------------------------


def payload(text: bytes | None) -> bytes:
    """A text's UTF-8 bytes with zero bytes up to a positive multiple of ``UNIT``; null is empty."""
    text = text or b""
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def features(data: bytes) -> str:
    """Sample statistics of a decoded payload: count, sum, energy, sign changes and peak."""
    s = np.frombuffer(data, np.uint8).astype(np.int64) - 128
    turns = int(np.count_nonzero((s[1:] < 0) != (s[:-1] < 0)))
    return f"n={len(s)};sum={int(s.sum())};energy={int((s * s).sum())};turns={turns};peak={int(np.abs(s).max())}"


def _batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    return slices(batches, 4096, BATCH_BYTES, column)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, n_bytes, media`` of ``doc_id, text``."""
    for part in _batches(batches, "text"):
        texts = as_bytes(part.column("text"))
        media = encode([payload(t) for t in texts])
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


_BLOCK = (("doc_id", pa.int64()), ("block", pa.int64()), ("sample_offset", pa.int64()), ("n_samples", pa.int64()), ("pcm", pa.binary()))
_OF_STREAM = (("n_bytes", pa.int64()), ("samples", pa.int64()), ("md5", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()))


def _blocks(batches: Iterator[pa.RecordBatch], of_stream: bool = False) -> Iterator[pa.RecordBatch]:
    """The frames of ``doc_id, media`` as PCM blocks, in order; ``of_stream`` adds what their stream says of itself."""
    columns = _BLOCK + _OF_STREAM * of_stream
    for part in _batches(batches, "media"):
        media, ids = part.column("media").to_pylist(), part.column("doc_id").to_pylist()
        sizes = part.column("n_bytes").to_pylist() if of_stream else [0] * len(ids)
        streams = [(i, n, open_stream(m)) for i, n, m in zip(ids, sizes, media, strict=True) if m is not None]
        facts = [(n, x.samples, x.md5, len(x.data), hashlib.sha256(x.data).hexdigest()) if of_stream else () for _, n, x in streams]
        wanted = [(s, p) for s, (_, _, x) in enumerate(streams) for p in range(len(x.points))]
        decoded = decode_points([x for _, _, x in streams], wanted)
        rows = [(streams[s][0], p, streams[s][2].points[p][0], len(pcm), pcm, *facts[s]) for (s, p), pcm in zip(wanted, decoded, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True) if rows else [()] * len(columns), columns, strict=True)], [c for c, _ in columns])


def store_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text as a FLAC stream.

    Null and empty texts are 64 zero bytes, very long ones have as many frames as they need, repeated rows repeat; an
    empty table gives no rows, and other columns are not looked at.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """``doc_id, block, sample_offset, n_samples, pcm`` of every frame of a ``doc_id, media`` table.

    A null stream has no blocks, a damaged one raises DamagedStream; repeated rows repeat theirs, an empty table gives no rows.
    """
    return media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("media").cast("binary").alias("media")).mapInArrow(
        _blocks, "doc_id long, block long, sample_offset long, n_samples long, pcm binary"
    )


def read_blocks(blocks: list[tuple[int, bytes]], sample: int, count: int) -> bytes:
    """PCM of ``count`` samples from ``sample`` on, out of a stream's (sample offset, PCM) blocks in order; only those that hold them are touched."""
    first = max(0, bisect_right(blocks, sample, key=lambda b: b[0]) - 1)
    out = b""
    for offset, pcm in blocks[first:]:
        if offset >= sample + count:
            break
        out += pcm[max(0, sample - offset) : sample + count - offset]
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each stream, from its blocks: they have to follow one another, and to be what its checksum says."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in batches:
        rows: list[tuple] = []
        columns = [batch.column(c).to_pylist() for c, _ in _BLOCK + _OF_STREAM]
        blocks: list[tuple[int, bytes]] = []
        at = 0
        for doc_id, _, offset, n, pcm, n_bytes, samples, md5, media_bytes, media_sha256 in zip(*columns, strict=True):
            if offset != at:
                raise DamagedStream("a block is missing")
            blocks.append((offset, pcm))
            at += n
            if at < samples:
                continue
            whole = b"".join(b for _, b in blocks)
            if at != samples or hashlib.md5(whole).digest() != md5:
                raise DamagedStream("the stream's MD5 is wrong")
            read = whole.translate(_SIGNED)
            tail = read_blocks(blocks, samples - UNIT, UNIT).translate(_SIGNED)
            rows.append((doc_id, n_bytes, samples, hashlib.sha256(read).hexdigest(), zlib.crc32(tail), media_bytes, media_sha256, features(read)))
            blocks, at = [], 0
        if blocks:
            raise DamagedStream("a stream's last block is missing")
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(names), kinds, strict=True)], names)


def media_digests(docs: DataFrame) -> DataFrame:
    """A row for each row: the stored stream's and its read-back payload's sizes, digests and features.

    Every text is written as FLAC, read back as PCM blocks with all checksums verified, and judged on these; the tail
    is found by its sample offset. Null texts are empty; equal texts, and so repeated rows, give equal values; very long texts
    are many blocks, coded some megabytes at a time; an empty table gives no rows, and other columns are not looked at.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda it: _digests(_blocks(_stored(it), of_stream=True)),
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
