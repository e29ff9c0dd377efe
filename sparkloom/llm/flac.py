"""FLAC media columns: encoding to and decoding from complete FLAC streams.

A batch of streams is handled at once: every frame is a lane, and numpy takes one sample
of all lanes a step, so that the sequential parts (Rice codes, linear prediction) run
over thousands of frames together. Frames are found through the seek table where it
names each of them, else by their sync codes and header checksums. Header CRC-8, frame
CRC-16 and the MD5 of the samples are verified. Streams are independent: no shuffle.

Decoded are PCM blocks: (id, block, first_sample, n_samples, byte_offset, pcm), samples
little-endian and interleaved, in (bits + 7) // 8 bytes each, ``byte_offset`` being that
of the frame in the stream, so that a block can be sought.

Defined results. Null stream or payload: treated as an empty payload. A damaged stream:
``ValueError`` that names the row, unless ``on_error="skip"``, which returns it with a
null pcm and the message. Repeated rows: a result each. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.bytewords import slices, spread, text_buffer
from sparkloom.llm.shared import stored, table

#: Fixed values of the format.
BLOCK_CODES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
BITS_CODES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
FIXED = np.array([[0, 0, 0, 0], [1, 0, 0, 0], [2, -1, 0, 0], [3, -3, 1, 0], [4, -6, 4, -1]])
LPC_ORDER, LPC_BITS, PROBE = 4, 12, 192
U = np.uint64
SIGNED = np.arange(-128, 128, dtype=np.int32)
#: Bytes by how common they are in text, roughly; the commonest become the samples nearest to 0.
COMMON = b" etaoinsrhldcumfpgwybvkxjqz,.\n"


def text_samples() -> np.ndarray:
    """A one-to-one map of byte values to samples for text: 0, -1, 1, -2, 2, ... for the
    bytes of COMMON and then for all others in order."""
    ranked = list(COMMON) + [b for b in range(256) if b not in COMMON]
    out = np.empty(256, np.int32)
    out[ranked] = [(i >> 1) ^ -(i & 1) for i in range(256)]
    return out


def _crc_table(poly: int, width: int) -> np.ndarray:
    out = []
    for b in range(256):
        c = b << (width - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> (width - 1) else 0)
            c &= (1 << width) - 1
        out.append(c)
    return np.array(out, np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_by_distance: list[np.ndarray] = [CRC16[None, :]]


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each range. The CRC is linear: a byte adds what its value gives at its
    distance from the end."""
    longest = int((ends - starts).max())
    t = _by_distance[0]
    if len(t) < longest:
        rows, last = [t], t[-1]
        for _ in range(longest + longest // 4 - len(t)):
            last = (last << np.uint16(8)) ^ CRC16[last >> np.uint16(8)]
            rows.append(last[None, :])
        t = _by_distance[0] = np.concatenate(rows)
    at = spread(starts, ends - starts)
    distance = np.repeat(ends, ends - starts) - 1 - at
    return np.bitwise_xor.reduceat(t.ravel()[(distance << 8) + data[at]], np.r_[0, np.cumsum(ends - starts)[:-1]])


@lru_cache(1 << 16)
def frame_header(number: int, samples: int, standard: int) -> bytes:
    code = next((c for c, n in BLOCK_CODES.items() if n == samples == standard), 7)
    head = bytearray([0xFF, 0xF8, code << 4, 0x02])  # mono, 8 bits
    if number < 0x80:
        head.append(number)
    else:
        n = next(n for n in range(2, 8) if number < 1 << (5 * n + 1))
        head.append((0xFF00 >> n) & 0xFF | number >> (6 * (n - 1)))
        head += bytes(0x80 | number >> (6 * i) & 0x3F for i in range(n - 2, -1, -1))
    if code == 7:
        head += struct.pack(">H", samples - 1)
    c = 0
    for b in head:
        c = int(CRC8[c ^ b])
    return bytes(head) + bytes([c])


def _predict(s: np.ndarray, coef: np.ndarray, shift: np.ndarray, frame: np.ndarray) -> np.ndarray:
    total = np.zeros(len(s), np.int32)
    coef = coef.astype(np.int32)
    for j in range(coef.shape[1]):
        if np.any(coef[:, j]):
            total[j + 1 :] += coef[frame[j + 1 :], j] * s[: -j - 1].astype(np.int32)
    return total >> shift.astype(np.int32)[frame]


def _lpc(s: np.ndarray, starts: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised coefficients and shift of each frame, from its autocorrelation."""
    x = s.astype(float)
    r = np.empty((len(starts), LPC_ORDER + 1))
    for j in range(LPC_ORDER + 1):
        p = np.zeros(len(x))
        p[j:] = x[j:] * x[: len(x) - j]
        p[index < j] = 0
        r[:, j] = np.add.reduceat(p, starts)
    i = np.arange(LPC_ORDER)
    system = r[:, np.abs(i[:, None] - i[None, :])] + (1e-4 * r[:, :1] + 1)[:, :, None] * np.eye(LPC_ORDER)
    c = np.linalg.solve(system, r[:, 1:, None])[:, :, 0]
    top = np.maximum(np.abs(c).max(1), 1e-9)
    shift = np.clip(LPC_BITS - 2 - np.ceil(np.log2(top)), 0, 15).astype(np.int64)
    q = np.round(c * (1 << shift)[:, None]).astype(np.int64)
    limit = (1 << (LPC_BITS - 1)) - 1
    return np.clip(q, -limit, limit), shift, (top < 1 << 8)


def pack_bits(value: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the values, each in its number (< 58) of bits, and the bit where each starts."""
    ends = np.cumsum(bits)
    at = ends - bits
    total = int(ends[-1])
    out = np.zeros(total // 64 + 2, np.uint64)
    word, room = at >> 6, 64 - (at & 63) - bits
    high = np.where(room >= 0, value << np.maximum(room, 0).astype(U), value >> np.maximum(-room, 0).astype(U))
    first = np.flatnonzero(np.r_[True, np.diff(word) > 0])
    out[word[first]] = np.add.reduceat(high, first)
    over = np.flatnonzero(room < 0)
    out[word[over] + 1] += value[over] << (64 + room[over]).astype(U)  # at most one value runs over into a word
    return out.astype(">u8").view(np.uint8)[: (total + 7) // 8], at


def encode(payloads: list[bytes], block: int = 2048, sample_of: np.ndarray | None = None) -> list[bytes]:
    """A mono 8-bit FLAC stream of each payload; an empty one has no frames. ``sample_of``: the sample, -128
    to 127, for each byte value; the byte less 128 if not given."""
    if not payloads:
        return []
    size = np.array([len(p) for p in payloads])
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    s = SIGNED[raw] if sample_of is None else np.asarray(sample_of, np.int32)[raw]
    frames_of = -(-size // block)
    first_frame = np.r_[0, np.cumsum(frames_of)]
    doc = np.repeat(np.arange(len(size)), frames_of)
    number = np.arange(len(doc)) - first_frame[doc]
    starts = (np.cumsum(size) - size)[doc] + number * block
    n = np.minimum(block, size[doc] - number * block)
    frame = np.repeat(np.arange(len(n)), n)
    index = np.arange(len(s)) - starts[frame]

    # The predictor of a frame is the one that does best on its first samples.
    probe_n = np.minimum(n, PROBE)
    at = spread(starts, probe_n)
    x, probe_starts = s[at].astype(np.int64), np.cumsum(probe_n) - probe_n
    probe_index = np.arange(len(x)) - np.repeat(probe_starts, probe_n)
    lpc_coef, lpc_shift, usable = _lpc(x, probe_starts, probe_index)
    cost, r = [], x
    for m in range(5):
        cost.append(np.add.reduceat(np.where(probe_index < m, 8, np.abs(r)), probe_starts).astype(float))
        r = np.diff(r, prepend=0)
    r = x - _predict(x, lpc_coef, lpc_shift, np.repeat(np.arange(len(n)), probe_n))
    cost.append(np.where(usable, np.add.reduceat(np.where(probe_index < LPC_ORDER, 8, np.abs(r)), probe_starts) + 4 * LPC_ORDER, np.inf))
    for m in range(1, 6):
        cost[m][n <= m] = np.inf
    method = np.argmin(cost, 0)
    order = np.array([0, 1, 2, 3, 4, LPC_ORDER])[method]
    coef = np.where((method == 5)[:, None], lpc_coef, FIXED[np.minimum(method, 4)])
    shift = np.where(method == 5, lpc_shift, 0)
    r = s if not coef.any() else s - _predict(s, coef, shift, frame)
    z = (r << 1) ^ (r >> 31)
    warm_up = order.any()
    if warm_up:
        z[index < order[frame]] = 0

    # Four partitions in whole blocks, one elsewhere; a Rice parameter for each.
    parts = np.where((n == block) & (block % 4 == 0) & (block // 4 > LPC_ORDER), 4, 1)
    part_frame = np.repeat(np.arange(len(n)), parts)
    part_no = np.arange(len(part_frame)) - np.repeat(np.cumsum(parts) - parts, parts)
    part_start = starts[part_frame] + part_no * (n // parts)[part_frame]
    part_n = (n // parts)[part_frame] - np.where(part_no == 0, order[part_frame], 0)
    mean = np.add.reduceat(z, part_start) / np.maximum(part_n, 1)
    k = np.clip(np.floor(np.log2(mean * 0.7 + 0.5)), 0, 14).astype(np.int64)
    k = np.maximum(k, np.ceil(np.log2(np.maximum(np.maximum.reduceat(z, part_start), 1) / 40)).astype(np.int64))
    part = np.cumsum(np.bincount(part_start, minlength=len(s))[: len(s)]) - 1
    k = k.astype(np.int32)
    ks = k[part]
    bits = (z >> ks) + 1 + ks
    if warm_up:
        bits[index < order[frame]] = 8
    total = np.add.reduceat(bits, starts) + 8 + 6 + 4 * parts + np.where(method == 5, 9 + LPC_BITS * LPC_ORDER, 0)
    flat = np.maximum.reduceat(raw, starts) == np.minimum.reduceat(raw, starts)
    plain = ~flat & (total >= 8 + 8 * n)
    kind = np.where(flat, 0, np.where(plain, 1, np.where(method == 5, 0x20 + LPC_ORDER - 1, 8 + order)))

    # All codes of a frame in stream order: header bytes, subframe header, samples with what precedes them, padding, CRC.
    heads = [frame_header(a, b, block) for a, b in zip(number.tolist(), n.tolist())]
    head_n = np.array([len(h) for h in heads])
    rice = ~flat & ~plain
    warm = np.where(rice, order, 0)
    lpc = np.where(kind >= 0x20, LPC_ORDER + 1, 0)
    body_n = np.where(flat, 1, n) + np.where(rice, parts + 1, 0) + lpc
    items = head_n + 1 + body_n + 2
    base = np.cumsum(items) - items
    value, width = np.zeros(int(items.sum()), np.uint64), np.zeros(int(items.sum()), np.int64)
    at = spread(base, head_n)
    value[at], width[at] = np.frombuffer(b"".join(heads), np.uint8), 8
    sub = base + head_n
    value[sub], width[sub] = kind << 1, 8
    keep = np.ones(len(s), bool)
    keep[flat[frame] & (index > 0)] = False
    extra = (sub + 1 - starts + np.where(rice, lpc + 2, 0) - np.where(rice, np.cumsum(parts) - parts, 0))[frame]
    at = np.arange(len(s)) + extra
    at += np.where(rice[frame], part, 0) if not rice.all() else part
    if warm_up:
        early = np.flatnonzero(rice[frame] & (index < order[frame]))
        at[early] = (sub + 1)[frame[early]] + index[early]
    what, wide = (1 << ks) | (z & ((1 << ks) - 1)), bits
    if warm_up or not rice.all():
        coded = rice[frame] & (index >= order[frame])
        what, wide = np.where(coded, what, s & 0xFF), np.where(coded, bits, 8)
    if not keep.all():
        at, what, wide = at[keep], what[keep], wide[keep]
    value[at], width[at] = what, wide
    f = np.flatnonzero(kind >= 0x20)
    if len(f):
        p = (sub + 1 + warm)[f]
        value[p], width[p] = ((LPC_BITS - 1) << 5) | shift[f], 9
        for j in range(LPC_ORDER):
            value[p + 1 + j], width[p + 1 + j] = coef[f, j] & ((1 << LPC_BITS) - 1), LPC_BITS
    f = np.flatnonzero(rice)
    p = (sub + 1 + warm + lpc)[f]
    value[p], width[p] = np.where(parts[f] == 4, 2, 0), 6
    live = rice[part_frame]
    p = (sub + 1 + lpc + 1)[part_frame] + part_no + np.where(part_no == 0, warm[part_frame], part_no * (n // parts)[part_frame])
    value[p[live]], width[p[live]] = k[live], 4
    end = base + items - 2
    length = np.add.reduceat(width, base)
    width[end] = -length % 8
    width[end + 1] = 16
    data, bit = pack_bits(value, width)
    data = data.copy()
    begins, ends = bit[base] >> 3, bit[end + 1] >> 3
    check = crc16(data, begins, ends)
    data[ends], data[ends + 1] = check >> 8, check & 0xFF

    out, body = [], data.tobytes()
    signed = s.astype(np.int8).tobytes()
    lows = np.cumsum(size) - size
    for d in range(len(size)):
        a, b = int(first_frame[d]), int(first_frame[d + 1])
        low, high = (int(begins[a]), int(ends[b - 1]) + 2) if b > a else (0, 0)
        lengths = ends[a:b] + 2 - begins[a:b]
        seek = np.zeros(b - a, [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
        seek["sample"], seek["offset"], seek["n"] = number[a:b] * block, begins[a:b] - low, n[a:b]
        info = struct.pack(">HH", max(16, block), max(16, block)) + int(lengths.min() if len(lengths) else 0).to_bytes(3, "big") + int(lengths.max(initial=0)).to_bytes(3, "big")
        info += (8000 << 44 | 0 << 41 | 7 << 36 | int(size[d])).to_bytes(8, "big") + hashlib.md5(signed[int(lows[d]) : int(lows[d] + size[d])]).digest()
        table_ = seek.tobytes()
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table_).to_bytes(3, "big") + table_ + body[low:high])
    return out


def _metadata(stream: bytes) -> tuple[dict, int]:
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, info, last = 4, {}, False
    while not last:
        last, kind, n = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + n]
        if kind == 0:
            x = int.from_bytes(body[10:18], "big")
            info |= {"rate": x >> 44, "channels": (x >> 41 & 7) + 1, "bits": (x >> 36 & 31) + 1, "total": x & (1 << 36) - 1, "md5": body[18:34], "block": int.from_bytes(body[2:4], "big")}
        elif kind == 3:
            points = np.frombuffer(body[: n // 18 * 18], [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
            info["seek"] = points[points["sample"] != (1 << 64) - 1]
        at += 4 + n
    if "bits" not in info:
        raise ValueError("no STREAMINFO")
    return info, at


def _headers(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Fields of the frame headers at the given bytes; ``ok``: valid, checksum included."""
    b = np.concatenate([data, np.zeros(24, np.uint8)])[at[:, None] + np.arange(17)].astype(np.int64)
    code, rate, channels, bits = b[:, 2] >> 4, b[:, 2] & 15, b[:, 3] >> 4, b[:, 3] >> 1 & 7
    lead = b[:, 4]
    ones = np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE, lead == 0xFE], [1, 0, 2, 3, 4, 5, 6, 7], 0)
    number = np.where(ones == 1, lead, lead & (0x7F >> np.maximum(ones, 1)))
    for j in range(1, 7):
        number = np.where(ones > j, number << 6 | b[:, 4 + j] & 0x3F, number)
    p = 4 + np.maximum(ones, 1)
    rows = np.arange(len(at))
    n = np.zeros(len(at), np.int64)
    for c, v in BLOCK_CODES.items():
        n[code == c] = v
    n = np.where(code == 6, b[rows, p] + 1, np.where(code == 7, (b[rows, p] << 8 | b[rows, np.minimum(p + 1, 16)]) + 1, n))
    p = p + np.where(code == 6, 1, np.where(code == 7, 2, 0)) + np.where(rate == 12, 1, np.where((rate == 13) | (rate == 14), 2, 0))
    c = np.zeros(len(at), np.int64)
    for j in range(16):
        c = np.where(j < p, CRC8[c ^ b[:, j]], c)
    ok = (b[:, 0] == 0xFF) & (b[:, 1] & 0xFE == 0xF8) & (n > 0) & (ones > 0) & (rate != 15) & (channels < 11) & (b[:, 3] & 1 == 0) & (c == b[rows, p])
    return {"n": n, "channels": channels, "bits": bits, "number": number, "variable": b[:, 1] & 1, "end": at + p + 1, "ok": ok}


def _find_frames(data: np.ndarray, low: int, high: int) -> np.ndarray:
    """Frame starts in data[low:high]: valid headers such that the two bytes before the
    next one (or the end) are the CRC-16 of what lies between."""
    at = low + np.flatnonzero((data[low : high - 1] == 0xFF) & (data[low + 1 : high] & 0xFE == 0xF8))
    at = at[_headers(data, at)["ok"]] if len(at) else at
    starts, begin, marks = [], low, [int(x) for x in at if x > low] + [high]
    for end in marks:
        check = int(crc16(data, np.array([begin]), np.array([end - 2]))[0]) if end - begin > 6 else -1
        if check == int(data[end - 2]) << 8 | int(data[end - 1]):
            starts.append(begin)
            begin = end
    if begin != high:
        raise ValueError("no frame with a valid checksum")
    return np.array(starts, np.int64)


class _Bits:
    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.words = np.ndarray((len(data) + 9,), dtype=">u8", buffer=padded, strides=(1,))
        self.last = len(data) + 8

    def peek(self, pos: np.ndarray) -> np.ndarray:
        """57 bits or more from each bit position, at the top."""
        return self.words[np.minimum(pos >> 3, self.last)].astype(np.uint64) << (pos & 7).astype(U)

    def signed(self, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
        n = np.broadcast_to(n, pos.shape).astype(np.int64)
        x = self.peek(pos).view(np.int64)
        return np.where(n > 0, x >> np.minimum(64 - n, 63), 0)

    def unsigned(self, pos: np.ndarray, n: int) -> np.ndarray:
        return (self.peek(pos) >> U(64 - n)).astype(np.int64)

    def zeros(self, pos: np.ndarray) -> np.ndarray:
        """Zero bits before the next one."""
        x = self.peek(pos) >> U(11)
        found = 1075 - (x.astype(np.float64).view(np.int64) >> 52)
        empty = np.flatnonzero(x == 0)
        if len(empty):
            if np.any(pos[empty] >> 3 >= self.last):
                raise ValueError("the stream ends within a code")
            found[empty] = 48 + self.zeros(pos[empty] + 48)
        return found


def _subframes(bits: _Bits, pos: np.ndarray, n: np.ndarray, bps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (step, lane) of a subframe of each lane, and the bit after it. Lanes come
    in order of falling n."""
    lanes = len(pos)
    head = bits.unsigned(pos, 8)
    if np.any(head >> 7):
        raise ValueError("bad subframe header")
    kind, pos = head >> 1 & 63, pos + 8
    wasted = np.zeros(lanes, np.int64)
    w = np.flatnonzero(head & 1)
    if len(w):
        wasted[w] = bits.zeros(pos[w]) + 1
        pos[w] += wasted[w]
    bps = bps - wasted
    if np.any((kind >= 2) & (kind < 8) | (kind >= 13) & (kind < 32)):
        raise ValueError("reserved subframe type")
    order = np.where(kind >= 32, kind - 31, np.where(kind >= 8, kind - 8, 0))
    if np.any(order > n):
        raise ValueError("more warm-up samples than samples")
    out = np.zeros((int(n[0]), lanes), np.int64)
    same = np.flatnonzero(kind == 0)
    if len(same):
        out[:, same] = bits.signed(pos[same], bps[same])
        pos[same] += bps[same]
    for lane in np.flatnonzero(kind == 1).tolist():
        p = pos[lane] + np.arange(n[lane]) * bps[lane]
        out[: n[lane], lane] = bits.signed(p, bps[lane])
        pos[lane] += n[lane] * bps[lane]
    live = np.flatnonzero(kind >= 8)
    if len(live):
        out[:, live], pos[live] = _predicted(bits, pos[live], n[live], bps[live], kind[live], order[live])
    return out << wasted, pos


def _predicted(bits: _Bits, pos: np.ndarray, n: np.ndarray, bps: np.ndarray, kind: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lanes, most, deepest = len(pos), int(n[0]), int(order.max())
    out = np.zeros((most, lanes), np.int64)
    for t in range(deepest):
        f = np.flatnonzero(order > t)
        out[t, f] = bits.signed(pos[f], bps[f])
        pos[f] += bps[f]
    coef, shift = np.zeros((max(4, deepest), lanes), np.int64), np.zeros(lanes, np.int64)
    fixed = np.flatnonzero(kind < 32)
    coef[:4, fixed] = FIXED[order[fixed]].T
    lpc = np.flatnonzero(kind >= 32)
    if len(lpc):
        precision = bits.unsigned(pos[lpc], 4) + 1
        shift[lpc] = bits.signed(pos[lpc] + 4, 5)
        if np.any(precision == 16) or np.any(shift < 0):
            raise ValueError("bad predictor")
        pos[lpc] += 9
        for j in range(int(order[lpc].max())):
            f = order[lpc] > j
            coef[j, lpc[f]] = bits.signed(pos[lpc[f]], precision[f])
            pos[lpc[f]] += precision[f]
    head = bits.unsigned(pos, 6)
    pos += 6
    if np.any(head >> 5):
        raise ValueError("reserved residual coding")
    width, parts = np.where(head >> 4, 5, 4), 1 << (head & 15)
    each = n // parts
    if np.any(each * parts != n) or np.any(each < order):
        raise ValueError("bad partition order")
    k, raw, opens = np.zeros(lanes, np.int64), np.full(lanes, -1), order.copy()  # where the next partition begins
    opens[order == n] = n[order == n]
    first = int(order.min())
    begin = np.zeros(lanes, np.int64)
    alive = lanes
    next_open = first
    any_raw, depth = False, np.flatnonzero(coef.any(1))
    for t in range(first, most):
        while alive and n[alive - 1] <= t:
            alive -= 1
        a = slice(0, alive)
        if t >= next_open:
            f = np.flatnonzero(opens[a] == t)
            if len(f):
                k[f] = np.where(width[f] == 4, bits.unsigned(pos[f], 4), bits.unsigned(pos[f], 5))
                pos[f] += width[f]
                escape = k[f] == (1 << width[f]) - 1
                raw[f] = -1
                e = f[escape]
                if len(e):
                    raw[e] = bits.unsigned(pos[e], 5)
                    pos[e] += 5
                begin[f] += each[f]
                opens[f] = np.where(begin[f] < n[f], begin[f], most + 1)
            any_raw = bool(np.any(raw[a] >= 0))
            next_open = int(opens[a].min())
            late = bool(np.any(order[a] > t))
        p = pos[a]
        x = bits.peek(p)
        top = x >> U(11)
        q = 1075 - (top.astype(np.float64).view(np.int64) >> 52)
        if not top.all():
            empty = top == 0
            if any_raw:
                empty &= raw[a] < 0
            q[empty] = bits.zeros(p[empty])
        ka = k[a]
        used = q + 1 + ka
        if int(used.max()) <= 57:
            low = (x << (q + 1).astype(U) >> U(1)) >> (63 - ka).astype(U)
        else:
            low = (bits.peek(p + q + 1) >> U(1)) >> (63 - ka).astype(U)
        v = q << ka | low.astype(np.int64)
        r = (v >> 1) ^ -(v & 1)
        if any_raw:
            e = np.flatnonzero(raw[a] >= 0)
            r[e], used[e] = bits.signed(p[e], raw[e]), raw[e]
        pred = np.zeros(alive, np.int64)
        for j in depth:
            if j < t:
                pred += coef[j, a] * out[t - 1 - j, a]
        r += pred >> shift[a]
        if late:
            warm = order[a] > t
            r[warm], used[warm] = out[t, a][warm], 0
            late = bool(np.any(order[a] > t + 1))
        out[t, a] = r
        p += used
    return out, pos


def decode(streams: list[bytes], errors: dict[int, str] | None = None) -> Iterator[tuple[int, dict, list[tuple[int, int, int, bytes]]]]:
    """(stream number, fields, blocks) of each stream; a block is (first sample, samples,
    byte offset in the stream, PCM)."""
    lanes: list[tuple[np.ndarray, int]] = []
    fields: dict[int, dict] = {}
    data = np.frombuffer(b"".join(streams), np.uint8)
    base = np.r_[0, np.cumsum([len(s) for s in streams])].astype(np.int64)
    for i, stream in enumerate(streams):
        try:
            info, at = _metadata(stream)
            seek = info.pop("seek", None)
            if seek is not None and len(seek) and int(seek["n"].astype(np.int64).sum()) == info["total"]:
                begins = base[i] + at + seek["offset"].astype(np.int64)
            else:
                begins = _find_frames(data, int(base[i]) + at, int(base[i + 1])) if at < len(stream) else np.zeros(0, np.int64)
            fields[i] = info
            lanes.append((begins, i))
        except (ValueError, IndexError) as e:
            if errors is None:
                raise ValueError(f"stream {i}: {e}") from e
            errors[i] = str(e)
    begins = np.concatenate([b for b, _ in lanes]) if lanes else np.zeros(0, np.int64)
    if not len(begins):
        yield from ((i, info, []) for i, info in fields.items())
        return
    owner = np.concatenate([np.full(len(b), i) for b, i in lanes])
    ends = np.r_[begins[1:], 0]
    last = np.r_[owner[1:] != owner[:-1], True]
    ends[last] = base[owner[last] + 1]
    h = _headers(data, begins)
    check = crc16(data, begins, ends - 2)
    bad = ~h["ok"] | (check != data[ends - 2].astype(np.uint16) << 8 | data[ends - 1])
    if np.any(bad):
        for i in np.unique(owner[bad]).tolist():
            if errors is None:
                raise ValueError(f"stream {i}: a frame's checksum is wrong")
            errors[i] = "a frame's checksum is wrong"
            fields.pop(i)
    keep = np.flatnonzero(np.isin(owner, list(fields)))
    order = keep[np.argsort(-h["n"][keep], kind="stable")]
    default = np.array([fields[i]["bits"] if i in fields else 8 for i in range(len(streams))])[owner]
    bps = default.copy()
    for c, v in BITS_CODES.items():
        bps[h["bits"] == c] = v
    pcm: dict[int, bytes] = {}
    bits = _Bits(data)
    for mode in np.unique(h["channels"][order]).tolist():
        f = order[h["channels"][order] == mode]
        channels = mode + 1 if mode < 8 else 2
        pos, samples = h["end"][f] * 8, []
        for c in range(channels):
            extra = int(mode in (8, 10) and c == 1 or mode == 9 and c == 0)
            x, pos = _subframes(bits, pos, h["n"][f], bps[f] + extra)
            samples.append(x)
        if mode == 8:
            samples[1] = samples[0] - samples[1]
        elif mode == 9:
            samples[0] = samples[0] + samples[1]
        elif mode == 10:
            mid = samples[0] << 1 | samples[1] & 1
            samples = [mid + samples[1] >> 1, mid - samples[1] >> 1]
        if np.any(-(-pos // 8) != ends[f] - 2):
            raise ValueError("a frame has another length than its codes")
        for j, lane in enumerate(f.tolist()):
            n, width = int(h["n"][lane]), (int(bps[lane]) + 7) // 8
            both = np.stack([s[:n, j] for s in samples], 1)
            kind = {1: "<i1", 2: "<i2", 4: "<i4"}.get(width)
            pcm[lane] = both.astype(kind).tobytes() if kind else both.astype("<i4").view(np.uint8).reshape(n, channels, 4)[:, :, :3].tobytes()
    for begin_, i in lanes:
        if i not in fields:
            continue
        own = np.searchsorted(owner, i) + np.arange(len(begin_))
        first = np.r_[0, np.cumsum(h["n"][own])]
        blocks = [(int(first[j]), int(h["n"][x]), int(begins[x] - base[i]), pcm[x]) for j, x in enumerate(own.tolist())]
        if any(fields[i]["md5"]) and hashlib.md5(b"".join(b[3] for b in blocks)).digest() != fields[i]["md5"]:
            if errors is None:
                raise ValueError(f"stream {i}: the samples' MD5 is wrong")
            errors[i] = "the samples' MD5 is wrong"
            continue
        yield i, fields[i], blocks


def encode_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", multiple: int = 64, block: int = 2048, batch_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_bytes, media): UTF-8 bytes of each text, zero-padded to a positive
    multiple, as the 8-bit samples of a FLAC stream (``text_samples``)."""
    sample_of = text_samples()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", batch_bytes):
                offsets, data = text_buffer(batch.column("text"))
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
                media = encode([t + bytes(max(multiple, -(-len(t) // multiple) * multiple) - len(t)) for t in texts], block, sample_of)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def _groups(media: list[bytes], limit: int) -> Iterator[slice]:
    low, total = 0, 0
    for i, m in enumerate(media):
        if total and total + len(m) > limit:
            yield slice(low, i)
            low, total = i, 0
        total += len(m)
    if low < len(media):
        yield slice(low, len(media))


def decode_blocks(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", on_error: str = "raise", batch_bytes: int = 4 << 20) -> DataFrame:
    """PCM blocks of a column of FLAC streams, a row each. A null stream has none; an empty
    one is no FLAC stream: an error, or with "skip" a row that names it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, media = batch.column(0), batch.column(1).to_pylist()
            for g in _groups(media, batch_bytes):
                errors: dict[int, str] | None = {} if on_error == "skip" else None
                rows = []
                for i, info, blocks in decode(media[g], errors):
                    rows += [(g.start + i, j, first, n, at, info["rate"], info["channels"], info["bits"], pcm, None) for j, (first, n, at, pcm) in enumerate(blocks)]
                rows += [(g.start + i, None, None, None, None, None, None, None, None, e) for i, e in (errors or {}).items()]
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0])), *(pa.array(c, t) for c, t in zip(cols[1:], TYPES))], NAMES)

    TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
    NAMES = ["id", "block", "first_sample", "n_samples", "byte_offset", "rate", "channels", "bits", "pcm", "error"]
    schema = f"id {df.schema[id_col].dataType.simpleString()}, block int, first_sample long, n_samples int, byte_offset long, rate int, channels int, bits int, pcm binary, error string"
    return df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).where("media is not null").mapInArrow(run, schema)


def features(pcm: np.ndarray) -> str:
    """Whole-number features of signed 8-bit samples."""
    x = pcm.astype(np.int64)
    turns = int(np.count_nonzero(np.diff(np.signbit(x))))
    steps = int(np.abs(np.diff(x)).sum())
    return f"sum={int(x.sum())};energy={int((x * x).sum())};turns={turns};steps={steps};peak={int(np.abs(x).max(initial=0))}"


def summarise(media: DataFrame, batch_bytes: int = 4 << 20) -> DataFrame:
    """Digests and features of the samples that streams of ``encode_text`` hold."""
    byte_of = np.empty(256, np.uint8)
    byte_of[text_samples() & 0xFF] = np.arange(256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = batch.column(2).to_pylist()
            for g in _groups(streams, batch_bytes):
                rows = []
                for i, _, blocks in decode(streams[g]):
                    signed = np.frombuffer(b"".join(b[3] for b in blocks), np.int8)
                    payload = byte_of[signed.view(np.uint8)].tobytes()
                    m = streams[g.start + i]
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), features(signed)))
                part = batch.slice(g.start, g.stop - g.start)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows), TYPES))], NAMES)

    TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def op2_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise(stored(encode_text(table(spark, sf_dir, "documents")), "flac", "none"))
