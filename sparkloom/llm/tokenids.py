"""Token ids in files of adaptively coded blocks.

Texts are encoded with a given tokenizer and laid end to end, in order of their ids, an
end id after each. Every ``block`` ids form a block that is coded on its own and carries
a checksum, so any block can be read without the others. A block first says which ids it
has and how often, by the range coder, then its ids by their numbers among those. Odds mix
three predictions: places that ids still take up (order 0), all that followed the id before
(order 1), and what last followed the two before (order 2). A block is coded in phases, which
are dealt over ``_ways`` coders; what its phases so far tell holds for a whole phase: counts,
the weights of the three for each class of contexts, and what order 0 leaves to the others.
So phases are coded from tables, without a step for each id but those of the range coder, and
decoded by a search of the list of order 1. Blocks and their ways are numpy lanes: one id of
each a step. Whole numbers, single operations on floats and sums of whole floats alone are
used, so that files decode alike everywhere.

File format: a row a segment, (file, segment, content). Content is ``TIDS``, then 32-bit
counts (version, documents, blocks, ids a block), a directory of documents (64-bit ids,
a byte each that says whether it is null, 32-bit token counts), blocks (32-bit ids,
bytes, CRC-32 of the ids) and their bytes, then a CRC-32 of all before. Segments end with
a document and number their file's ids in order; files hold ranges of document ids.

Defined results. Names of special tokens in a text are spelled out like other text with
``spell_special``, and get the special ids without, which is the tokenizer's own default
and what op5 and the pipeline use. Null or empty text: the end id alone. Equal ids: in order of their
texts. A null id comes first. Empty table: no segments. Other columns are ignored. Ids
of documents are cast to 64-bit integers; a damaged segment raises ``ValueError``.
"""

from __future__ import annotations

import math
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.bytewords import slices
from sparkloom.llm.shared import new_path, setting, CLEANUP, table

SEGMENT = "file int, segment int, n_documents int, n_tokens long, content binary"
#: Odds are parts of 2 ** ``SCALE``; a coder's range is at least ``LEAST`` between symbols.
SCALE, LEAST = 24, 1 << 40
#: Parts of odds that order 0 always keeps are 1 in 2 ** ``KEPT``.
KEPT = 6
#: Contexts of order 2 in a block; larger ones share them.
PAIRS = 2048
#: Ids in a block at most, and the bits of a number of one.
MOST, BITS, END = 1 << 13, 13, (1 << 31) - 1
#: Ranges of a block that are coded one after another, as parts of 16.
PHASES = [0, 1, 2, 3, 4, 5, 6, 8, 10, 13, 16]
#: Classes of a block's contexts: 8 of order 1 by how often one was there, in each 4 by how much
#: what followed differed, in each 4 of order 2 by how sure its guess is.
CLASSES = 128
CLASS = np.minimum(np.frexp(np.arange(MOST + 1).astype(np.float64))[1], 7) * 16
#: What a weight is multiplied by to deal it out to so many.
PART = (1 << SCALE) // np.maximum(np.arange(MOST + 1), 1)


class Encoder:
    """A range coder of many lanes, 20 bits a digit; carries are put right at the end. Room
    for digits grows with what the fullest lane has."""

    def __init__(self, lanes: int, room: int = 1024):
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, LEAST << 20, np.int64)
        self.out, self.at = np.zeros((lanes, room), np.int32), np.zeros(lanes, np.int64)

    def take(self, a, unit, cum, freq):
        self.low[a] += unit * cum
        self.range[a] = unit * freq

    def renew(self, a):
        go = np.flatnonzero(self.range[a] < LEAST)
        lanes = go if isinstance(a, slice) else a[go]
        while len(lanes):
            low, at = self.low[lanes], self.at[lanes]
            self._room(int(at.max()) + 1)
            self.out[lanes, at] = low >> 40
            self.at[lanes] = at + 1
            self.low[lanes] = (low & LEAST - 1) << 20
            self.range[lanes] = r = self.range[lanes] << 20
            lanes = lanes[r < LEAST]

    def _room(self, need: int) -> None:
        if need > (have := self.out.shape[1]):
            self.out = np.concatenate([self.out, np.zeros((len(self.at), max(have // 2, need - have)), np.int32)], 1)

    def finish(self) -> list[bytes]:
        """A last digit names a number of the range, with nothing but zeros after it."""
        lanes, most = np.arange(len(self.at)), int(self.at.max()) + 2
        self._room(most)
        out = self.out[:, :most]
        out[lanes, self.at] = self.low + (LEAST - 1) >> 40
        while (carry := out >> 20).any():
            out &= 0xFFFFF
            out[:, :-1] += carry[:, 1:]
        two = out[:, : most // 2 * 2].astype(np.int64).reshape(len(lanes), -1, 2)
        raw = (two[:, :, 0] << 20 | two[:, :, 1]).astype(">i8").view(np.uint8).reshape(len(lanes), -1, 8)[:, :, 3:]
        return [row[:n].tobytes() for row, n in zip(raw, (self.at // 2 + 1).tolist())]


class Decoder:
    def __init__(self, coded: list[bytes]):
        n = len(coded)
        self.range = np.full(n, LEAST << 20, np.int64)
        count = np.array([len(c) // 5 for c in coded], np.int64)
        raw = np.frombuffer(b"".join(coded), np.uint8).reshape(-1, 5)
        two = np.zeros((len(raw), 8), np.uint8)
        two[:, 3:] = raw
        two = two.view(">i8").ravel().astype(np.int64)
        width = int(count.max(initial=0)) + 2
        data = np.zeros((n, width, 2), np.int32)
        at = np.arange(len(two)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(np.arange(n) * width, count)
        data.reshape(-1, 2)[at] = np.stack([two >> 20, two & 0xFFFFF], 1)
        self.data, self.at = data.ravel(), np.arange(n) * (2 * width)
        self.code, self.end = np.zeros(n, np.int64), len(self.data) - 1
        for _ in range(3):
            self.code = self.code << 20 | self.data[self.at]
            self.at += 1

    def value(self, a, unit):
        return self.code[a] // unit

    def take(self, a, unit, cum, freq):
        self.code[a] -= unit * cum
        self.range[a] = unit * freq

    def renew(self, a):
        go = np.flatnonzero(self.range[a] < LEAST)
        lanes = go if isinstance(a, slice) else a[go]
        while len(lanes):
            at = self.at[lanes]
            self.code[lanes] = self.code[lanes] << 20 | self.data[np.minimum(at, self.end)]
            self.at[lanes] = at + 1
            self.range[lanes] = r = self.range[lanes] << 20
            lanes = lanes[r < LEAST]


def _counted(coder, lanes, table, row, symbol):
    """Codes a symbol by its counts in a row alone. Lanes may share a row."""
    c = table.take(row, axis=0)
    cum = np.cumsum(c, axis=1, dtype=np.int32)
    unit = coder.range[lanes] // cum[:, -1]
    if symbol is None:
        value = np.minimum(coder.value(lanes, unit), cum[:, -1] - 1).astype(np.int32)
        symbol = np.count_nonzero(cum <= value[:, None], axis=1)
    i = np.arange(len(lanes))
    own = c[i, symbol]
    coder.take(lanes, unit, cum[i, symbol] - own, own)
    coder.renew(lanes)
    np.add.at(table.reshape(-1), row * table.shape[1] + symbol, np.int32(6))
    return symbol


def _even(coder, lanes, size, value):
    """Codes a number below ``size``, all alike."""
    unit = coder.range[lanes] // size
    if value is None:
        value = np.minimum(coder.value(lanes, unit), size - 1)
    coder.take(lanes, unit, value, 1)
    coder.renew(lanes)
    return value


def _number(coder, lanes, table, row, x):
    """Codes a number by the counts of how many bits it has, then those bits. Returns both."""
    kind = _counted(coder, lanes, table, row, None if x is None else np.frexp(x.astype(np.float64))[1].astype(np.int64))
    top = np.left_shift(1, np.maximum(kind - 1, 0))
    rest = _even(coder, lanes, top, None if x is None else np.where(kind > 0, x - top, 0))
    return kind, np.where(kind > 0, top + rest, 0)


def _known(coder, ways: int, kinds: int, have: np.ndarray, steps: np.ndarray | None, counts: np.ndarray | None):
    """Codes which ids each block has, by the steps between them, and how often each comes.
    kinds: of numbers, by their bits; have: how many ids each block has; steps, counts: (block,
    number), decoded if None."""
    blocks, most = len(have), int(have.max())
    decoding = steps is None
    if decoding:
        steps, counts = np.zeros((blocks, most), np.int64), np.zeros((blocks, most), np.int64)
    first, second = np.ones((blocks, kinds), np.int32), np.ones((blocks * kinds, kinds), np.int32)
    lane = np.arange(blocks * ways)
    block, way = lane // ways, lane % ways
    for t in range(-(-most // ways)):
        a = np.flatnonzero(t * ways + way < have[block])
        g, j = block[a], t * ways + way[a]
        kind, step = _number(coder, a, first, g, None if decoding else steps[g, j])
        _, more = _number(coder, a, second, g * kinds + kind, None if decoding else counts[g, j] - 1)
        if decoding:
            steps[g, j], counts[g, j] = step, more + 1
    return steps, counts


class Counts:
    """What the ids of blocks so far tell: ``seen`` (block, place) are their numbers, ``below``
    (block, number) how many of the block's ids have a lower number, ``width`` numbers."""

    def __init__(self, seen: np.ndarray, below: np.ndarray, width: int, decoding: bool):
        blocks, n = seen.shape
        g = np.arange(blocks)[:, None]
        seen = seen.astype(np.int32)
        self.pairs = n = max(0, n - 1)
        one, own = seen[:, :-1], seen[:, 1:]
        at = g * width + own
        left = below.take(at + 1) > below.take(at)  # what has no place left can't come
        self.keys = np.sort(np.where(left, one << BITS | own, END), axis=1)
        # a list of what followed for each context of order 1, in order of numbers
        self.times = np.bincount((g * width + one)[left], minlength=blocks * width)
        self.start = (np.cumsum(self.times.reshape(blocks, width), axis=1) + g * n).ravel() - self.times
        new = np.ones(self.keys.shape, bool)
        np.not_equal(self.keys[:, 1:], self.keys[:, :-1], out=new[:, 1:])
        starts = np.flatnonzero(new)
        kept = self.keys.ravel()[starts]
        kept = (kept >> BITS) + starts // max(n, 1) * width
        different = np.bincount(kept[self.keys.ravel()[starts] < END], minlength=blocks * width)
        self.kind = CLASS.take(self.times) + 4 * ((2 * different <= self.times).astype(np.int64) + (4 * different <= self.times) + ((different == 1) & (self.times > 1)))
        size = np.diff(starts, append=blocks * n)
        self.size = np.append(np.repeat(size.astype(np.int32), size), np.int32(0))
        if decoding:  # at each place of a list its number, what is below it, and where its number begins
            self.next = self.keys & MOST - 1
            self.below = np.append(below.take(g * width + self.next, mode="clip"), np.int32(0))
            self.next, self.first = self.next.ravel(), np.append(np.repeat(starts, size), 0)
        # what last followed each context of order 2, and how surely
        self.guess = np.zeros(blocks * PAIRS, np.int32)
        if n > 1:
            h = (g * PAIRS + pair(seen[:, 1:-1], seen[:, :-2])).ravel()
            last, own = np.zeros(blocks * PAIRS, np.int32), seen[:, 2:].ravel()
            last[h] = own
            hit = last.take(h) == own
            hits, all_ = np.bincount(h[hit], minlength=len(last)), np.bincount(h, minlength=len(last))
            sure = np.where(3 * hits > 2 * all_, np.minimum(hits, 3), 0).astype(np.int32)
            at = np.repeat(np.arange(blocks) * width, PAIRS) + last
            self.guess = last << 2 | sure * (below.take(at + 1) > below.take(at))

    def of(self, g: int, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In block g, where the list of each context has each symbol, and how often; want: both in one number."""
        keys = self.keys[g]
        at = np.searchsorted(keys, want)
        if not self.pairs:
            return at, np.zeros(len(at), np.int32)
        found = keys.take(at, mode="clip") == want
        at += g * self.pairs
        return at, self.size.take(at) * found


def pair(one, two):
    return (one * 0x9E35 + two * 0x85EB >> 3) & PAIRS - 1


class Mixer:
    """Weights of orders 1 and 2 in each class of a block's contexts; order 0 has what they leave."""

    def __init__(self, blocks: int):
        n, conf = (1 << np.arange(8)[:, None, None]) >> 1, np.arange(4)[None, None, :]
        like = np.array([6, 4, 3, 1])[None, :, None]
        one = (1 << SCALE) - (1 << SCALE - KEPT)
        w2 = one * 2 * conf // (2 * conf + 1 + n // like)
        w1 = (one - w2) * n // (n + like)
        self.w1, self.w2 = (np.tile(x.ravel(), blocks) for x in (w1, w2))

    def deal(self, places: np.ndarray) -> None:
        """Deals order 0 out over so many places of each block."""
        self.q0, self.q2 = (((1 << SCALE) - self.w1 - self.w2) // np.repeat(places, CLASSES)).astype(np.int32), self.w2.astype(np.int32)

    def q(self, cls, times):
        """Parts of the odds for one place of order 0, one of order 1, and the guess."""
        return self.q0.take(cls), (self.w1.take(cls) * PART.take(times) >> SCALE).astype(np.int32), self.q2.take(cls)

    def learn(self, told, cls, symbol, own1, own2, own):
        """Each weight moves to its share in the odds that symbols got; told: what others than
        order 0 told of each symbol so far, in 1024th."""
        told += np.bincount(symbol, np.floor((own1 + own2) * 1024.0 / own), len(told)).astype(np.int64)
        n = 8 + np.bincount(cls, minlength=len(self.w1))
        for w, x in ((self.w1, own1), (self.w2, own2)):
            got = np.bincount(cls, np.floor(x * 1024.0 / own), len(w)).astype(np.int64) << SCALE - 10
            w[:] = (8 * w + got) // n
            w -= w >> KEPT


def _ways(m: int) -> int:
    """Coders that a block is dealt over."""
    return 8 if m >= 1 << 11 else 1


def _padded(n: int) -> int:
    unit = 16 * _ways(n)
    return -(-n // unit) * unit


def _code(coder: Encoder, x: np.ndarray, counts: np.ndarray, have: np.ndarray) -> None:
    """Codes numbers (block, place). The first of a coder's range have a context of their block's
    own, the number after its last."""
    blocks, m = x.shape
    ways, mixer, width = _ways(m), Mixer(blocks), counts.shape[1] + 1
    told = np.zeros(blocks * width, np.int64)
    for a, b in zip(PHASES, PHASES[1:]):
        a, b = a * m // 16, b * m // 16
        part = x[:, a:b].reshape(blocks, ways, -1)
        one, two = (np.tile(have.astype(np.int32)[:, None, None], (1, *part.shape[1:])) for _ in range(2))
        one[:, :, 1:], two[:, :, 2:] = part[:, :, :-1], part[:, :, :-2]
        cums, freqs = np.zeros((part.shape[2], blocks * ways), np.int32), np.zeros((part.shape[2], blocks * ways), np.int32)
        learnt = []
        below_, places = _below(counts, x[:, :a], told)
        seen = Counts(x[:, :a], below_, width, False)
        mixer.deal(places)
        for low in range(0, blocks, 32):  # what follows takes several times a part
            g = np.arange(low, min(blocks, low + 32))
            s, c1 = part[g], one[g]
            row = g[:, None, None] * width
            times, start = seen.times.take(row + c1), seen.start.take(row + c1)
            guess = seen.guess.take(g[:, None, None] * PAIRS + pair(c1, two[g]))
            conf, guess = guess & 3, guess >> 2
            cls = g[:, None, None] * CLASSES + seen.kind.take(row + c1) + conf
            q0, q1, q2 = mixer.q(cls, times)
            found = [seen.of(i, want) for i, want in zip(g.tolist(), (c1 << BITS | s).reshape(len(g), -1))]
            at, size = (np.stack([f[k] for f in found]).reshape(s.shape) for k in (0, 1))
            under, own0 = below_.take(row + s), below_.take(row + s + 1)
            own0 -= under
            own2 = q2 * (guess == s)
            own = own0 * q0 + size * q1 + own2
            cum = under * q0 + np.where(times > 0, at - start, 0).astype(np.int32) * q1 + q2 * (guess < s)
            lanes = slice(low * ways, low * ways + len(g) * ways)
            cums[:, lanes], freqs[:, lanes] = cum.reshape(-1, part.shape[2]).T, own.reshape(-1, part.shape[2]).T
            if b < m:
                learnt.append([y.ravel() for y in (cls, row + s, size * q1, own2, own)])
        if b < m:
            mixer.learn(told, *map(np.concatenate, zip(*learnt)))
        all_ = slice(None)
        for cum, own in zip(cums, freqs):
            coder.take(all_, coder.range >> SCALE, cum, own)
            coder.renew(all_)


def _decode(coder: Decoder, m: int, counts: np.ndarray, have: np.ndarray) -> np.ndarray:
    """The numbers (block, place) that ``_code`` coded."""
    blocks, width = len(counts), counts.shape[1] + 1
    ways, mixer = _ways(m), Mixer(blocks)
    x = np.zeros((blocks, m), np.int32)
    g = np.arange(blocks * ways) // ways
    row, base, base_c = g * width, g * PAIRS, g * CLASSES
    a_, told = slice(None), np.zeros(blocks * width, np.int64)
    for a, b in zip(PHASES, PHASES[1:]):
        a, b = a * m // 16, b * m // 16
        below_, places = _below(counts, x[:, :a], told)
        slots = np.repeat(np.tile(np.arange(width, dtype=np.int16), blocks), np.diff(below_, append=0).clip(0))
        base_s, most = (np.cumsum(places) - places)[g], places[g] - 1
        seen = Counts(x[:, :a], below_, width, True)
        mixer.deal(places)
        out = np.zeros(((b - a) // ways, blocks * ways), np.int32)
        one = two = have[g]
        learnt = []
        for t in range(len(out)):
            context = row + one
            times, start = seen.times.take(context), seen.start.take(context)
            guess = seen.guess.take(base + pair(one, two))
            cls = base_c + seen.kind.take(context) + (guess & 3)
            q0, q1, q2 = mixer.q(cls, times)
            guess >>= 2
            unit = coder.range >> SCALE
            value = np.minimum(coder.code // unit, (1 << SCALE) - 1).astype(np.int32)
            i = _place(seen.below, start, times, value, q0, q1, q2, below_.take(row + guess))
            # the symbol at the last place that starts at or below the value, or else one of order 0 after it
            last = start + i - 1
            s = np.where(i > 0, seen.next.take(last, mode="clip") if len(seen.next) else 0, -1)
            free = value - i * q1
            off = np.flatnonzero(free >= below_.take(row + s + 1) * q0 + q2 * (guess <= s))
            f, h = free[off], guess[off]
            f0, z, z2 = q0[off], below_.take(row[off] + h), q2[off]
            passed = f >= below_.take(row[off] + h + 1) * f0 + z2
            at = (f - z2 * passed) // f0
            within = ~passed & (f >= z * f0)
            at = np.where(within & (z2 > 0), z, np.minimum(at, most[off]))
            s[off] = slots.take(base_s[off] + at)
            hit = np.ones(len(s), bool)
            hit[off] = False
            at = last.copy()
            at[at < 0] = 0
            size = seen.size.take(at) * hit
            under1 = np.where(hit, seen.first.take(at) - start, i)
            under = below_.take(row + s)
            own2 = q2 * (guess == s)
            own1 = size * q1
            own = (below_.take(row + s + 1) - under) * q0 + own1 + own2
            coder.take(a_, unit, under * q0 + under1 * q1 + q2 * (guess < s), own)
            coder.renew(a_)
            out[t] = s
            two, one = one, s
            if b < m:
                learnt.append((cls, row + s, own1, own2, own))
        if b < m:
            mixer.learn(told, *map(np.concatenate, zip(*learnt)))
        x[:, a:b] = out.T.reshape(blocks, -1)
    return x


def _place(below, start, times, value, q0, q1, q2, guess):
    """How many places of each list start at or below the value."""
    found = np.zeros(len(start), np.int32)
    step = 1 << int(times.max(initial=0)).bit_length() >> 1
    for least in (64, 8, 1):  # the long lists first
        if step < least:
            continue
        a = np.flatnonzero(times >= least)
        f, begin, n, v, p0, p1, p2, h = (x.take(a) for x in (found, start, times, value, q0, q1, q2, guess))
        n = n.astype(np.int32)
        while step >= least:
            i = f + np.int32(step - 1)
            d = below.take(begin + i, mode="clip")
            at = d * p0
            at += i * p1
            at += p2 * (h < d)
            f += np.int32(step) * ((at <= v) & (i < n))
            step >>= 1
        found[a] = f
    return found


def _numbers(grid: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For ids (block, place) which of its block's ids each is, from 0 in their order; for each block those
    ids, and how often each comes."""
    order = np.argsort(grid.astype(np.uint16) if grid.max(initial=0) < 1 << 16 else grid, axis=1, kind="stable")
    s = np.take_along_axis(grid, order, 1)
    new = np.ones(s.shape, bool)
    new[:, 1:] = s[:, 1:] != s[:, :-1]
    out = np.zeros(s.shape, np.int32)
    np.put_along_axis(out, order, np.cumsum(new, axis=1, dtype=np.int32) - 1, 1)
    return out, [row[n] for row, n in zip(s, new)], [np.diff(np.append(np.flatnonzero(n), len(n))) for n in new]


def _alike(n: int, most: int) -> int:
    """Blocks a pass, so that passes are alike."""
    return max(1, -(-n // max(1, round(n / most))))


def _below(counts: np.ndarray, seen: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many places the numbers before each one take up in order 0 of their block, and those
    before the end: (block, number) laid end to end; and each block's places. What is still to
    come takes up one each, less the share that other orders ``told`` of it, and one at least."""
    blocks, width = len(counts), counts.shape[1] + 1
    out = np.zeros((blocks, width), np.int32)
    at = (np.arange(blocks)[:, None] * (width - 1) + seen).ravel()
    had = np.bincount(at, minlength=counts.size).reshape(counts.shape)
    left = counts - had
    places = np.maximum(left - left * told.reshape(blocks, width)[:, :-1] // (1024 * had + 512), np.minimum(left, 1))
    np.cumsum(places, axis=1, out=out[:, 1:])
    return out.ravel(), out[:, -1].astype(np.int64)


def code_blocks(ids: np.ndarray, block: int, lanes: int = 256) -> list[tuple[int, int, bytes]]:
    """(ids, CRC-32 of the ids as little-endian 32-bit integers, bytes) of each block."""
    if not 1 <= block <= MOST:
        raise ValueError(f"a block holds from 1 to {MOST} ids")
    out = []
    kinds = 18 if int(ids.max(initial=0)) < 1 << 16 else 34
    step = block * _alike(-(-len(ids) // block), lanes)
    for low in range(0, len(ids), step):
        part = ids[low : low + step]
        own = min(block, len(part))
        m, blocks, full = _padded(own), -(-len(part) // own), len(part) // own
        grid = np.zeros((blocks, m), np.int64 if int(part.max()) >> 31 else np.int32)
        grid[:full, :own] = part[: full * own].reshape(full, own)
        grid[:full, own:] = grid[:full, own - 1 : own]  # a block is filled up with its last id
        if full < blocks:
            rest = part[full * own :]
            grid[full, : len(rest)], grid[full, len(rest) :] = rest, rest[-1]
        numbers, names, counts = np.zeros(grid.shape, np.int32), [], []
        for first in range(0, blocks, 32):  # what sorting takes is several times a part
            numbers[first : first + 32], n, c = _numbers(grid[first : first + 32])
            names += n
            counts += c
        have = np.array([len(n) for n in names])
        steps, often = np.zeros((blocks, have.max()), np.int64), np.zeros((blocks, have.max()), np.int64)
        for i, (n, c) in enumerate(zip(names, counts)):
            steps[i, : len(n)], often[i, : len(n)] = np.diff(n.astype(np.int64), prepend=-1) - 1, c
        ways = _ways(m)
        coder = Encoder(blocks * ways)
        _known(coder, ways, kinds, have, steps, often)
        _code(coder, numbers, often, have)
        coded, raw = coder.finish(), part.astype("<u4").tobytes()
        for i in range(blocks):
            plain, c = raw[4 * i * own : 4 * (i + 1) * own], coded[i * ways : (i + 1) * ways]
            out.append((len(plain) // 4, zlib.crc32(plain), struct.pack(f"<{ways + 3}H", m, kinds, have[i], *[len(x) // 5 for x in c]) + b"".join(c)))
    return out


def decode_blocks(blocks: list[tuple[int, int, bytes]], lanes: int = 256) -> np.ndarray:
    """The ids of the blocks, one after another."""
    parts: list[np.ndarray | None] = [None] * len(blocks)
    kind = [struct.unpack_from("<HH", x) for _, _, x in blocks]
    order = sorted(range(len(blocks)), key=lambda i: kind[i])
    step = _alike(len(order), lanes)
    while order:
        m, kinds = kind[order[0]]
        group = [i for i in order[:step] if kind[i] == (m, kinds)]
        order = order[len(group) :]
        ways, coded, have = _ways(m), [], []
        for i in group:
            _, _, n, *sizes = struct.unpack_from(f"<{ways + 3}H", blocks[i][2])
            have.append(n)
            at = 2 * ways + 6
            for k in sizes:
                coded.append(blocks[i][2][at : at + 5 * k])
                at += 5 * k
        coder, have = Decoder(coded), np.array(have)
        steps, counts = _known(coder, ways, kinds, have, None, None)
        names = np.cumsum(steps + 1, axis=1) - 1
        numbers = _decode(coder, m, counts, have)
        grid = np.take_along_axis(names, numbers, 1).astype("<u4")
        for row, i in zip(grid, group):
            parts[i] = row[: blocks[i][0]]
            if zlib.crc32(parts[i].tobytes()) != blocks[i][1]:
                raise ValueError(f"block {i}: the checksum is wrong")
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def pack_segment(ids: list, counts: np.ndarray, tokens: np.ndarray, block: int) -> bytes:
    blocks = code_blocks(tokens, block)
    head = b"TIDS" + struct.pack("<IIII", 3, len(ids), len(blocks), block)
    head += np.array([0 if i is None else i for i in ids], "<i8").tobytes() + bytes(i is None for i in ids) + counts.astype("<u4").tobytes()
    head += np.array([(n, len(x), c) for n, c, x in blocks], "<u4").tobytes()
    body = head + b"".join(x for _, _, x in blocks)
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_segment(content: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, their token counts, and all tokens."""
    if content[:4] != b"TIDS" or struct.unpack("<I", content[-4:])[0] != zlib.crc32(memoryview(content)[:-4]):
        raise ValueError("a damaged segment")
    version, docs, n_blocks, _ = struct.unpack_from("<IIII", content, 4)
    if version != 3:
        raise ValueError(f"version {version} of the format is not known")
    at = 20
    ids = np.frombuffer(content, "<i8", docs, at).tolist()
    missing = content[at + 8 * docs : at + 9 * docs]
    counts = np.frombuffer(content, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    directory = np.frombuffer(content, "<u4", 3 * n_blocks, at).reshape(-1, 3).tolist()
    at += 12 * n_blocks
    blocks = []
    for n, size, crc in directory:
        blocks.append((n, crc, content[at : at + size]))
        at += size
    return [None if m else i for i, m in zip(ids, missing)], counts, decode_blocks(blocks)


#: A single space between two characters that are no white space.
CUT = re.compile(r"(?<=\S) (?=\S)")
BESIDE = re.compile(r" \s|\s ")


class Pieces:
    """Ids of texts by way of a bounded store of pieces. A byte-level tokenizer of this kind
    never joins a letter, digit or mark with a space after it, so a text may be cut before
    any single space between two characters that are no white space.

    The store's keys are pieces without their space, and a space with a text's first piece.
    When it holds half of ``most`` it becomes the older one, of which pieces that come again are taken over."""

    def __init__(self, path: str, most: int = 400_000, spell_special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = spell_special
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)  # each id stands for as many bytes as its name has characters
        for name, i in vocabulary.items():
            self.bytes_of[i] = len(name)
        self.most = most
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, keys: set[str]) -> None:
        """Pieces that may stand side by side are encoded as one text, and told apart by
        the bytes that their ids stand for."""
        old = keys & self.older.keys()
        self.known.update(zip(old, map(self.older.__getitem__, old)))
        joined, alone = [], []
        for k in keys.difference(old):
            (alone if k[0] == " " or k[-1].isspace() else joined).append(k)
        for low in range(0, len(joined), 256):
            group = joined[low : low + 256]
            text = " " + " ".join(group)
            ids = np.array(self._encode([text])[0], np.int32)
            sizes = [len(k) for k in group] if text.isascii() else [len(k.encode()) for k in group]
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(sizes) + np.arange(1, len(group) + 1)) + 1
            self._keep(group, ids, ends)
        for k, ids in zip(alone, self._encode([k[1:] if k[0] == " " else " " + k for k in alone])):
            self._keep([k], np.array(ids, np.int32), np.array([len(ids)]))

    def _keep(self, keys: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        raw = ids.astype("<u4").tobytes()
        stops = (4 * ends).tolist()
        self.known.update(zip(keys, [raw[a:b] for a, b in zip([0, *stops], stops)]))

    @staticmethod
    def cut(text: str) -> list[str]:
        """The keys of the text's pieces; cut at every space, which is no use if one has
        white space beside it."""
        words = text.split(" ")
        words[0] = " " + words[0]
        return words

    @staticmethod
    def apart(keys) -> bool:
        """Whether no key would stand beside white space where it was cut."""
        return not BESIDE.search(" ".join(["", *(k[1:] if k[:1] == " " else k for k in keys), ""]))

    def ids(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, the end id after each, and how many each has."""
        if len(self.known) > self.most // 2:
            self.known, self.older = {}, self.known
        known, end = self.known, struct.pack("<I", end_id)
        words, stops = [], []
        for text in texts:
            if text:
                words += self.cut(text)
            stops.append(len(words))
        got = list(map(known.get, words))
        missing = [i for i, x in enumerate(got) if x is None]
        if missing:
            new = set(map(words.__getitem__, missing))
            if not self.apart(new):
                return self._with_care(texts, end)
            self._add(new)
            for i in missing:
                got[i] = known[words[i]]
        coded = [b"".join(got[a:b]) + end for a, b in zip([0, *stops], stops)]
        return self._joined(coded)

    def _with_care(self, texts: list[str], end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Texts with white space beside a space somewhere."""
        cut = [CUT.split(" " + t if t[:1].isspace() else t) if t else [] for t in texts]
        for t, c in zip(texts, cut):
            if c and not t[0].isspace():
                c[0] = " " + c[0]
        new = set().union(*cut).difference(self.known)
        if new:
            self._add(new)
        return self._joined([b"".join(map(self.known.__getitem__, c)) + end for c in cut])

    @staticmethod
    def _joined(coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(coded), "<u4"), np.array([len(c) // 4 for c in coded], np.int64)


@lru_cache(maxsize=1)
def pieces_of(path: str, spell_special: bool) -> Pieces:
    """The store of a Python worker, which tasks that follow each other share."""
    return Pieces(path, spell_special=spell_special)


def _files(rows: DataFrame, max_bytes: int) -> int:
    """So many that none holds much over ``max_bytes`` of text, and that all cores are busy."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, math.ceil(total / max_bytes), min(math.ceil(total / (2 << 20)), 4 * rows.sparkSession.sparkContext.defaultParallelism))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block: int = 4096, segment_tokens: int = 4 << 20, spell_special: bool = True, max_bytes: int = 128 << 20) -> str:
    """Writes files of ranges of document ids, in order."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(_files(rows, max_bytes), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, file, segment = pieces_of(tokenizer, spell_special), TaskContext.get().partitionId(), 0
        ids, counts, tokens, have = [], [], [], 0
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                out, n = pieces.ids([t or "" for t in batch.column("text").to_pylist()], end_id)
                ids += batch.column("doc_id").to_pylist()
                counts.append(n)
                tokens.append(out.astype(np.int32))
                have += len(out)
                if have >= segment_tokens:
                    yield made(file, segment, ids, counts, tokens)
                    ids, counts, tokens, have, segment = [], [], [], 0, segment + 1
        if have:
            yield made(file, segment, ids, counts, tokens)

    def made(file, segment, ids, counts, tokens) -> pa.RecordBatch:
        n, all_ = np.concatenate(counts), np.concatenate(tokens)
        content = pack_segment(ids, n, all_, block)
        return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([segment], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([len(all_)], pa.int64()), pa.array([content], pa.binary())], ["file", "segment", "n_documents", "n_tokens", "content"])

    with setting(docs.sparkSession, **CLEANUP):
        ordered.mapInArrow(run, SEGMENT).write.option("compression", "none").parquet(path)
    return path


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, in the files' order
    of ids; only segments' counts are gathered for ``start``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, segment, content in zip(*(batch.column(c).to_pylist() for c in ("file", "segment", "content"))):
                ids, counts, tokens = unpack_segment(content)
                ends = np.cumsum(counts, dtype=np.int64)
                raw, n = memoryview(tokens.tobytes()), len(ids)
                cells = [raw[4 * a : 4 * b] for a, b in zip((ends - counts).tolist(), ends.tolist())]
                for low in range(0, n, 10_000):
                    part = slice(low, low + 10_000)
                    cols = [pa.array([file] * len(cells[part]), pa.int32()), pa.array([segment] * len(cells[part]), pa.int32()), pa.array(ids[part], pa.int64()), pa.array((ends - counts)[part]), pa.array(counts[part].astype(np.int64)), pa.array([zlib.crc32(c) for c in cells[part]], pa.int64())]
                    if with_ids:
                        cols.append(pa.array([np.frombuffer(c, "<u4") for c in cells[part]], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(cols, NAMES[: len(cols)])

    NAMES = ["file", "segment", "doc_id", "own", "n_tokens", "ids_crc32", "ids"]
    files = spark.read.schema(SEGMENT).parquet(path)
    before = Window.orderBy("file", "segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("file", "segment", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("before"))
    docs = files.select("file", "segment", "content").mapInArrow(run, "file int, segment int, doc_id long, own long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    return docs.join(offsets, ["file", "segment"]).select("doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), spell_special=False)


def encoded(docs: DataFrame, tokenizer: str = public_tokenizers.path("byte_bpe_50k.json"), spell_special: bool = True) -> DataFrame:
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, new_path(spark, "tokens"), tokenizer, spell_special=spell_special))
