"""A context-mixing range coder for arrays of token ids.

A block is a self-contained byte string: model and coder start anew in each, and it ends in checksums. The ids of a
block are cut into equally long lanes that one shared model codes side by side, one id of every lane a step, so each
step is a few numpy operations over all lanes. Three predictions drive the arithmetic coding of an id: the id last
seen after the same two ids (order 2), the frequencies of all ids seen so far after the same one id (order 1), and the
frequencies of all ids so far (order 0). They are mixed into one distribution whose weights adapt to how often each was
right lately at that degree of confidence. Frequencies are counted anew after a growing number of steps. The encoder
updates the model just as the decoder does, with ids that both have.

Layout, little-endian: ``IDC2``, n, lanes, steps, n_ids, crc32 of the ids (as uint32), then the words in each lane
(uint32 each), all lanes' 16-bit words, and the crc32 of everything before.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"IDC2"
#: block size that callers aim at, ids a lane at least, and most lanes
BLOCK_IDS, LANE_IDS, LANES = 1 << 22, 256, 16_384
_TOTAL_BITS = 24
_TOTAL = 1 << _TOTAL_BITS
_SLOTS_BITS = 18
_LEVELS = 8
#: order-0 frequencies are halved beyond this sum, so an id's share of 1 << _SHARE_BITS, and of what is left to order 0, is at least one
_ORDER0_MOST = 1 << 19
_SHARE_BITS = 22
_ORDER0_LEAST = 1 << 22
#: shares of order 1, and the least weight of it where a context has been seen
_CONTEXT_BITS = 16
_ORDER1_LEAST = 1 << 18
#: what one id adds to its frequency; frequencies are counted anew after 1 / _GROWTH of all steps so far
_STEP, _GROWTH = 8, 4


def _searched(table: np.ndarray, wanted: np.ndarray, side: str = "left") -> np.ndarray:
    """np.searchsorted, which is faster for sorted values."""
    order = np.argsort(wanted)
    out = np.empty(len(wanted), np.int64)
    out[order] = np.searchsorted(table, wanted[order], side=side)
    return out


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a // b for whole numbers under 2**53, by the faster division of floats, whose rounding is undone."""
    out = (a.astype(np.float64) / b).astype(np.int64)
    out -= out * b > a
    return out


class _Model:
    """Entries of the order-2 table are ``id * _LEVELS + confidence``; pairs of order 1 are ``context * n_ids + id``, sorted."""

    def __init__(self, lanes: int, n_ids: int):
        self.n_ids = n_ids
        self.two = np.zeros(1 << _SLOTS_BITS, np.int64)
        self.c1 = np.zeros(lanes, np.int64)
        self.mixed = np.zeros(lanes, np.int64)
        self.seen = np.ones(n_ids, np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.late: list[np.ndarray] = []
        self.came: list[np.ndarray] = []
        self.age, self.next = 0, 1
        # outcomes for each pair of confidences: order 2 right, only order 1 right, neither
        self.right = np.tile(np.array([1.0, 1.0, 2.0]), (_LEVELS * _LEVELS, 1))
        self._refresh()

    def _refresh(self) -> None:
        if self.late:
            late = np.concatenate(self.late)
            self.seen += _STEP * np.bincount(late % self.n_ids, minlength=self.n_ids)
            late.sort()
            first = np.flatnonzero(np.append(True, late[1:] != late[:-1]))
            new, times = late[first], np.diff(np.append(first, len(late)))
            at = np.searchsorted(self.pairs, new)
            known = np.flatnonzero(at < len(self.pairs))
            known = known[self.pairs[at[known]] == new[known]]
            self.times[at[known]] += times[known]
            fresh = np.ones(len(new), bool)
            fresh[known] = False
            self.pairs, self.times = np.insert(self.pairs, at[fresh], new[fresh]), np.insert(self.times, at[fresh], times[fresh])
        while self.seen.sum() > _ORDER0_MOST:
            self.seen = (self.seen >> 1) | 1
        below = np.zeros(self.n_ids + 1, np.int64)
        np.cumsum(self.seen, out=below[1:])
        #: cumulative shares of 1 << _SHARE_BITS, at least one for each id
        self.below = (below << _SHARE_BITS) // below[-1]
        # cumulative shares of 1 << _CONTEXT_BITS in each context, at least one for each id seen there
        context = self.pairs // self.n_ids
        self.ids = self.pairs - context * self.n_ids
        start = np.flatnonzero(np.append(True, context[1:] != context[:-1])[: len(context)])
        size = np.diff(np.append(start, len(context)))
        total = np.concatenate([[0], np.cumsum(self.times)])
        all_ = total[start + size] - total[start]
        place = np.arange(len(context)) - np.repeat(start, size)
        free = (1 << _CONTEXT_BITS) - np.repeat(size, size)
        low = (total[:-1] - np.repeat(total[start], size)) * free // np.repeat(all_, size) + place
        self.low = (context << _CONTEXT_BITS) + low
        self.high = np.append(self.low[1:], 0)
        self.high[start + size - 1] = (context[start] + 1) << _CONTEXT_BITS
        #: how well a context is known: 0 if not at all
        self.known = np.zeros(self.n_ids, np.int64)
        # frequent contexts with few ids after them are the sure ones
        self.known[context[start]] = 1 + np.minimum((2 * np.log2(1 + all_ / size)).astype(np.int64), _LEVELS - 2)
        if self.right.max() > 60_000:
            self.right = self.right * 0.5 + 0.05
        share = self.right[:, :2] / self.right.sum(axis=1, keepdims=True)
        weights = (share * (_TOTAL - _ORDER0_LEAST - _ORDER1_LEAST - 2)).astype(np.int64) + 1
        self.w2 = np.ascontiguousarray(weights[:, 0])
        self.w1 = np.where(np.arange(_LEVELS * _LEVELS) % _LEVELS > 0, weights[:, 1] + _ORDER1_LEAST, 0)

    def predict(self):
        """The prediction of order 2, its weight, and that of orders 2 and 1, of _TOTAL."""
        slot = (self.c1 * 40503 + self.mixed) & ((1 << _SLOTS_BITS) - 1)
        two = self.two[slot]
        s2 = two & (_LEVELS - 1)
        context = s2 * _LEVELS + self.known[self.c1]
        w2 = self.w2[context]
        self.at = slot, s2, context
        return two >> 3, w2, w2 + self.w1[context]

    def within(self, lanes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether ids were seen after the contexts of these lanes, and their shares there."""
        c1 = self.c1[lanes]
        pairs = c1 * self.n_ids + ids
        if not len(self.pairs):
            return np.zeros(len(ids), bool), pairs, pairs
        at = _searched(self.pairs, pairs)
        at[at == len(self.pairs)] = 0
        base = c1 << _CONTEXT_BITS
        return self.pairs[at] == pairs, self.low[at] - base, self.high[at] - base

    def update(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """hit2: order 2 was right; hit1: else, order 1 has the id."""
        slot, s2, context = self.at
        self.came.append(context * 3 + np.where(hit2, 0, 2 - hit1))
        self.two[slot] = (ids << 3) + np.minimum(s2 + 1, _LEVELS - 1) * hit2
        self.late.append(self.c1 * self.n_ids + ids)
        self.mixed = self.c1 * 2654435761 >> 7
        self.c1 = ids
        self.age += 1
        if self.age >= self.next:
            self.next = self.age + 1 + self.age // _GROWTH
            self.right += np.bincount(np.concatenate(self.came), minlength=_LEVELS * _LEVELS * 3).reshape(-1, 3)
            self._refresh()
            self.late, self.came = [], []


_WINDOW, _LEAST = np.uint64((1 << 48) - 1), np.uint64(1 << 32)


def encode(ids: np.ndarray, n_ids: int) -> bytes:
    """A block of ids, each below n_ids."""
    ids = np.asarray(ids, dtype=np.int64)
    n = len(ids)
    lanes = min(LANES, max(1, n // LANE_IDS))
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    columns = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = _Model(lanes, n_ids)
    low = np.zeros(lanes, np.uint64)
    width = np.full(lanes, (1 << 48) - 1, np.uint64)
    out = np.zeros((lanes, 2 * steps + 4), np.uint16)
    at = np.zeros(lanes, np.int64)
    every = np.arange(lanes)

    def put(rows: np.ndarray) -> None:
        out[rows, at[rows]] = (low[rows] >> np.uint64(32)).astype(np.uint16)
        at[rows] += 1
        low[rows] = (low[rows] << np.uint64(16)) & _WINDOW

    for column in columns:
        p2, w2, both = model.predict()
        hit2 = column == p2
        begin, end, hit1 = np.zeros(lanes, np.int64), w2.copy(), np.zeros(lanes, bool)
        one = np.flatnonzero(~hit2)
        found, low1, high1 = model.within(one, column[one])
        hit1[one] = found
        other, one, low1, high1 = one[~found], one[found], low1[found], high1[found]
        base, in1 = w2[one], both[one] - w2[one]
        begin[one], end[one] = base + (low1 * in1 >> _CONTEXT_BITS), base + (high1 * in1 >> _CONTEXT_BITS)
        base, rest = both[other], _TOTAL - both[other]
        begin[other] = (rest * model.below[column[other]] >> _SHARE_BITS) + base
        end[other] = (rest * model.below[column[other] + 1] >> _SHARE_BITS) + base
        size, begin = (end - begin).view(np.uint64), begin.view(np.uint64)
        unit = width >> np.uint64(_TOTAL_BITS)
        low += unit * begin
        width = unit * size
        over = np.flatnonzero(low > _WINDOW)
        if len(over):
            low[over] &= _WINDOW
            back = at[over] - 1
            while len(over):  # carry into words already put
                out[over, back] += np.uint16(1)
                more = out[over, back] == 0
                over, back = over[more], back[more] - 1
        short = np.flatnonzero(width < _LEAST)
        while len(short):
            put(short)
            width[short] <<= np.uint64(16)
            short = short[width[short] < _LEAST]
        model.update(column, hit2, hit1)
    for _ in range(3):
        put(every)
    used = np.arange(out.shape[1]) < at[:, None]
    head = MAGIC + struct.pack("<QIIII", n, lanes, steps, n_ids, zlib.crc32(ids.astype("<u4").tobytes()))
    body = head + at.astype("<u4").tobytes() + out[used].astype("<u2").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def decode(block: bytes) -> np.ndarray:
    """The ids of a block; ValueError if a checksum is wrong."""
    if block[:4] != MAGIC or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("damaged block of ids")
    n, lanes, steps, n_ids, crc = struct.unpack_from("<QIIII", block, 4)
    have = np.frombuffer(block, "<u4", lanes, 28).astype(np.int64)
    words = np.concatenate([np.frombuffer(block[:-4], "<u2", offset=28 + 4 * lanes), np.zeros(1, "<u2")]).astype(np.uint64)
    at = np.concatenate([[0], np.cumsum(have)[:-1]]).astype(np.int64)
    code = (words[at] << np.uint64(32)) | (words[at + 1] << np.uint64(16)) | words[at + 2]
    at += 3
    model = _Model(lanes, n_ids)
    width = np.full(lanes, (1 << 48) - 1, np.uint64)
    out = np.empty((steps, lanes), np.int64)
    for step in range(steps):
        p2, w2, both = model.predict()
        unit = width >> np.uint64(_TOTAL_BITS)
        target = np.minimum(_quotient(code.view(np.int64), unit.view(np.int64)), _TOTAL - 1)
        ids, begin, end = p2.copy(), np.zeros(lanes, np.int64), w2.copy()
        one = np.flatnonzero((target >= w2) & (target < both))
        if len(one):
            base, in1, key = w2[one], (both - w2)[one], model.c1[one] << _CONTEXT_BITS
            share = _quotient(((target[one] - base + 1) << _CONTEXT_BITS) - 1, in1)
            found = _searched(model.low, key + share, "right") - 1
            begin1, end1 = base + ((model.low[found] - key) * in1 >> _CONTEXT_BITS), base + ((model.high[found] - key) * in1 >> _CONTEXT_BITS)
            ids[one], begin[one], end[one] = model.ids[found], begin1, end1
        zero = np.flatnonzero(target >= both)
        if len(zero):
            base = both[zero]
            left = _TOTAL - base
            share = ((((target[zero] - base + 1) << _SHARE_BITS) - 1).astype(np.float64) / left).astype(np.int64)
            found = _searched(model.below, share, "right") - 1
            # the quotient may be off by its rounding: step to the id whose interval holds the target
            begin0, end0 = (left * model.below[found] >> _SHARE_BITS) + base, (left * model.below[found + 1] >> _SHARE_BITS) + base
            while True:
                off = (target[zero] >= end0).astype(np.int64) - (target[zero] < begin0)
                if not off.any():
                    break
                found += off
                begin0, end0 = (left * model.below[found] >> _SHARE_BITS) + base, (left * model.below[found + 1] >> _SHARE_BITS) + base
            ids[zero], begin[zero], end[zero] = found, begin0, end0
        size, begin = (end - begin).view(np.uint64), begin.view(np.uint64)
        code -= unit * begin
        width = unit * size
        short = np.flatnonzero(width < _LEAST)
        while len(short):
            code[short] = (code[short] << np.uint64(16)) | words[at[short]]
            at[short] += 1
            width[short] <<= np.uint64(16)
            short = short[width[short] < _LEAST]
        hit1 = np.zeros(lanes, bool)
        hit1[one] = True
        model.update(ids, ids == p2, hit1)
        out[step] = ids
    ids = out.T.reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("block of ids decodes to other ids")
    return ids
