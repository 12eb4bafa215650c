"""Vectorised word hashing over Arrow string columns.

Texts are handled as UTF-8 bytes: both word classes of this package are defined by ASCII ranges, and no
byte of a multi-byte character falls in one, so words are runs of bytes and no per-word Python is needed.
A word becomes a 64-bit hash, a polynomial over random values of its bytes, mixed; two different words of usual length
collide with a probability of about 2**-60, and words made to collide (of a thousand bytes and more) are not guarded against.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, _MASK, 256, dtype=np.uint64)

#: A-Z to a-z, everything else unchanged.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: words of `[^\x20\x09-\x0D]+`
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing
ALNUM = np.ones(256, dtype=bool)
ALNUM[:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False

#: bytes that are hashed at a time: longer spans are added up from pieces, so tables of powers stay this long
_SPAN = 1 << 18
_tables: dict[int, np.ndarray] = {}


def _powers(base: int) -> np.ndarray:
    """base**0 to base**(_SPAN - 1), mod 2**64."""
    have = _tables.get(base)
    if have is None:
        have = np.empty(_SPAN, dtype=np.uint64)
        have[0], done = 1, 1
        while done < _SPAN:
            have[done : 2 * done] = have[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        _tables[base] = have
    return have


def _sum_of_long(word: np.ndarray) -> int:
    """The polynomial of one word of any length."""
    total, powers = 0, _powers(_P)
    for k in range(0, len(word), _SPAN):
        part = _BYTE[word[k : k + _SPAN]]
        total += int((part * powers[: len(part)]).sum(dtype=np.uint64)) * pow(_P, k, 1 << 64)
    return total & _MASK


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of len + 1) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int):
    """Ranges [i, j) of rows whose bytes are about ``most`` at a time; one long row stays whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), then first[1], ..."""
    ends = np.cumsum(n)
    return np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


class Words:
    """The words of some texts, in order: ``start`` and ``end`` byte positions, and ``first[i]:first[i+1]`` of text i.

    ``kind`` says which bytes words are made of, by 0 and other numbers; a word is also cut between kinds a and b where ``cut[a, b]``.
    Without ``fold`` A-Z stay as they are.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray, cut: np.ndarray | None = None, fold: bool = True):
        low = _LOWER[raw] if fold else raw
        inside = kind[low].astype(bool)
        n = len(low)
        if n:
            turn = inside[1:] != inside[:-1]
            if cut is not None:
                own = kind[low]
                turn |= cut.reshape(-1)[own[:-1] * np.uint8(len(cut)) + own[1:]]
            begin, last = inside.copy(), inside.copy()
            begin[1:] &= turn
            last[:-1] &= turn
            cuts = offsets[:-1][offsets[:-1] < n]
            begin[cuts] = inside[cuts]
            stops = offsets[1:][offsets[1:] > 0] - 1
            last[stops] = inside[stops]
            self.start, self.end = np.flatnonzero(begin), np.flatnonzero(last) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offsets)
        self.low = low

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """One uint64 for each word, or for its first ``prefix`` bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        end = self.end if prefix is None else np.minimum(self.end, self.start + prefix)
        out = np.empty(len(end), np.uint64)
        i = 0
        while i < len(end):
            first = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.end, first + _SPAN, side="right")))
            if end[i] - first > _SPAN:  # one word longer than a span
                out[i], j = _sum_of_long(self.low[first : end[i]]), i + 1
            else:
                n = int(end[j - 1]) - first
                run = np.empty(n + 1, dtype=np.uint64)
                run[0] = 0
                np.cumsum(_BYTE[self.low[first : first + n]] * _powers(_P)[:n], out=run[1:])
                at = self.start[i:j] - first
                out[i:j] = (run[end[i:j] - first] - run[at]) * _powers(_P_INV)[at]
            i = j
        return mix(out + (end - self.start).astype(np.uint64))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all ``width`` consecutive entries of h (len(h) - width + 1 of them)."""
    m = len(h) - width + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(_P) + h[k : k + m]
    return mix(out)


def field(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column of a batch, or that field of its column ``_row``, which holds whole rows."""
    return batch.column(name) if name in batch.schema.names else batch.column("_row").field(name)


def whole_rows(docs):
    """docs as one column ``_row``, so that names of its columns clash with nothing an operator adds."""
    from pyspark.sql import functions as F

    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
