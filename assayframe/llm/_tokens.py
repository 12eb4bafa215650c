"""Whole texts to token ids with a tokenizer file of the ``tokenizers`` library.

A tokenizer whose pre-tokenizer drops white space never joins characters across it, so a text's ids are those of its
pieces between blanks, one after the other; nor across the borders of ASCII letters, digits and signs, but for apostrophes
and the signs of added tokens, which stay in their piece. ``PieceEncoder`` hashes all pieces of many texts at once and looks them up
in a table of pieces met before (``_Table``, arrays of fixed size); ids are then gathered by numpy, so Python sees only
new pieces. A new piece of Latin letters is cut as the file's own pre-tokenizer cuts it and its parts go to the file's
BPE model; any other piece goes through the whole tokenizer. ``encoder`` takes this way only for files of that make,
others encode each text in one call. Pieces are told apart by 64-bit hashes (see _words).
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

from assayframe.llm._words import Words, slices, spread, string_buffers

#: pieces a worker keeps, and parts of them; beyond that it starts anew
CACHE_PIECES, CACHE_PARTS = 2_000_000, 100_000
_CHUNK = 1 << 18
#: kinds of bytes that pieces are cut between: letters, signs and digits of ASCII; the rest (4) stays with what is beside it
_PIECE = np.full(256, 4, np.uint8)
_PIECE[[0x20, 0x09, 0x0A, 0x0D]] = 0
_PIECE[0x61:0x7B] = _PIECE[0x41:0x5B] = 1
_PIECE[0x30:0x3A] = 3
_SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # not the apostrophe, which begins parts such as 's
_CUT = np.zeros((5, 5), bool)
_CUT[1:4, 1:4] = ~np.eye(3, dtype=bool)
_CUT[3, 3] = True
#: printable Latin characters, without those that change length or meaning when lower-cased
_PLAIN = regex.compile(r"[!-~¡-įı-ňŊ-ſ]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level models use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Ids of whole texts, one call a text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.n_ids = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if self.n_ids <= 1 << 16 else np.dtype("<u4")

    def encode(self, text: str | None) -> np.ndarray:
        return np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, dtype=self.kind)

    def encode_all(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, one after the other, and how many each has."""
        found = [self.encode(t.as_py()) for t in column]
        return np.concatenate([np.zeros(0, self.kind), *found]), np.array([len(f) for f in found], np.int64)


class _Table:
    """Hashes of pieces to their ids: open addressing in arrays of fixed size, at most half full."""

    def __init__(self, most: int, kind: np.dtype):
        bits = max(4, (2 * most).bit_length())
        self.most, self.shift, self.mask = most, np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.place = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.start, self.size = np.zeros(most, np.int64), np.zeros(most, np.int32)
        self.n, self.ids, self.used = 0, np.zeros(4 * most, kind), 0

    def slots(self, h: np.ndarray) -> np.ndarray:
        """Where each hash is, or would go."""
        slot = (h >> self.shift).astype(np.int64)
        key = self.key[slot]
        far = np.flatnonzero((key != h) & (key != 0))
        while len(far):
            slot[far] = (slot[far] + 1) & self.mask
            key = self.key[slot[far]]
            far = far[(key != h[far]) & (key != 0)]
        return slot

    def add(self, h: np.ndarray, found: list[list[int]]) -> None:
        """Distinct new hashes, at most as many as there is room for, with their ids."""
        n, ids = len(h), np.fromiter(chain.from_iterable(found), self.ids.dtype)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), self.ids.dtype)])
        sizes = np.fromiter(map(len, found), np.int64, n)
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[self.n : self.n + n], self.size[self.n : self.n + n] = self.used + np.cumsum(sizes) - sizes, sizes
        left = np.arange(n)
        while len(left):  # of those that want the same slot one gets it, the others look on
            slot, first = np.unique(self.slots(h[left]), return_index=True)
            self.key[slot], self.place[slot] = h[left[first]], self.n + left[first]
            left = np.delete(left, first)
        self.n, self.used = self.n + n, self.used + len(ids)

    def __len__(self) -> int:
        return self.n


class PieceEncoder(Encoder):
    """Ids of whole texts by their pieces between blanks."""

    def __init__(self, path: str, pattern: str, pieces: int):
        super().__init__(path)
        self.pattern = regex.compile(pattern)
        self.letters = _byte_letters()
        added = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values()).encode()
        self.bytes = _PIECE.copy()
        self.bytes[[b for b in _SIGNS if b not in added]] = 2
        if any(65 <= b < 91 or 48 <= b < 58 or b in b" \n\r\t" for b in added):
            raise ValueError(f"{path} has added tokens that pieces could cut through")
        self.added = regex.compile("|".join(regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        self.tokenize = self.tokenizer.model.tokenize
        self.parts: dict[str, list[int]] = {}
        self.table = _Table(pieces, self.kind)

    def _part(self, part: str) -> list[int]:
        """Ids of what the pre-tokenizer leaves as one part."""
        got = self.parts.get(part)
        if got is None:
            got = [t.id for t in self.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(self.letters))]
            if len(self.parts) >= CACHE_PARTS:
                self.parts.clear()
            self.parts[part] = got
        return got

    def _piece(self, raw: bytes) -> list[int]:
        if raw.isalpha():  # ASCII letters alone
            return [t.id for t in self.tokenize(raw.lower().decode())]
        piece = raw.decode()
        if _PLAIN.fullmatch(piece) and not self.added.search(piece) and (piece.isascii() or unicodedata.is_normalized("NFC", piece)):
            return list(chain.from_iterable(map(self._part, self.pattern.findall(piece.lower()))))
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.large_string()))[0]

    def encode_all(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, offsets = string_buffers(column)
        ids, counts = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        for i, j in slices(offsets, _CHUNK):
            own = raw[offsets[i] : offsets[j]]
            words = Words(own, offsets[i : j + 1] - offsets[i], self.bytes, _CUT)
            # A-Z and a-z are the same in pieces that have nothing else; any other piece is as it is
            other = np.concatenate([[0], np.cumsum(self.bytes[own] == 4, dtype=np.int32)])
            mixed = np.flatnonzero(other[words.end] > other[words.start])
            at = spread(words.start[mixed], (words.end - words.start)[mixed])
            words.low[at] = own[at]
            hashes = words.hashes()
            # a text may have more pieces than the table holds
            for a in range(0, len(words.start), self.table.most) or (0,):
                b = min(a + self.table.most, len(words.start))
                got, sizes = self._ids_of(own, words.start[a:b], words.end[a:b], hashes[a:b])
                ids.append(got)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                part = np.diff(ends[np.clip(words.first, a, b) - a])
                if a:
                    counts[-1] = counts[-1] + part
                else:
                    counts.append(part)
        return np.concatenate(ids), np.concatenate(counts)

    def _ids_of(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, and how many each has."""
        h = np.maximum(h, np.uint64(1))  # 0 marks an empty slot
        table = self.table
        slot = table.slots(h)
        new = np.flatnonzero(table.key[slot] != h)
        if len(new):
            keys, first = np.unique(h[new], return_index=True)
            if len(table) + len(keys) > table.most:
                table = self.table = _Table(table.most, self.kind)
                keys, new = np.unique(h, return_index=True)
                first = np.arange(len(keys))
            at = new[first]
            table.add(keys, [self._piece(raw[a:b].tobytes()) for a, b in zip(start[at].tolist(), end[at].tolist())])
            slot = table.slots(h)
        place = table.place[slot]
        sizes = table.size[place].astype(np.int64)
        return table.ids[spread(table.start[place], sizes)], sizes


@lru_cache(maxsize=2)
def encoder(path: str, pieces: int = CACHE_PIECES) -> Encoder:
    """The encoder of a tokenizer's file; a worker keeps it, with up to ``pieces`` pieces, for its later tasks."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    parts = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split, kinds = parts[0], [n.get("type") for n in (made.get("normalizer") or {}).get("normalizers", [])]
    if (
        kinds == ["NFC", "Replace", "Lowercase"]
        and [p.get("type") for p in parts] == ["Split", "ByteLevel"]
        and (split.get("behavior"), split.get("invert")) == ("Removed", True)
        and r"[^\s" in split["pattern"].get("Regex", "")
        and not parts[1].get("add_prefix_space")
        and made.get("post_processor") is None
    ):
        return PieceEncoder(path, split["pattern"]["Regex"], pieces)
    return Encoder(path)
