"""Ids of whole texts by way of their pieces, all pieces of a batch looked up at once.

Texts are cut at places where a pre-token of the byte-level (GPT-2) pattern surely ends
and that nothing in front of them can change, so a piece has the same ids alone as in
its text:

* in front of white space that follows something else;
* between a letter and a digit, and between either and a mark; not behind an
  apostrophe, which may begin a contraction;
* behind one line break or tab between two such characters.

Letters, digits and marks are those of ASCII, and Latin-1 letters beyond it; other
characters are only cut off from white space.  A piece of up to 23 bytes is its own key
of three 64-bit numbers; the keys and ids of pieces seen before stay in numpy arrays
behind an open-addressing table, bounded by ``limit``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from logweave.llm.common import mix, text_bytes

LIMIT = 1 << 20
#: Pieces that are looked up at once.
AT_ONCE = 1 << 18
#: Bytes of a piece that is its own key; longer ones, remembered up to LONG bytes, have a dict.
WIDTH, LONG, LONG_LIMIT = 23, 64, 100_000

_OTHER, _LETTER, _DIGIT, _MARK, _QUOTE, _SPACE, _BREAK, _HIGH = range(8)
_NO, _YES, _LOOK_BEFORE, _LOOK_FURTHER = range(4)


def _classes() -> bytes:
    out = bytearray([_OTHER] * 33 + [_MARK] * 94 + [_OTHER] + [_HIGH] * 128)
    for chars, kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", _LETTER), (b"0123456789", _DIGIT), (b"'", _QUOTE), (b" ", _SPACE), (b"\t\n\r", _BREAK)):
        for c in chars:
            out[c] = kind
    return bytes(out)


def _borders() -> bytes:
    """What is between two classes, by 8 * first + second."""
    out = bytearray(256)
    for a in range(8):
        for b in range(8):
            if b in (_SPACE, _BREAK):
                out[8 * a + b] = _LOOK_BEFORE if a == _HIGH else _YES if _LETTER <= a <= _QUOTE else _NO
            elif a == _BREAK:
                out[8 * a + b] = _LOOK_FURTHER if _LETTER <= b <= _QUOTE else _NO
            elif a in (_LETTER, _DIGIT, _MARK) and _LETTER <= b <= _QUOTE and a != b and {a, b} != {_MARK, _QUOTE}:
                out[8 * a + b] = _YES
    return bytes(out)


_CLASSES, _BORDERS = _classes(), _borders()
#: Last bytes of three-byte white space.
_BLANK_ENDS = np.isin(np.arange(256), [*range(0x80, 0x8B), 0x9F, 0xA8, 0xA9, 0xAF])
_KEEP = np.array([[0xFF] * n + [0] * (24 - n) for n in range(WIDTH + 1)], np.uint8).view("<u8")


def borders(data: np.ndarray) -> np.ndarray:
    """Whether a piece may begin at a byte, whatever text it is in."""
    kinds = np.frombuffer(bytearray(data.tobytes().translate(_CLASSES)), np.uint8)
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # the signs of multiplication and division
    kinds[lead] = kinds[lead + 1] = _LETTER
    between = np.frombuffer((kinds[:-1] * np.uint8(8) + kinds[1:]).tobytes().translate(_BORDERS), np.uint8)
    out = np.zeros(len(data), bool)
    out[1:] = between == _YES
    at = np.flatnonzero(between == _LOOK_BEFORE) + 1
    a, b, c = data[at - 3], data[at - 2], data[at - 1]
    out[at] = ~((b == 0xC2) & ((c == 0x85) | (c == 0xA0)) | (a >= 0xE1) & (a <= 0xE3) & ((b == 0x80) | (b == 0x81) | (b == 0x9A)) & _BLANK_ENDS[c])
    at = np.flatnonzero(between == _LOOK_FURTHER) + 1
    before = kinds[at - 2]
    out[at] = (before >= _LETTER) & (before <= _QUOTE)
    return out


class PieceTable:
    """``encode`` gives the ids of many pieces, one after the other, and their numbers."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = LIMIT):
        self.encode, self.limit, self.n, self.used = encode, limit, 0, 0
        self.slots = np.full(1 << 12, -1, np.int32)
        self.keys, self.begins, self.counts, self.ids = np.zeros((0, 3), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)
        self.long: dict[bytes, np.ndarray] = {}

    def __call__(self, column: pa.Array, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column and the number of each row's (null: none); ``whole`` rows are not cut."""
        data, rows = text_bytes(column)
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(len(column), np.int64)
        cut = borders(data)
        for i in [] if whole is None else np.flatnonzero(whole).tolist():
            cut[rows[i]:rows[i + 1]] = False
        cut[rows[:-1][rows[:-1] < rows[1:]]] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.append(starts, len(data)))
        raw, padded = data.tobytes(), np.concatenate([data, np.zeros(24, np.uint8)])
        ids, ends = [], np.zeros(len(starts) + 1, np.int64)
        for a in range(0, len(starts), AT_ONCE):
            found = self._found(raw, padded, starts[a:a + AT_ONCE], sizes[a:a + AT_ONCE])
            counts = self.counts[found]
            own = np.concatenate([[0], np.cumsum(counts)])
            at = np.repeat(self.begins[found] - own[:-1], counts)
            at += np.arange(len(at))
            ids.append(self.ids[at])
            ends[a + 1:a + len(own)] = ends[a] + own[1:]
        return np.concatenate(ids), np.diff(ends[np.searchsorted(starts, rows)])

    def _found(self, raw: bytes, padded: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where each piece is in ``begins`` and ``counts``; valid until the next call."""
        short = np.flatnonzero(sizes <= WIDTH)
        at, size = starts[short], sizes[short]
        keys = np.lib.stride_tricks.sliding_window_view(padded, 24)[at].view("<u8")
        keys &= _KEEP[size]
        keys[:, 2] |= size.astype(np.uint64) << np.uint64(56)
        hashes = self._hash(keys)
        own = self._look_up(keys, hashes)
        new, pieces = np.flatnonzero(own < 0), []
        if len(new):
            new = new[np.argsort(hashes[new])]
            first = np.concatenate([[True], (keys[new[1:]] != keys[new[:-1]]).any(axis=1)])
            own[new] = self.n + np.cumsum(first) - 1
            new = new[first]
            pieces = [raw[a:a + n] for a, n in zip(at[new].tolist(), size[new].tolist())]
        out, long = np.empty(len(starts), np.int64), {}
        out[short] = own
        if len(short) < len(starts):
            other = np.flatnonzero(sizes > WIDTH)
            out[other] = [long.setdefault(raw[a:a + n], self.n + len(pieces) + len(long)) for a, n in zip(starts[other].tolist(), sizes[other].tolist())]
        if pieces or long:
            self._add(keys[new], hashes[new], pieces, list(long))
        return out

    def _add(self, keys: np.ndarray, hashes: np.ndarray, pieces: list[bytes], long: list[bytes]) -> None:
        """New pieces and long ones are put behind those that are held; what there is room for, stays."""
        unknown = [p for p in long if p not in self.long]
        ids, counts = self.encode(pieces + unknown) if pieces or unknown else (np.zeros(0, np.uint16), np.zeros(0, np.int64))
        if long:
            own, end = counts[len(pieces):], int(counts[:len(pieces)].sum())
            fresh = dict(zip(unknown, np.split(ids[end:], np.cumsum(own))))
            parts = [fresh[p] if p in fresh else self.long[p] for p in long]
            ids, counts = np.concatenate([ids[:end], *parts]), np.concatenate([counts[:len(pieces)], np.array([len(x) for x in parts], np.int64)])
            self.long.update((p, fresh[p].copy()) for p in unknown[:max(0, LONG_LIMIT - len(self.long))] if len(p) <= LONG)
        n, kept = len(counts), min(len(pieces), self.limit - self.n)
        self.begins, self.counts, self.ids = _room(self.begins, self.n + n), _room(self.counts, self.n + n), _room(self.ids, self.used + len(ids))
        self.begins[self.n:self.n + n] = self.used + np.cumsum(counts) - counts
        self.counts[self.n:self.n + n] = counts
        self.ids[self.used:self.used + len(ids)] = ids
        if kept:  # frequent pieces come early, so a full table stays as it is
            self.keys = _room(self.keys, self.n + kept)
            self.keys[self.n:self.n + kept] = keys[:kept]
            if 2 * (self.n + kept) > len(self.slots):
                self.slots = np.full(1 << (2 * (self.n + kept)).bit_length(), -1, np.int32)
                self._put(self._hash(self.keys[:self.n]), 0)
            self._put(hashes[:kept], self.n)
            self.n, self.used = self.n + kept, self.used + int(counts[:kept].sum())

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        return mix(keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) + keys[:, 1] * np.uint64(0xD6E8FEB86659FD93) + keys[:, 2] * np.uint64(0xA0761D6478BD642F))

    def _look_up(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        out, last = np.full(len(keys), -1, np.int64), len(self.slots) - 1
        todo, at = np.arange(len(keys)), (hashes & np.uint64(last)).astype(np.int64)
        while len(todo) and self.n:
            held = self.slots[at]
            some = held >= 0
            todo, at, held = todo[some], at[some], held[some].astype(np.int64)
            theirs, ours = self.keys[held], keys[todo]
            same = (theirs[:, 0] == ours[:, 0]) & (theirs[:, 1] == ours[:, 1]) & (theirs[:, 2] == ours[:, 2])
            out[todo[same]] = held[same]
            todo, at = todo[~same], at[~same] + 1 & last
        return out

    def _put(self, hashes: np.ndarray, first: int) -> None:
        last = len(self.slots) - 1
        numbers, at = np.arange(first, first + len(hashes), dtype=np.int32), (hashes & np.uint64(last)).astype(np.int64)
        while len(numbers):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]
            left = self.slots[at] != numbers
            numbers, at = numbers[left], at[left] + 1 & last


def _room(array: np.ndarray, n: int) -> np.ndarray:
    """``array`` with at least n rows."""
    if n <= len(array):
        return array
    out = np.zeros((max(n, 3 * len(array) // 2), *array.shape[1:]), array.dtype)
    out[:len(array)] = array
    return out
