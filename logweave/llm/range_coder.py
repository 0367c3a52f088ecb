"""A context-mixing range coder for token ids, many blocks side by side.

Ids are coded in two passes.  The first learns a model of all blocks that are coded
together, which is kept in front of them; the second codes every block by it from an
empty history, so a block can be decoded alone with its model.  The model mixes three
predictions of an id:

* order 2: the id that most often follows this pair of ids (hashed), with a confidence;
* order 1: the id that most often follows this id, likewise;
* order 0: the ids' frequencies.

The mixture is linear and exact: an id's share is its order 0 share times what the
weights of the other two leave, plus the weight of each that names it.  Weights are
the hit rates by the confidences of both orders and by whether they agree.  Every id
takes one step of the coder.  It is carry-less: 64-bit low and range, a 32-bit word
leaves when the range falls under 2**32, and a range that straddles a word's border
is cut there.  numpy runs the same step of many blocks ("lanes") at once.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

NO_ID = 0xFFFF
#: Sums of the order 0 frequencies, of the weights, and of both: the parts of an interval.
IDS_BITS, WEIGHT_BITS = 18, 8
IDS_TOTAL, WEIGHTS = 1 << IDS_BITS, 1 << WEIGHT_BITS
#: Bits that a context takes in a model, and so has to save.
CONTEXT_BITS = 48
#: Ids whose shares are worked out at once.
CHUNK = 1 << 16
_BITS = np.uint64(IDS_BITS + WEIGHT_BITS)
_TOP = np.uint64(1 << 32)
_LOW = np.uint64((1 << 32) - 1)
_S32 = np.uint64(32)
_ID, _S16 = np.uint32(0xFFFF), np.uint32(16)
_SIZES = struct.Struct("<3I")


def _pair(prev2: np.ndarray, prev1: np.ndarray) -> np.ndarray:
    """A 16-bit hash of two ids (uint32)."""
    return (prev2 * np.uint32(0x9E3779B1) + prev1 * np.uint32(0x85EBCA6B)) >> np.uint32(16)


def _before(ids: np.ndarray, a: int, b: int, back: int) -> np.ndarray:
    """The ids ``back`` steps before the steps a to b - 1 (steps x lanes); 0 before the first."""
    out = np.zeros((b - a, ids.shape[1]), np.uint32)
    skip = max(0, back - a)
    out[skip:] = ids[a + skip - back:max(a + skip, b) - back]
    return out


def _best(keys: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts that save more than they take, what each names, and its confidence, from context << 16 | id of every place
    and each id's share by order 0."""
    keys.sort()
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
    count, keys = np.diff(np.append(starts, len(keys))), keys[starts]
    context = keys >> np.uint32(16)
    groups = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])[:len(keys)])
    if not len(groups):
        return (np.zeros(0, np.uint16),) * 3
    total = np.add.reduceat(count, groups)
    top = np.maximum.reduceat(count << 16 | (keys & np.uint32(0xFFFF)).astype(np.int64), groups)
    hits, plain = top >> 16, share[top & 0xFFFF]
    rate = np.minimum(hits / total, 1 - 1 / WEIGHTS)
    kept = hits * np.log2(rate / plain + 1 - rate) + (total - hits) * np.log2(1 - rate) > CONTEXT_BITS
    return context[groups][kept].astype(np.uint16), (top[kept] & 0xFFFF).astype(np.uint16), (1 + 14 * hits[kept] // total[kept]).astype(np.uint16)


class Model:
    """What all blocks of one call share: frequencies, what contexts name, and weights."""

    def __init__(self, present, share, contexts, weights):
        self.present, self.share, self.contexts, self.weights = present, share, contexts, weights
        self.freq = np.zeros(1 << 16, np.int64)
        self.freq[present] = share
        self.cum = np.cumsum(self.freq) - self.freq
        self.named = []
        for (context, ids, confidence), place in zip(contexts, (20, 16)):
            table = np.full(1 << 16, NO_ID, np.uint32)
            table[context] = ids.astype(np.uint32) | confidence.astype(np.uint32) << np.uint32(place)
            self.named.append(table)
        self._weigh(weights)

    def _weigh(self, weights: np.ndarray) -> None:
        self.weights = weights
        self.w1, self.w2 = weights.astype(np.int64)
        self.rest = WEIGHTS - self.w1 - self.w2

    @classmethod
    def of(cls, ids: np.ndarray) -> Model:
        """Learned from ids by steps x lanes (at least one)."""
        steps, lanes = ids.shape
        count = np.bincount(ids.ravel(), minlength=1 << 16)
        present = np.flatnonzero(count)
        share = 1 + count[present] * (IDS_TOTAL - len(present)) // ids.size
        share[np.argmax(share)] += IDS_TOTAL - share.sum()
        prev1 = _before(ids, 0, steps, 1)
        keys = prev1 << np.uint32(16) | ids
        first = _best(keys.ravel(), count / ids.size)
        keys = _pair(_before(ids, 0, steps, 2), prev1) << np.uint32(16) | ids
        del prev1
        model = cls(present.astype(np.uint16), share.astype(np.uint32), [first, _best(keys.ravel(), count / ids.size)], np.zeros((2, 512), np.uint8))
        del keys
        seen = np.zeros(2048, np.int64)
        for a, b in _chunks(steps, lanes):
            c1, c2, kind = model.predict(_before(ids, a, b, 2), _before(ids, a, b, 1))
            x = ids[a:b]
            seen += np.bincount((kind << 2 | (x == c1) << 1 | (x == c2)).ravel(), minlength=2048)
        kinds, seen = np.arange(512), seen.reshape(512, 4)
        both = np.maximum(seen.sum(axis=1), 1)
        agree = kinds >> 8 == 1  # one of them then carries the whole weight
        w1 = WEIGHTS * (seen[:, 2] + seen[:, 3]) // both * (kinds >> 4 & 15 > 0) * ~agree
        w2 = WEIGHTS * (seen[:, 1] + seen[:, 3]) // both * (kinds & 15 > 0)
        w2 = np.minimum(w2, WEIGHTS - 1)
        model._weigh(np.stack([np.minimum(w1, WEIGHTS - 1 - w2), w2]).astype(np.uint8))
        return model

    def predict(self, prev2: np.ndarray, prev1: np.ndarray):
        """What order 1 and order 2 name, and the kind of the pair of predictions."""
        e1, e2 = self.named[0].take(prev1), self.named[1].take(_pair(prev2, prev1))
        c1, c2 = (e1 & _ID).astype(np.int64), (e2 & _ID).astype(np.int64)
        kind = ((e1 | e2) >> _S16).astype(np.int64)
        kind += np.left_shift(c1 == c2, 8, dtype=np.int64)
        return c1, c2, kind

    def shares(self, ids: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the parts of the ids of steps a to b - 1 begin, and their sizes."""
        c1, c2, kind = self.predict(_before(ids, a, b, 2), _before(ids, a, b, 1))
        x = ids[a:b].astype(np.int64)
        w1, w2, rest = self.w1[kind], self.w2[kind], self.rest[kind]
        start = rest * self.cum[x] + (w1 * (x > c1) + w2 * (x > c2) << IDS_BITS)
        size = rest * self.freq[x] + (w1 * (x == c1) + w2 * (x == c2) << IDS_BITS)
        return start.astype(np.uint64), size.astype(np.uint64)

    def pack(self) -> bytes:
        parts = [self.present, self.share, *(x for own in self.contexts for x in own), self.weights]
        raw = b"".join(np.ascontiguousarray(x, x.dtype.newbyteorder("<")).tobytes() for x in parts)
        return _SIZES.pack(len(self.present), *(len(own[0]) for own in self.contexts)) + zlib.compress(raw, 6)

    @classmethod
    def unpack(cls, data: bytes) -> Model:
        n, *sizes = _SIZES.unpack(data[:_SIZES.size])
        raw, at = zlib.decompress(data[_SIZES.size:]), 0

        def take(kind, size):
            nonlocal at
            at += size * np.dtype(kind).itemsize
            return np.frombuffer(raw, kind, size, at - size * np.dtype(kind).itemsize)

        present, share = take("<u2", n), take("<u4", n)
        contexts = [tuple(take("<u2", size) for _ in range(3)) for size in sizes]
        return cls(present, share, contexts, take("u1", 1024).reshape(2, 512))


def _chunks(steps: int, lanes: int):
    step = max(1, CHUNK // lanes)
    return ((a, min(steps, a + step)) for a in range(0, steps, step))


def encode_by(model: Model, ids: np.ndarray) -> list[bytes]:
    """``ids`` (steps x lanes, at most 65,536) as one byte string a lane."""
    steps, lanes = ids.shape
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    left, words = [], []
    for a, b in _chunks(steps, lanes):
        for start, size in zip(*model.shares(ids, a, b)):
            r = rng >> _BITS
            start *= r
            low += start
            np.multiply(r, size, out=rng)
            i = np.flatnonzero(rng < _TOP)
            if len(i):
                l = low[i]
                left.append(i.astype(np.uint16))
                words.append((l >> _S32).astype(np.uint32))
                low[i] = l << _S32
                rng[i] = np.minimum(rng[i], _TOP - (l & _LOW)) << _S32
    every = np.arange(lanes, dtype=np.uint16)
    lane = np.concatenate([*left, every, every])
    words = np.concatenate([*words, (low >> _S32).astype(np.uint32), (low & _LOW).astype(np.uint32)])[np.argsort(lane, kind="stable")].astype("<u4").tobytes()
    ends = (4 * np.cumsum(np.bincount(lane, minlength=lanes))).tolist()
    return [words[x:y] for x, y in zip([0, *ends], ends)]


def decode_by(model: Model, blocks: list[bytes], steps: int) -> np.ndarray:
    """The first ``steps`` ids of every block, steps x lanes."""
    lanes = len(blocks)
    words = np.frombuffer(b"".join(blocks) + bytes(8), "<u4").astype(np.uint64)
    pos = np.cumsum([0] + [len(b) // 4 for b in blocks])[:-1]
    ahead = words.take(pos) << _S32 | words.take(pos + 1, mode="clip")  # the code word's place above low
    pos += 2
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    at_share = np.repeat(model.present, model.share)
    most = np.uint64((1 << IDS_BITS + WEIGHT_BITS) - 1)
    prev2 = prev1 = np.zeros(lanes, np.uint32)
    out = np.zeros((steps, lanes), np.uint16)
    cum, freq, rests, inverse = model.cum, model.freq, model.rest, 1.0 / model.rest
    first, both = model.w1 << IDS_BITS, model.w1 + model.w2 << IDS_BITS
    for t in range(steps):
        c1, c2, kind = model.predict(prev2, prev1)
        w1, w, rest = first.take(kind), both.take(kind), rests.take(kind)
        r = rng >> _BITS
        v = np.minimum(ahead // r, most).astype(np.int64)
        # Without the weights, which lie in front of the shares of the ids they add to, the lesser id's first.
        lesser = np.where(c1 <= c2, w1, w - w1)
        y = v - rest * cum.take(np.minimum(c1, c2))
        v -= np.minimum(np.maximum(y, 0, out=y), lesser, out=y)
        y = v - rest * cum.take(np.maximum(c1, c2))
        v -= np.minimum(np.maximum(y, 0, out=y), w - lesser, out=y)
        x = at_share.take(((v + 0.5) * inverse.take(kind)).astype(np.int64))  # exact: v + 0.5 is no multiple of rest, nor near one
        out[t] = x
        x = x.astype(np.int64)
        w -= w1
        start, size = cum.take(x), freq.take(x)
        start *= rest
        start += w1 * (x > c1)
        start += w * (x > c2)
        size *= rest
        size += w1 * (x == c1)
        size += w * (x == c2)
        step = start.view(np.uint64) * r
        ahead -= step
        low += step
        np.multiply(r, size.view(np.uint64), out=rng)
        i = np.flatnonzero(rng < _TOP)
        if len(i):
            l, p = low.take(i), pos.take(i)
            low[i] = l << _S32
            rng[i] = np.minimum(rng.take(i), _TOP - (l & _LOW)) << _S32
            ahead[i] = ahead.take(i) << _S32 | words.take(p, mode="clip")
            pos[i] = p + 1
        prev2, prev1 = prev1, out[t].astype(np.uint32)
    return out


def encode(ids: np.ndarray) -> list[bytes]:
    """``ids`` (lanes x steps; under 65535) as one byte string a lane, each with a model of its own."""
    out = []
    for own in ids:
        own = np.ascontiguousarray(own[:, None], np.uint16)
        model = Model.of(own)
        packed = model.pack()
        out.append(struct.pack("<I", len(packed)) + packed + encode_by(model, own)[0])
    return out


def decode(blocks: list[bytes], steps: int) -> np.ndarray:
    """The first ``steps`` ids of every block that ``encode`` made."""
    out = np.zeros((len(blocks), steps), np.int64)
    for own, block in zip(out, blocks):
        size = 4 + struct.unpack("<I", block[:4])[0]
        own[:] = decode_by(Model.unpack(block[4:size]), [block[size:]], steps)[:, 0]
    return out
