"""Byte-level BPE encoding and decoding through a sentencepiece model.

The model file is serialised here, directly from the rank file: each vocabulary entry
is one piece whose bytes are mapped to 256 private code points, scored by its
negative rank, with identity normalisation and no white space handling.  The best
score first is then the lowest rank first, which is byte-level BPE.  The text is cut
into pre-tokens by the public pattern; an entry that is a whole pre-token is taken
as it is, as the reference library of the format does, others are merged by
sentencepiece.  Decoding maps each id back to its bytes.

Pre-tokens repeat, so each task keeps a bounded store from piece of text to ids.
Cutting a text in front of a space that follows a non-space never parts a
pre-token (no branch of the pattern goes on past such a place and none looks back),
so the store's keys are those pieces.

Defined results: null text is an empty one: no tokens, digests of the empty string.
Texts of any length are encoded whole; repeated rows get equal results.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import map_arrow

#: Code point of byte 0; the 256 from here on are ordinary letters.
FIRST = 0x100
STORE = 500_000
#: Larger pieces of a batch repeat more words, which are encoded once.
PIECE_BYTES = 4 << 20
LONG_PIECE = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def mapped(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_TO_PIECE)


_TO_PIECE = {b: FIRST + b for b in range(256)}


def _field(number: int, wire: int, body: bytes) -> bytes:
    out = bytearray(_varint(number << 3 | wire))
    if wire == 2:
        out += _varint(len(body))
    return bytes(out + body)


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece ModelProto of a rank vocabulary; piece i is the entry of rank i, the unknown piece comes last."""
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0 to n - 1")
    number = lambda field, value: _field(field, 0, _varint(value))
    score = lambda value: _field(2, 5, struct.pack("<f", value))
    out = [_field(1, 2, _field(1, 2, mapped(raw).encode()) + score(-float(rank))) for raw, rank in by_rank]
    out.append(_field(1, 2, _field(1, 2, b"<unk>") + score(0.0) + number(3, 2)))
    n = len(by_rank)
    # model_type BPE, vocab_size, no dummy white space handling; only <unk> is defined.
    trainer = number(3, 2) + number(4, n + 1) + number(40, n) + number(41, -1) + number(42, -1) + number(43, -1)
    normaliser = _field(1, 2, b"identity") + number(3, 0) + number(4, 0) + number(5, 0)
    return b"".join(out) + _field(2, 2, trainer) + _field(3, 2, normaliser)


#: In front of a space that follows a non-space.
_CUT = re.compile(r"(?<=\S)(?=\x20)")
_RUNS = re.compile(r"\s\x20")


def pieces_of(text: str) -> list[str]:
    """``text`` cut where no pre-token can span; their concatenation is ``text``."""
    if _RUNS.search(text) or not text or "\0" in text:
        return _CUT.split(text) if text else []
    out = text.replace(" ", "\0 ").split("\0")
    return out if out[0] else out[1:]


class PieceStore:
    """Ids of pieces as little-endian 16-bit strings, remembered up to ``limit`` pieces; ``encode`` gives a list of ids, or such a string, for each."""

    def __init__(self, encode: Callable[[list[str]], list], limit: int = STORE):
        self.encode, self.limit, self.known = encode, limit, {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        cut = [pieces_of(t) for t in texts]
        known = self.known
        new = list({p for own in cut for p in own if p not in known})
        fresh = {p: ids if isinstance(ids, bytes) else np.array(ids, "<u2").tobytes() for p, ids in zip(new, self.encode(new))}
        room = self.limit - len(known)  # frequent pieces come early, so a full store stays as it is
        known.update((p, fresh[p]) for p in new[:room] if len(p) <= LONG_PIECE)
        get = known.get
        return [np.frombuffer(b"".join([get(p) or fresh[p] for p in own]), "<u2") for own in cut]


def pre_tokens(piece: str, pattern) -> list[str]:
    """The pre-tokens of a piece; a word in plain letters, with one mark behind it or none, needs no search."""
    word = piece[1:] if piece[0] == " " else piece
    if word.isalpha() and max(word) < _PLAIN:
        return [piece]
    if word[-1:] in _MARKS and word[:-1].isalpha() and max(word) < _PLAIN:
        return [piece[:-1], piece[-1]]
    return pattern.findall(piece)


#: Beneath it all Unicode versions agree on what a letter is.
_PLAIN = "\u0250"
_MARKS = frozenset(".,;:!?|")


class SentencePieceBPE:
    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.ranks = read_ranks(path)
        if len(self.ranks) > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.store = PieceStore(self.encode_pieces)
        self.whole = self.ranks
        self.bytes = Gather([raw for raw, _ in sorted(self.ranks.items(), key=lambda x: x[1])])
        self.digits = Gather([b"%d " % i for i in range(len(self.ranks))])

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        cut = [[p.encode() for p in pre_tokens(x, self.pattern)] for x in pieces]
        whole = self.whole
        merge = list({p for own in cut for p in own if p not in whole})
        # Byte 0xFF is in no UTF-8 text, so it parts them while all are mapped at once.
        joined = mapped(b"\xff".join(merge)).split(chr(FIRST + 255)) if merge else []
        ids = dict(zip(merge, self.model.encode(joined, out_type=int, num_threads=1))) if merge else {}
        return [[i for p in own for i in ((whole[p],) if p in whole else ids[p])] for own in cut]


class Gather:
    """Joins byte strings by id."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b""
        shift = np.repeat(self.begins[ids] - (ends - sizes), sizes)
        return self.data[shift + np.arange(int(ends[-1]))].tobytes()


_HELD: dict = {}


def encoder(path: str, pattern: str) -> SentencePieceBPE:
    """One model for a worker process."""
    if (path, pattern) not in _HELD:
        _HELD[path, pattern] = SentencePieceBPE(path, pattern)
    return _HELD[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, *, text_col="text", carry=("doc_id",)) -> DataFrame:
    """row (struct of the carried columns) and ids (array of int) of every whole text."""
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batch):
        ids = encoder(path, pattern).store([t or "" for t in batch.column("text").to_pylist()])
        cut = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate([*ids, np.zeros(0, "<u2")]).astype(np.int32)))],
                                          names=["row", "ids"])

    return map_arrow(slim, run, slim.selectExpr("row", "array(0) ids").schema, PIECE_BYTES)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """row, ids and the decoded bytes."""

    def run(batch):
        model = encoder(path, pattern)
        column = batch.column("ids")
        flat, off = column.flatten().to_numpy(), column.offsets.to_numpy()
        off = off - off[0]
        out = [model.bytes(flat[a:b]) for a, b in zip(off[:-1], off[1:])]
        return pa.RecordBatch.from_arrays([batch.column("row"), column, pa.array(out, pa.binary())], names=["row", "ids", "decoded"])

    return map_arrow(encoded, run, encoded.selectExpr("row", "ids", "cast('' as binary) decoded").schema)


def round_trip(docs: DataFrame, path: str, pattern: str, *, text_col="text", id_col="doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, all from the ids and from what they decode to."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batch):
        model = encoder(path, pattern)
        n, a, b = [], [], []
        for ids in model.store([t or "" for t in batch.column("text").to_pylist()]):
            n.append(len(ids))
            a.append(hashlib.sha256(model.digits(ids)[:-1]).hexdigest())
            b.append(hashlib.sha256(model.bytes(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                          names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(slim, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", PIECE_BYTES)
