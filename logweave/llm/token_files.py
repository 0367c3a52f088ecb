"""Token-id files: documents in ascending id order, ids packed by the range coder.

Documents are range-partitioned by id, so a shard is one contiguous run of them and
shards follow one another; each task writes one file, streaming.  A file is::

    "IDS2"                                          magic
    then, up to LANES blocks after each model:
    model:   "MDL1" 0 crc32 size, payload           what the blocks behind it share; crc32 of the payload
    block*:  "BLK1" ids crc32 size, payload         u32 each, little-endian; crc32 of the ids as u32
    index:   zlib of the documents' ids and lengths
    trailer: index offset u64, index size u64, ids u64, documents u64, "IDSX"

Blocks hold ``BLOCK`` ids (the last one what is left), start from an empty history and
can be decoded alone with their model; a reader checks the crc of every block and model.
A document may span blocks.
The manifest, written once, names the files that count, and adds up to the number of
ids in front of each shard.

Defined results: null text is an empty one and gives only the end id; null doc_ids
come first; rows that share a doc_id are documents of their own, in the order of a
hash of their texts; an empty table writes no file.  A vocabulary must keep its ids
under 65,535.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm import range_coder
from logweave.llm.common import id_column, new_path, pieces, written
from logweave.llm.files import new_file, open_file, read_range
from logweave.llm.piece_table import PieceTable

END_ID = 2
BLOCK, LANES = 1024, 4096
#: Text bytes that are looked up at once.
PIECE_BYTES = 1 << 20
#: Pieces that are encoded at once.
JOINT = 512
MAGIC, MODEL_MAGIC, BLOCK_MAGIC, LAST = b"IDS2", b"MDL1", b"BLK1", b"IDSX"
_TRAILER = struct.Struct("<4Q4s")
_BLOCK = struct.Struct("<4s3I")
_NO_DOC = -(1 << 63)


#: The pre-tokenizer whose borders ``piece_table`` knows.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: One pre-token by itself: letters, digits or marks, with a space in front or none.
_PLAIN = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")


def _byte_characters() -> dict[int, str]:
    """The character that a byte-level vocabulary has for each byte."""
    out = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    return out | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)}


_TO_CHARACTER = _byte_characters()


class Tokens:
    """Ids of whole texts by a tokenizer file.  ``special``: a literal of one of its special tokens is that token, as the
    library has it by default; otherwise it is text like any other."""

    def __init__(self, path: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = not special
        if tokenizer.get_vocab_size() >= range_coder.NO_ID:
            raise ValueError("ids must be under 65,535")
        self.tokenizer, self.model = tokenizer, tokenizer.model
        form = json.loads(tokenizer.to_str())
        self.cut = form["normalizer"] is None and _BYTE_LEVEL.items() <= (form["pre_tokenizer"] or {}).items() and form["model"]["type"] == "BPE"
        self.added = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
        # A token of a byte-level vocabulary has a character for each of its bytes; a special one is spelt out.
        self.sizes = np.zeros(1 + max(tokenizer.get_vocab().values(), default=0), np.int64)
        for token, i in tokenizer.get_vocab().items():
            self.sizes[i] = len(token)
        for i, token in tokenizer.get_added_tokens_decoder().items():
            self.sizes[i] = len(token.content.encode())
        self.table = PieceTable(self.encode_pieces)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces and the number of each one's.  Single pre-tokens go straight to the library's BPE model, others
        through its whole pipeline."""
        out: list = [None] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if _PLAIN.fullmatch(p)] if self.cut else []
        if plain:  # byte 0xFF is in no UTF-8 text, so it parts them while all are mapped at once
            tokenize = self.model.tokenize
            for i, word in zip(plain, b"\xff".join([pieces[i] for i in plain]).decode("latin-1").translate(_TO_CHARACTER).split(_TO_CHARACTER[255])):
                out[i] = [token.id for token in tokenize(word)]
        others = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(others, self._encode_joint([pieces[i].decode() for i in others])):
            out[i] = ids
        return np.array([i for own in out for i in own], np.uint16), np.array([len(own) for own in out], np.int64)

    def _encode_joint(self, pieces: list[str]) -> list[list[int]]:
        """Pieces that can stand in one text, as no pre-token can span them, are encoded many at once and told apart by their bytes."""
        out: list = [None] * len(pieces)
        joint = [i for i, p in enumerate(pieces) if p[0] == " " and not p[-1].isspace()] if self.cut else []
        for a in range(0, len(joint), JOINT):
            own = joint[a:a + JOINT]
            text = "".join([pieces[i] for i in own])
            found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
            sizes = [len(pieces[i]) for i in own] if text.isascii() else [len(pieces[i].encode()) for i in own]
            ends, at = np.cumsum(sizes), np.cumsum(self.sizes[found])
            cut = np.searchsorted(at, ends) + 1
            if at[-1] == ends[-1] and (at[cut - 1] == ends).all():
                bounds = [0, *cut.tolist()]
                for i, x, y in zip(own, bounds, bounds[1:]):
                    out[i] = found[x:y]
        alone = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(alone, self.tokenizer.encode_batch_fast([pieces[i] for i in alone], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts and the number of each one's."""
        whole = np.full(len(texts), not self.cut)
        for literal in self.added:  # which may lie across a border
            whole |= pc.match_substring(texts, literal).fill_null(False).to_numpy(zero_copy_only=False)
        return self.table(texts, whole)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        ids, counts = self.column(pa.array(texts, pa.large_string()))
        return np.split(ids, np.cumsum(counts)[:-1]) if texts else []


_HELD: dict[tuple[str, bool], Tokens] = {}


def tokens(path: str, special: bool = False) -> Tokens:
    if (path, special) not in _HELD:
        _HELD[path, special] = Tokens(path, special)
    return _HELD[path, special]


class Writer:
    def __init__(self, out, block: int = BLOCK, lanes: int = LANES):
        self.out, self.block, self.lanes = out, block, lanes
        self.at, self.ids, self.docs, self.sizes, self.held, self.n_held = 0, 0, [], [], [], 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc, ids: np.ndarray) -> None:
        self.add_all([doc], [len(ids)], ids)

    def add_all(self, docs: list, sizes: list[int], ids: np.ndarray) -> None:
        """Documents, the numbers of their ids, and all these ids."""
        self.docs += [_NO_DOC if doc is None else doc for doc in docs]
        self.sizes += sizes
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block * self.lanes:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([*self.held, np.zeros(0, "<u2")])
        whole = len(ids) // self.block
        for a in range(0, whole - self.lanes + 1, self.lanes):
            self._encode(ids[a * self.block:(a + self.lanes) * self.block].reshape(self.lanes, self.block), [self.block] * self.lanes)
        ids = ids[whole // self.lanes * self.lanes * self.block:]
        if last and len(ids):
            lanes, steps = -(-len(ids) // self.block), min(len(ids), self.block)
            padded = np.zeros(lanes * steps, ids.dtype)
            padded[:len(ids)] = ids
            self._encode(padded.reshape(lanes, steps), [min(steps, len(ids) - i * steps) for i in range(lanes)])
            ids = ids[:0]
        self.held, self.n_held = [ids], len(ids)

    def _encode(self, lanes: np.ndarray, sizes: list[int]) -> None:
        ids = np.ascontiguousarray(lanes.T, np.uint16)
        model = range_coder.Model.of(ids)
        packed = model.pack()
        self._put(_BLOCK.pack(MODEL_MAGIC, 0, zlib.crc32(packed), len(packed)) + packed)
        for own, n, payload in zip(lanes, sizes, range_coder.encode_by(model, ids)):
            self._put(_BLOCK.pack(BLOCK_MAGIC, n, zlib.crc32(own[:n].astype("<u4").tobytes()), len(payload)) + payload)
            self.ids += n

    def close(self) -> None:
        self._flush(True)
        index = zlib.compress(np.array(self.docs, "<i8").tobytes() + np.array(self.sizes, "<i8").tobytes(), 6)
        start = self.at
        self._put(index)
        self._put(_TRAILER.pack(start, len(index), self.ids, len(self.docs), LAST))
        self.out.close()


def read_blocks(file, end: int, lanes: int = LANES) -> Iterator[np.ndarray]:
    """The ids of the blocks in order, decoded ``lanes`` at a time and checked."""
    at, model = len(MAGIC), None
    while at < end:
        heads, payloads = [], []
        while at < end and len(heads) < lanes:
            magic, n, crc, size = _BLOCK.unpack(read_range(file, at, _BLOCK.size))
            if magic not in (MODEL_MAGIC, BLOCK_MAGIC) or model is None and magic == BLOCK_MAGIC:
                raise ValueError("a block's magic is missing")
            if magic == MODEL_MAGIC and heads:
                break
            payload = read_range(file, at + _BLOCK.size, size)
            at += _BLOCK.size + size
            if magic == MODEL_MAGIC:
                if zlib.crc32(payload) != crc:
                    raise ValueError("a model does not match its checksum")
                model = range_coder.Model.unpack(payload)
            else:
                payloads.append(payload)
                heads.append((n, crc))
        if not heads:
            raise ValueError("a model has no blocks")
        decoded = np.ascontiguousarray(range_coder.decode_by(model, payloads, max(n for n, _ in heads)).T)
        for own, (n, crc) in zip(decoded, heads):
            ids = own[:n].astype("<u4")
            if zlib.crc32(ids.tobytes()) != crc:
                raise ValueError("a block does not match its checksum")
            yield ids


def read_documents(path: str) -> Iterator[tuple[int | None, list[np.ndarray]]]:
    """(doc_id, its ids in one array or more) of every document of a file, in order."""
    with open_file(path) as file:
        size = file.size()
        start, length, total, n, last = _TRAILER.unpack(read_range(file, size - _TRAILER.size, _TRAILER.size))
        if last != LAST or read_range(file, 0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is not a token file")
        index = np.frombuffer(zlib.decompress(read_range(file, start, length)), "<i8")
        docs, sizes = index[:n], index[n:]
        if sizes.sum() != total:
            raise ValueError(f"{path}: the index does not add up")
        blocks, left = read_blocks(file, start), np.zeros(0, "<u4")
        for doc, size_ in zip(docs.tolist(), sizes.tolist()):
            parts = []
            while size_ > 0:
                if not len(left):
                    left = next(blocks)
                parts.append(left[:size_])
                size_, left = size_ - len(parts[-1]), left[size_:]
            yield None if doc == _NO_DOC else doc, parts


MANIFEST = "shard int, path string, ids long, documents long, bytes long"


def write_files(docs: DataFrame, tokenizer: str, folder: str, *, id_col="doc_id", text_col="text", end_id: int = END_ID, special: bool = False) -> DataFrame:
    """Writes one file a shard; shards and the documents in them ascend by id."""
    key = F.xxhash64("text")
    rows = id_column(docs, id_col, text_col).withColumn("key", key).repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key")

    def run(batches):
        writer, path, held = None, None, tokens(tokenizer, special)
        for batch in batches:
            for piece in pieces(batch, PIECE_BYTES):
                if writer is None:
                    path, out = new_file(folder, ".ids")
                    writer = Writer(out)
                ids, counts = held.column(piece.column("text"))
                writer.add_all(piece.column("doc_id").to_pylist(), (counts + 1).tolist(), np.insert(ids, np.cumsum(counts), end_id))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((TaskContext.get().partitionId(), pa.int32()), (path, pa.string()), (writer.ids, pa.int64()),
                                                                            (len(writer.docs), pa.int64()), (writer.at, pa.int64()))], names=["shard", "path", "ids", "documents", "bytes"])

    return rows.mapInArrow(run, MANIFEST)


def write(docs: DataFrame, tokenizer: str, **kw) -> DataFrame:
    """The manifest of newly written files, with ``base``, the ids in all shards before."""
    manifest = written(write_files(docs, tokenizer, new_path(docs.sparkSession, "ids"), **kw), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def run(batches):
        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                rows = []
                for doc, parts in read_documents(path):
                    crc, n = 0, 0
                    for part in parts:
                        crc, n = zlib.crc32(part.tobytes(), crc), n + len(part)
                    rows.append((doc, at, n, crc))
                    at += n
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    spread = manifest.select("path", "base").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def report(docs: DataFrame, tokenizer: str, **kw) -> DataFrame:
    return read(write(docs, tokenizer, **kw))
