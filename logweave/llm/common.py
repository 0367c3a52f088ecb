"""Helpers shared by the corpus operators: shared storage, Arrow batches, word hashes.

Hashes are 64 bits.  Word and window hashes are prefix sums of a polynomial
modulo 2**64, so every window of a text costs a few vectorised operations
whatever its length; callers that need certainty compare the text itself.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.session import shared_folder

#: Text bytes that a task works on at once; arrays of 64 bits a byte make it many times that in every worker.
PIECE_BYTES = 1 << 18
#: Rows of an Arrow batch, of which the JVM and the worker hold several.
BATCH_ROWS = 1000

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage, and
    gives every later reader the same rows after a lost executor."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, limit: int = PIECE_BYTES) -> DataFrame:
    """``fn`` on every Arrow batch of ``df``, cut so that no piece holds much more than ``limit`` bytes.

    Rows are whole texts, so the session's batches are held to ``BATCH_ROWS`` rows."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(conf)) <= BATCH_ROWS:
        df.sparkSession.conf.set(conf, str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for piece in pieces(batch, limit):
                    out = fn(piece)
                    if out is not None:
                        yield out
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Memory that a finished task has freed goes back to the system: the worker lives on for later stages, and
    their workers share the executor's memory with it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it likes
        pass


def pieces(batch: pa.RecordBatch, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    step = max(1, int(batch.num_rows * min(1.0, limit / max(1, batch.nbytes))))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def id_column(docs: DataFrame, id_col: str, text_col: str):
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offset of each row (null: empty)."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset:]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]], off - off[0]


def byte_class(excluded: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, mapped byte) for the 256 byte values; ``lower`` maps A-Z to a-z first."""
    mapped = np.arange(256, dtype=np.uint8)
    if lower:
        mapped[65:91] += 32
    word = np.ones(256, bool)
    word[np.frombuffer(excluded, np.uint8)] = False
    return word[mapped], mapped


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (base odd)."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        size = max(1024, 1 << int(n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            p = np.ones(size, np.uint64)
            filled, step = 1, np.uint64(b)
            while filled < size:
                m = min(filled, size - filled)
                p[filled:filled + m] = p[:m] * step
                filled, step = filled + m, step * step
            both.append(p)
        held = _POWERS[base] = tuple(both)
    return held[0][:n], held[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sums(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i, one longer than ``values``."""
    with np.errstate(over="ignore"):
        out = np.empty(len(values) + 1, np.uint64)
        out[0] = 0
        np.cumsum(values * powers(base, len(values))[0], out=out[1:])
    return out


def window_hashes(values: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A hash of every k consecutive values (len - k + 1 of them)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = sums(values, base)
    with np.errstate(over="ignore"):
        return mix((s[k:] - s[:n]) * powers(base, n)[1])


class Words:
    """The words of a batch of texts: byte spans, document index and a 64-bit hash of each."""

    def __init__(self, column: pa.Array, word: np.ndarray, mapped: np.ndarray):
        raw, self.offsets = text_bytes(column)
        self.data = mapped[raw]
        n = len(self.data)
        inside = np.zeros(n + 1, bool)
        inside[:n] = word[raw]
        before = np.zeros(n + 1, bool)
        before[1:] = inside[:-1]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        self.starts = np.flatnonzero(inside & (~before | edge))
        self.ends = np.flatnonzero(before & (~inside | edge))
        self.doc = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self.first = np.searchsorted(self.starts, self.offsets)  # of each row's words; the last is their number
        s = sums(self.data.astype(np.uint64) + np.uint64(1), 0x2545F4914F6CDD1D)
        with np.errstate(over="ignore"):
            self.hash = mix((s[self.ends] - s[self.starts]) * powers(0x2545F4914F6CDD1D, n + 1)[1][self.starts])

    def __len__(self) -> int:
        return len(self.starts)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b - 1 joined by one space."""
        return b" ".join(self.data[self.starts[i]:self.ends[i]].tobytes() for i in range(a, b))


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values; a sort is faster here than the hash table of ``np.unique``."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])[:len(values)]]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in [s, s + width) for one of the starts."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:n]) > 0
