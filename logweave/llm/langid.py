"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its character n-grams, hashed into
``2**bits`` rows, under a linear softmax.  Both matrices are trained together by
stochastic gradient descent in numpy on a bounded sample of the labelled rows
(``per_lang`` rows of every language, picked by a hash of the id, and fewer, but at least
one, if that makes over ``MAX_ROWS`` in all; of a text of over ``max_chars`` code points a
piece of that length from a place picked by the hash; at most ``segments`` segments of them).

A part of the sample, whole documents, is held back to calibrate on its texts and on their
segments: a temperature that minimises the log loss, and two limits under which a prediction is
rejected.  ``reject`` is for the score: it parts right predictions from wrong ones.  ``reject_known`` is for the
share of a text's longest n-grams that training saw (``KNOWN_PRIOR`` seen ones are added, so that a
few letters prove little): it lies midway between held-back texts and the lowest tenth of the same texts with their letters shuffled.
Either limit loses at most the share ``reject_quantile`` of the right ones.

The product of both matrices has one row of class scores per hashed n-gram, so a
prediction is a mean of looked-up rows over the whole text.

Defined results: null text, or one without a letter, gives ``und`` with score 0 and
is rejected; with no labelled row to learn from every text does.  Equal scores go to
the language first in order.  Null doc_ids are predicted but never learned from;
repeated rows get equal results, whatever rows they come with.  Only the columns named are read.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import map_arrow, mix, text_bytes

BITS, DIM, ORDERS = 16, 16, (1, 2, 3)
PER_LANG, MAX_ROWS, MAX_SAMPLE_CHARS, SEGMENTS, SEGMENT_CHARS = 300, 6_000, 20_000, 16_000, 240
EPOCHS, RATE, BATCH = 4, 0.5, 32
REJECT_QUANTILE = 0.0005
#: Bits of the hash under which the longest n-grams of training are remembered, and n-grams taken as seen beforehand.
SEEN_BITS, KNOWN_PRIOR = 20, 2


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: whether it is a letter, and its lower case (0 for what is no letter)."""
    n = sys.maxunicode + 1
    letter, lower = np.zeros(n, bool), np.zeros(n, np.uint32)
    for i in range(n):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            low = c.lower()
            lower[i] = ord(low) if len(low) == 1 else i
    return letter, lower


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters, runs of anything else as single zeros, and each row's offset; a row begins and ends with a zero."""
    raw, offsets = text_bytes(column)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = (raw & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(heads)])[offsets]
    low = _tables()[1][points]
    keep = np.ones(len(low), bool)
    if len(low):
        keep[1:] = (low[1:] != 0) | (low[:-1] != 0)
        keep[at[:-1][at[:-1] < len(low)]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])[at]
    n = len(kept) - 1
    out = np.zeros(int(kept[-1]) + 2 * n, np.uint32)  # a zero in front of and behind each row
    rows = np.repeat(np.arange(n), np.diff(kept))
    out[np.arange(int(kept[-1])) + 2 * rows + 1] = low[keep]
    return out, kept + 2 * np.arange(n + 1)


def ngrams(points: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The hashed row of the n-gram that starts at each point (at the last ones, of what is left and zeros)."""
    h = np.full(len(points), 0x51ED27 + order, np.uint64)
    long = np.concatenate([points.astype(np.uint64), np.zeros(order, np.uint64)])
    with np.errstate(over="ignore"):
        for k in range(order):
            h = (h + long[k:k + len(points)]) * np.uint64(0x9E3779B97F4A7C15)
        return (mix(h) >> np.uint64(64 - bits)).astype(np.int64)


def learned_rows(docs: DataFrame, id_col="doc_id", lang_col="lang"):
    """The rows that may be learned from: crc32(doc_id as text) mod 3 is not 1, with a language."""
    return F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)


def held_out(id_col="doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def row_ngrams(points: np.ndarray, offsets: np.ndarray, order: int, bits: int) -> np.ndarray:
    """``ngrams`` of rows in one array; what starts at the last point of a row, a zero, is an n-gram of zeros and never
    reads the next row (the point before it ends on the zeros between two rows)."""
    rows = ngrams(points, order, bits)
    rows[offsets[1:] - 1] = ngrams(np.zeros(1, np.uint32), order, bits)[0]
    return rows


def sample(docs: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", per_lang=PER_LANG, max_chars=MAX_SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(text, language) of the bounded sample, on the driver."""
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        learned_rows(docs, "id", "lang"))
    counts = usable.groupBy("lang").count().collect()  # one short row a language
    if not counts:
        return []
    per_lang = min(per_lang, max(1, MAX_ROWS // len(counts)))
    # More than needed by the hash, so that no language comes out short, and the first ones of these.
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, (2 * per_lang + 20) / r["count"]))])
    spread = F.pmod(F.xxhash64(F.col("id"), F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    start = F.pmod(F.xxhash64(F.col("id"), F.lit("piece")), F.greatest(F.length("text") - max_chars, F.lit(0)) + 1).cast("int") + 1
    picked = usable.select("lang", spread.alias("spread"), F.substring(F.col("text"), start, F.lit(max_chars)).alias("text")) \
        .where(F.col("spread") < F.element_at(share, F.col("lang")))
    first = picked.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("spread", "text"))).where(F.col("place") <= per_lang)
    return sorted((r["text"] or "", r["lang"]) for r in first.select("text", "lang").collect())


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, temperature: float, reject: float, bits: int = BITS, orders=ORDERS,
                 seen: np.ndarray | None = None, reject_known: float = 0.0):
        self.langs, self.table, self.temperature, self.reject, self.bits, self.orders = langs, table, temperature, reject, bits, orders
        self.seen, self.reject_known = np.ones(1 << SEEN_BITS, bool) if seen is None else seen, reject_known

    def known(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The share of each row's longest n-grams with a letter in them that training saw."""
        if not len(points):
            return np.ones(len(offsets) - 1)
        order = max(self.orders)
        lettered = points != 0
        for k in range(1, order):  # n-grams within a row; a row's last zero starts none
            lettered[:-k] |= points[k:] != 0
        lettered[offsets[1:] - 1] = False
        hit = self.seen[row_ngrams(points, offsets, order, SEEN_BITS)] & lettered
        return (np.add.reduceat(hit, offsets[:-1], dtype=np.int64) + KNOWN_PRIOR) / (np.add.reduceat(lettered, offsets[:-1], dtype=np.int64) + KNOWN_PRIOR)

    def logits(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.zeros((len(offsets) - 1, len(self.langs)))
        if len(points):
            for order in self.orders:
                rows = row_ngrams(points, offsets, order, self.bits)
                for j in range(len(self.langs)):
                    total[:, j] += np.add.reduceat(np.take(self.table[:, j], rows), offsets[:-1], dtype=np.float64)
        return total / np.maximum(1, np.diff(offsets) * len(self.orders))[:, None]

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, of each row."""
        n = len(column)
        if not self.langs or not n:
            return ["und"] * n, np.zeros(n), np.ones(n, bool)
        points, offsets = code_points(column)
        p = self.shares(points, offsets)
        best = p.argmax(axis=1)
        letters = np.add.reduceat(points != 0, offsets[:-1]) > 0
        score = np.where(letters, p[np.arange(n), best], 0.0)
        return [self.langs[b] if x else "und" for b, x in zip(best, letters)], score, ~letters | (score < self.reject) | (self.known(points, offsets) < self.reject_known)

    def shares(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = self.logits(points, offsets) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def limit(good: np.ndarray, bad: np.ndarray, most: float) -> float:
    """The value that best parts ``good`` from lower ``bad`` ones and has at most the share ``most`` of the good below it:
    the middle of the gap under the last good one kept, or, with bad ones above it, that one itself."""
    if not len(good):
        return 0.0
    least = float(np.sort(good)[min(len(good) - 1, int(most * len(good)))])
    below = bad[bad < least]
    return least if len(below) < len(bad) or not len(bad) else (least + float(below.max())) / 2


def _rows_of(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of texts as rows that begin and end with a zero."""
    rows = [np.concatenate([[0], p[int(p[0] == 0):len(p) - int(p[-1] == 0)], [0]]) for p in parts]
    return np.concatenate(rows).astype(np.uint32), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def _shuffled(points: np.ndarray, rng) -> np.ndarray:
    out = points.copy()
    at = np.flatnonzero(points)
    out[at] = points[rng.permutation(at)]
    return out


def _segments(rows, size, most, rng):
    out = []
    for k, (text, _) in enumerate(rows):
        points, _ = code_points(pa.array([text], pa.large_string()))
        if (points != 0).any():
            out += [(k, points[a:a + size]) for a in range(0, len(points), size) if (points[a:a + size] != 0).sum() >= 8]
    return [out[i] for i in np.sort(rng.permutation(len(out))[:most])]


def train(rows: list[tuple[str, str]], *, bits=BITS, dim=DIM, orders=ORDERS, segments=SEGMENTS, segment_chars=SEGMENT_CHARS, epochs=EPOCHS, rate=RATE,
          batch=BATCH, reject_quantile=REJECT_QUANTILE, seed=7) -> Model:
    langs = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    parts = _segments(rows, segment_chars, segments, rng)
    if not parts:
        return Model([], np.zeros((1 << bits, 0), np.float32), 1.0, 1.0, bits, orders)
    code = {lang: i for i, lang in enumerate(langs)}
    y = np.array([code[rows[k][1]] for k, _ in parts])
    grams = [np.concatenate([ngrams(p, o, bits) for o in orders]) for _, p in parts]
    doc = np.array([k for k, _ in parts])
    back = doc % 5 == 4 if len(set(doc.tolist())) >= 10 else np.zeros(len(parts), bool)  # whole documents are held back
    E = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    W = np.zeros((dim, len(langs)), np.float32)
    own = np.flatnonzero(~back)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(own), batch):
            pick = own[rng.integers(0, len(own), min(batch, len(own)))]
            ids = np.concatenate([grams[i] for i in pick])
            sizes = np.array([len(grams[i]) for i in pick])
            mean = np.add.reduceat(E[ids], np.concatenate([[0], np.cumsum(sizes)[:-1]])) / sizes[:, None]
            z = mean @ W
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            g = p / len(pick)
            back_to = (g @ W.T) / sizes[:, None]
            W -= np.clip(step * batch * (mean.T @ g), -0.5, 0.5)  # clipped, so that no rate diverges
            rows_, inverse = np.unique(ids, return_inverse=True)
            grad = np.zeros((len(rows_), dim), np.float32)
            per = np.repeat(np.arange(len(pick)), sizes)
            for d in range(dim):
                grad[:, d] = np.bincount(inverse, weights=back_to[per, d], minlength=len(rows_))
            E[rows_] -= np.clip(step * batch * grad, -0.5, 0.5)
    seen = np.zeros(1 << SEEN_BITS, bool)
    for i in own:
        seen[ngrams(parts[i][1], max(orders), SEEN_BITS)] = True
    model = Model(langs, (E @ W).astype(np.float32), 1.0, 0.0, bits, orders, seen)
    held = np.flatnonzero(back) if back.any() else own
    z = np.array([model.table[grams[i]].mean(axis=0) for i in held])
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 20, 60):
        q = z / t
        q = q - q.max(axis=1, keepdims=True)
        loss = float((np.log(np.exp(q).sum(axis=1)) - q[np.arange(len(held)), y[held]]).mean())
        best = min(best, (loss, float(t)))
    model.temperature = best[1]
    # Whole texts, and their segments as short ones.
    whole = np.unique(doc[held])
    rows_ = [code_points(pa.array([rows[k][0]], pa.large_string()))[0] for k in whole] + [parts[i][1] for i in held]
    truth = np.array([code[rows[k][1]] for k in whole] + y[held].tolist())
    points, offsets = _rows_of(rows_)
    p = model.shares(points, offsets)
    right = p.argmax(axis=1) == truth
    score = p.max(axis=1)
    # Never above what a chance guess among two languages would score.
    model.reject = min(0.5, limit(score[right], score[~right], reject_quantile))
    if back.any():
        noise = model.known(*_rows_of([_shuffled(r, rng) for r in rows_]))
        known = model.known(points, offsets)
        # Shuffled letters are still letters of the language, and new words are no junk: the lowest tenth of them is the mark.
        model.reject_known = limit(known[right], np.quantile(noise, [0.1]), reject_quantile)
    return model


def fit(docs: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", **kw) -> Model:
    sizes = {k: kw.pop(k) for k in ("per_lang", "max_chars") if k in kw}
    return train(sample(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **sizes), **kw)


def predict(docs: DataFrame, model: Model, *, text_col="text", carry=("doc_id",)) -> DataFrame:
    """row (struct of the carried columns), lang_pred, score, rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits rows of one float a language
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batch):
        lang, score, rejected = held.value.predict(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                                          names=["row", "lang_pred", "score", "rejected"])

    return map_arrow(slim, run, slim.selectExpr("row", "'' lang_pred", "0D score", "true rejected").schema)


def report(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row."""
    return predict(docs, fit(docs, **kw)).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce(held_out("row.doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` without the rows whose language is rejected."""
    out = predict(docs, fit(docs, **kw), carry=docs.columns).where(~F.col("rejected"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
