"""Rows for the tests of the corpus operators."""

import random

from pyspark.sql import types as T

WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ironwood juniper katsura larch maple nutmeg oak pine quince rowan spruce teak".split()
#: Columns of the caller that carry names the operators use inside.
CLASHING = ["row", "hits", "items", "h", "at", "point", "sketch", "shard", "kind", "spans", "w", "lines", "chunk", "cleaned", "n", "txt", "key", "root"]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(n))


def odd_rows():
    """(doc_id, text, lang): nulls, empty and very long texts, ties, repeated rows, copies, near copies and passages."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    passage = prose(2, 70)
    rows = [
        (1, base, "en"), (2, " ".join(near), "en"), (3, base, "en"), (4, prose(3, 40) + " " + passage + " " + prose(4, 30), "en"),
        (5, prose(5, 33) + "\n" + passage + "\t" + prose(6, 21), "de"), (6, None, None), (7, "", "en"), (8, "   \n\t ", None), (9, "one two", "en"),
        (10, "one two", "de"), (11, prose(7, 20_000), "en"), (12, "x " * 3000, "en"), (13, "é" * 5000, "fr"), (14, "12 34 !! \U0001F600", "en"),
        (None, base, "en"), (None, None, None), (15, base.upper(), "en"), (15, base.upper(), "en"), (16, passage, None), (17, "a\x1cb\x85c\xa0d e", "en"),
    ]
    return rows


def frame(spark, rows):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                           T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())] + [T.StructField(c, T.StringType()) for c in CLASHING])
    return spark.createDataFrame([(d, t, g, None, None, *CLASHING) for d, t, g in rows], schema)
