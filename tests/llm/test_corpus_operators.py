"""Token files, passages, packages, near copies, suffix dedup and the pipeline against plain versions."""

import base64
import hashlib
import io
import random
import re
import struct
import zipfile
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from llm_data import CLASHING, frame, odd_rows, prose
from tokenizers import Tokenizer

from logweave.llm import common, files, induced, near_dup, phrases, queries, range_coder, recurring, suffix_dedup, token_files, warc_zip
from logweave.llm.components import components

JSON = public_tokenizers.path("byte_bpe_50k.json")


def same(df, want, columns):
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(want)


# -- token files -------------------------------------------------------------------

@pytest.mark.parametrize("lanes,steps,top", [(1, 1, 9), (4, 700, 65535), (7, 300, 3), (2, 3000, 200)])
def test_range_coder_round_trip(lanes, steps, top):
    ids = np.random.default_rng(lanes).integers(0, top, (lanes, steps))
    blocks = range_coder.encode(ids)
    assert (range_coder.decode(blocks, steps) == ids).all()
    assert (range_coder.decode(blocks[-1:], steps) == ids[-1:]).all()  # blocks are independent


def test_range_coder_learns():
    ids = np.tile(np.arange(50), 60)[None]
    assert len(range_coder.encode(ids)[0]) < 0.2 * 2 * ids.size


def test_token_files(spark, empty):
    rows = [r for r in odd_rows()] + [(400, "a<|endoftext|>b", None), (5_000_000_000, "last", None)]
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    ids = {t: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t, _ in rows}
    docs = frame(spark, rows).repartition(3)
    manifest = token_files.write(docs, JSON)
    out = token_files.read(manifest).collect()
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == Counter((d, len(ids[t]), crc(ids[t])) for d, t, _ in rows)
    at, last = 0, None
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at and (last is None or r.doc_id >= last)
        at, last = at + r.n_tokens, r.doc_id
    assert token_files.report(empty, JSON).count() == 0


def test_the_query_has_special_tokens_as_the_library_has_them(spark, tmp_path):
    rng = random.Random(3)
    texts = ["a<|endoftext|>b", " x <|endoftext|>  y"] + ["".join(rng.choice(["<|endoftext|>", " ", "\n", "a", "é", "<|", "'s"]) for _ in range(8)) for _ in range(40)]
    frame(spark, [(d, t, None) for d, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = Tokenizer.from_file(JSON)
    ids = [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert 50256 in ids[0]
    same(queries.op1_mixed_range_coder(spark, str(tmp_path)), [(d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in enumerate(ids)],
         ["doc_id", "n_tokens", "ids_crc32"])


@pytest.mark.parametrize("special", [True, False])
def test_pieces_are_encoded_jointly(special):
    class Counting:
        def __init__(self, own):
            self.own, self.strings = own, 0

        def encode_batch_fast(self, texts, **kw):
            self.strings += len(texts)
            return self.own.encode_batch_fast(texts, **kw)

    own = token_files.Tokens(JSON, special)
    own.tokenizer = Counting(own.tokenizer)
    own([" ".join(f"word{i}" for i in range(2000))])
    assert own.tokenizer.strings < 10
    rng = random.Random(7)
    odd = ["<|endoftext|>", " ", "  ", "\n", "\0", "\x1c", "\u3000", "a", "é", "日本", "<|", "<|end", "oftext|>", " 's", "12", "😀"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(12))) for _ in range(2000)]
    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = not special
    assert [x.tolist() for x in own(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_damaged_blocks_are_found(tmp_path):
    path, out = files.new_file(str(tmp_path), ".ids")
    writer = token_files.Writer(out, block=16, lanes=4)
    rng = random.Random(1)
    docs = [(d, np.array([rng.randrange(50_000) for _ in range(rng.choice([0, 1, 15, 16, 17, 200]))], "<u2")) for d in [None, *range(40)]]
    for d, x in docs:
        writer.add(d, x)
    writer.close()
    back = [(d, np.concatenate([*p, np.zeros(0, "<u4")]).tolist()) for d, p in token_files.read_documents(path)]
    assert back == [(d, x.tolist()) for d, x in docs]
    raw = bytearray(open(path, "rb").read())
    raw[30] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError):
        list(token_files.read_documents(path))


# -- passages ----------------------------------------------------------------------

def plain_removed(units, width, split, join):
    first = {}
    for d, u in units:
        for i in range(len(u) - width + 1):
            k = tuple(u[i:i + width])
            if d is not None and (k not in first or d < first[k]):
                first[k] = d
    out = []
    for d, u in units:
        gone = [False] * len(u)
        for i in range(len(u) - width + 1):
            if d is not None and first[tuple(u[i:i + width])] < d:
                gone[i:i + width] = [True] * width
        out.append((d, u, gone))
    return out


def passage_rows():
    rng = random.Random(8)
    shared = [prose(50 + i, n).split() for i, n in enumerate((50, 51, 49, 120, 300))]
    rows = odd_rows()
    for d in range(500, 540):
        parts = []
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, max(0, len(s) - 50))
            parts += [prose(rng.random(), rng.randint(0, 30)), " ".join(s[a:a + rng.randint(45, 200)])]
        rows.append((d, rng.choice([" ", "\n", "\t "]).join([*parts, prose(rng.random(), rng.randint(0, 20))]), "en"))
    rows += [(d, " ".join(shared[3]) + f" own{d} words{d}", "en") for d in range(600, 640)]  # a hot passage
    rows += [(650, "la " * 500, "en"), (651, "la " * 400 + "li", "en"), (652, "la " * 49, "en")]
    return rows


@pytest.mark.parametrize("partitions", [1, 5])
def test_phrases(spark, empty, partitions):
    rows = passage_rows()
    want = [(d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
            for d, w, gone in plain_removed([(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows], 50, None, None)]
    same(phrases.report(frame(spark, rows).repartition(partitions)), want, ["doc_id", "n_words", "n_removed", "kept_sha256"])
    assert phrases.report(empty).count() == 0


def test_every_window_keeps_its_anchor():
    values = np.random.default_rng(3).integers(0, 50, 400).astype(np.uint64)
    h, at = recurring.window_anchors(values, 8, 50)
    for i, a in enumerate(at.tolist()):
        own = h[i:i + 43]
        assert i <= a < i + 43 and h[a] == own.min() and a == i + 42 - int(np.argmin(own[::-1]))


# -- suffix dedup --------------------------------------------------------------------

@pytest.mark.parametrize("n,top,k,width", [(49, 3, 24, 50), (50, 3, 24, 50), (3000, 1, 24, 50), (3000, 2, 3, 7), (70_000, 3, 24, 50)])
def test_window_anchors_over_blocks(n, top, k, width):
    h, at = recurring.window_anchors(np.random.default_rng(n).integers(0, top, n).astype(np.uint64), k, width)
    own, w = h.tolist(), width - k + 1
    some = [i for i in range(len(at)) if i < 300 or abs(i - recurring.BLOCK) < 100]
    assert len(h) == n - k + 1 and len(at) == max(0, n - width + 1)
    assert [at[i] for i in some] == [max(range(i, i + w), key=lambda j: (-own[j], j)) for i in some]


def test_anchors_and_windows_of_many_texts_at_once(monkeypatch):
    """Texts that are looked at together have the anchors and windows that each has on its own, and none across two; the work is not done text by text."""
    rng = np.random.default_rng(8)
    sizes = [0, 49, 50, 0, 51, 7, 300, 50, 0, 120, 49]
    first = np.concatenate([[0], np.cumsum(sizes)])
    values = rng.integers(0, 5, first[-1]).astype(np.uint64)
    want, windows = [], []
    for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
        h, at = recurring.window_anchors(values[a:b], 8, 50)
        want += [(h[x], x, i) for x in np.unique(at)]
        windows += [(i, s) for s in range(max(0, b - a - 49))]
    calls = []
    real = recurring.window_anchors
    monkeypatch.setattr(recurring, "window_anchors", lambda *a: calls.append(1) or real(*a))
    assert list(zip(*recurring.text_anchors(values, first, 8, 50))) == want and len(calls) == 1
    start, text = recurring.inside(first, len(values) - 49, 50)
    assert list(zip(text, start - first[text])) == windows
    for few in ([], [0, 0], [49], [3, 4]):
        off = np.concatenate([[0], np.cumsum(np.array(few, int))]).astype(int)
        assert [len(x) for x in recurring.text_anchors(values[:off[-1]], off, 8, 50)] == [0, 0, 0]


def test_anchors_with_one_context_are_answered_apart():
    """Only rows of anchors with two contexts, and those that may go on in other batches, are streamed one by one."""
    rng, rows = random.Random(5), []
    for h in range(40):
        own = [bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(1 if h % 4 else 2)]
        rows += sorted((h, i, c, chunk, rng.randrange(5), rng.randrange(5, 9)) for i, c in enumerate(own) for chunk in range(rng.choice([1, 3])))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["h", "digest", "context", "chunk", "least", "most"])
    found, rest = suffix_dedup._alone(batch, 50)
    assert {r["h"] for r in rest.to_pylist()} == {h for h in range(40) if h % 4 == 0} | {0, 39}
    plain = lambda xs: Counter((r["chunk"], r["digest"], tuple(tuple(x.values()) for x in r["runs"])) for r in xs)
    left = [{"chunk": c, "digest": d, "runs": r} for c, d, r in suffix_dedup.settled((tuple(r.values()) for r in rest.to_pylist()), 50)]
    assert plain(found.to_pylist()) + plain(left) == plain({"chunk": c, "digest": d, "runs": r} for c, d, r in suffix_dedup.settled(rows, 50))


@pytest.mark.parametrize("memory", [1, 500, 1 << 20])
def test_induced_sorting(memory):
    rng = random.Random(memory)
    for _ in range(60):
        letters = rng.choice([b"a", b"ab", b"abcd", bytes(range(256))])
        text = bytes(rng.choice(letters) for _ in range(rng.randint(1, 120)))
        depth = rng.choice([3, 20, 50])
        places, lcps = [], []
        for p, x in induced.suffixes(np.frombuffer(text, np.uint8), depth, memory):
            places += p.tolist()
            lcps += x.tolist()
        cut = [text[p:p + depth] for p in places]
        assert sorted(places) == list(range(len(text))) and cut == sorted(cut)
        for a, b, n in zip(cut, cut[1:], lcps[1:]):
            assert n == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("limit,most_rows,block", [(1 << 20, 10_000, 4096), (300, 10_000, 3), (1 << 20, 5, 2), (1, 1, 1)])
def test_a_shard_is_settled_anchor_by_anchor(limit, most_rows, block):
    rng, width, rows = random.Random(block), 6, []
    for h in range(-20, 20):
        own = {"".join(chr(0x120 + h) + rng.choice("a\0") for _ in range(rng.randint(2, 6))).encode() for _ in range(rng.choice([1, 2, 60]))}  # a window tells its anchor
        for digest, context in enumerate(sorted(own)):
            rows += [(h, digest, context, chunk, low := rng.randint(0, 50), low + rng.randint(0, 9)) for chunk in range(rng.randint(1, 4))]
    first = {}
    for h, _, context, _, low, _ in rows:
        for i in range(len(context) - width + 1):
            first[h, context[i:i + width]] = min(low, first.get((h, context[i:i + width]), low))
    want, got, read = Counter(), Counter(), []
    for h, digest, context, chunk, _, high in rows:
        want.update((chunk, digest, f) for i in range(len(context) - width + 1) if (f := (i, h, first[h, context[i:i + width]]))[2] < high)
    for h in range(-20, 20):
        for chunk, digest, runs in suffix_dedup.settled([r for r in rows if r[0] == h], width, limit, most_rows, block):
            got.update((chunk, digest, (i, h, r["first"])) for r in runs for i in range(r["a"], r["b"]))
    assert got == want
    whole = list(suffix_dedup.settled((read.append(r) or r for r in rows), width, limit, most_rows, block))
    assert len(whole) == sum(len(list(suffix_dedup.settled([r for r in rows if r[0] == h], width))) for h in range(-20, 20))
    read.clear()
    if limit < 1000:  # answers come before all rows are read
        next(suffix_dedup.settled((read.append(r) or r for r in rows), width, limit, most_rows, block))
        assert len(read) < len(rows) / 2


def test_runs_of_a_context_are_built_once():
    firsts = [np.array([5, 5, 2]), np.array([], np.int64), np.array([2, 9])]
    got = list(suffix_dedup._answers([(0, 1, 10, 6), (0, 2, 10, 4), (0, 3, 10, 2), (1, 1, 11, 9), (2, 1, 12, 99), (2, 4, 12, 99)], firsts))
    run = lambda a, b, f: {"a": a, "b": b, "first": f}
    assert got == [(1, 10, [run(0, 2, 5), run(2, 3, 2)]), (2, 10, [run(2, 3, 2)]), (1, 12, [run(0, 1, 2), run(1, 2, 9)]), (4, 12, [run(0, 1, 2), run(1, 2, 9)])]
    assert got[2][2] is got[3][2]
    kind = pa.list_(pa.struct([("digest", pa.int64()), ("runs", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("first", pa.int64())])))]))
    found = pa.array([[], [{"digest": 12, "runs": got[2][2]}, {"digest": 10, "runs": got[1][2]}]], kind)[1].values
    assert [x.tolist() for x in suffix_dedup._runs_at(found, np.array([10, 11, 12, 10]), np.array([100, 200, 300, 400]), np.array([7, 8, 9, 10]))] == [
        [100, 300, 300, 400], [7, 9, 9, 10], [2, 0, 1, 2], [3, 1, 2, 3], [2, 2, 9, 2]]


def test_shards_follow_the_bytes(spark, empty):
    parts = suffix_dedup.chunks(frame(spark, [(d, prose(d, 200), None) for d in range(20)]), "doc_id", "text")
    assert suffix_dedup.shards_of(parts, 500) > suffix_dedup.shards_of(parts) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert suffix_dedup.shards_of(suffix_dedup.chunks(empty, "doc_id", "text"), 500) == suffix_dedup.shards_of(parts)


@pytest.mark.parametrize("partitions", [1, 4])
def test_suffix_dedup(spark, empty, partitions):
    rows = passage_rows()
    want = []
    for d, raw, gone in plain_removed([(d, (t or "").encode()) for d, t, _ in rows if len(t or "") < 50_000], 50, None, None):
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want.append((d, len(raw), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(raw, gone) if not g)).hexdigest()))
    docs = frame(spark, [r for r in rows if len(r[1] or "") < 50_000]).repartition(partitions)
    same(suffix_dedup.report(docs), want, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    assert suffix_dedup.report(empty).count() == 0


def test_pieces_stay_small():
    texts = [f"{i:05d}" * 400 for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    cut = list(common.pieces(batch))
    assert [t for p in cut for t in p.column("text").to_pylist()] == texts
    assert max(p.nbytes for p in cut) <= 300_000  # a worker holds arrays of many times that


# -- packages ------------------------------------------------------------------------

def test_packages(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>page {i % 7}</p>" if i % 3 else f"<p>é {i}</p>") for i in range(40)]
    rows += [(90, None, None), (91, "http://e", ""), (92, "http://line\nbreak", "\r\n\r\nWARC/1.1"), (None, "u", "<p>page 1</p>"), (None, "u", "only null"), (93, "u", "twice"), (93, "u", "twice"), (94, "u", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "page_id long, url string, html string, payload string, sha1 string, best string")
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(i, best.get(h or "", i))
    want = []
    for i, _, h in rows:
        raw, b = (h or "").encode(), best.get(h or "")
        to = b if b is not None and b != i else None
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if to is None else "revisit", to))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    same(warc_zip.report(pages.repartition(3)), want, columns)
    assert warc_zip.report(pages.limit(0)).count() == 0
    folder = common.new_path(spark, "test")
    manifest = common.written(warc_zip.write_packages(warc_zip.planned(pages), folder, package_bytes=2000), "m")
    assert manifest.count() > 3
    back = warc_zip.read_packages(manifest)
    assert Counter(bytes(r.payload).decode() for r in back.where("record_type = 'response'").collect())["z" * 300_000] == 1
    for r in manifest.collect():  # any other reader takes them as well
        raw = open(r.path.removeprefix("file:"), "rb").read()
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            assert z.testzip() is None and z.namelist() == [warc_zip.DATA, warc_zip.INDEX]


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_zip_directories():
    plain = Bytes()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("é.txt", b"stored")
        z.writestr(zipfile.ZipInfo("packed"), b"x" * 100, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\5\6 in it" + b"." * 30
    members = warc_zip.stored_members(plain)
    assert list(members) == ["é.txt"] and files.read_range(plain, *members["é.txt"]) == b"stored"
    out = Bytes()
    out.close = lambda: None
    writer = warc_zip.ZipWriter(out)
    for name, data in (("a", b"one"), ("b", b"")):
        writer.begin(name)
        writer.write(data)
        writer.end()
    writer.close()
    members = warc_zip.stored_members(out)
    assert {k: files.read_range(out, *v) for k, v in members.items()} == {"a": b"one", "b": b""}
    for damaged in (b"", b"no zip at all" * 9, out.getvalue()[:-30]):
        with pytest.raises((ValueError, struct.error)):
            warc_zip.stored_members(Bytes(damaged))


# -- near copies -----------------------------------------------------------------------

def plain_sets(rows):
    out = []
    for d, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((d, frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def plain_components(rows):
    sets = plain_sets(rows)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (d, a) in enumerate(sets):
        for j, (e, b) in enumerate(sets[:i]):
            if d is not None and e is not None and a and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if d is not None else None, d is None or d == least[find(i)]) for i, (d, s) in enumerate(sets)]


def near_rows():
    rng = random.Random(4)
    rows = odd_rows()
    for g in range(8):
        base = prose(700 + g, rng.choice([6, 30, 90, 200])).split()
        for _ in range(6):  # a chain: each a change of the last
            base = list(base)
            for _ in range(rng.choice([1, 2])):
                base[rng.randrange(len(base))] = f"new{rng.random()}"
            rows.append((rng.randint(1000, 10**9), " ".join(base), "en"))
    hot = prose(800, 150).split()
    for i in range(120):  # a large group of near copies
        own = list(hot)
        own[rng.randrange(150)] = f"own{i}"
        rows.append((2_000 + i, " ".join(own), "en"))
    rng.shuffle(rows)
    return rows


COLUMNS = ["doc_id", "n_shingles", "component_id", "kept"]


def test_near_copies(spark, empty):
    rows = near_rows()
    same(near_dup.cluster(frame(spark, rows).repartition(3)), plain_components(rows), COLUMNS)
    assert near_dup.cluster(empty).count() == 0
    assert near_dup.recall() > 0.99999


def test_near_copies_in_small_leaves_and_blocks(spark, monkeypatch):
    """Branching nodes and groups dealt over blocks give the same components."""
    rows = near_rows()
    monkeypatch.setattr(near_dup.confirmed_edges, "__kwdefaults__", {**near_dup.confirmed_edges.__kwdefaults__, "block": 7})
    same(near_dup.cluster(frame(spark, rows), leaf=4), plain_components(rows), COLUMNS)


def test_components(spark):
    rng = random.Random(2)
    edges = [(bytes([a]), bytes([a + 1])) for a in range(60)] + [(bytes([100 + rng.randrange(40)]), bytes([100 + rng.randrange(40)])) for _ in range(30)]
    got = {bytes(r.node): bytes(r.root) for r in components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    group = {x: {x} for e in edges for x in e}
    for a, b in edges:
        joined = group[a] | group[b]
        for x in joined:
            group[x] = joined
    assert got == {x: min(g) for x, g in group.items() if x != min(g)}


# -- the pipeline ------------------------------------------------------------------------

def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids, before = docs.columns, {r.doc_id for r in docs.collect()}, docs
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.written(stage(spark, before, sf), "stage")
        assert after.columns == columns, name
        assert after.count() <= before.count()
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, sf).collect()
    texts = {r.doc_id: r.text for r in before.collect()}
    assert {r.doc_id for r in last} == set(texts) <= ids
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in last)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, last))


def test_pipeline_on_odd_rows_and_empty_tables(spark, odd, empty):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf).columns == odd.columns and set(CLASHING) < set(odd.columns), name
        stage(spark, odd, sf).collect()
        assert stage(spark, empty, sf).count() == 0
