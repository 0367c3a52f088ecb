"""The piece table, the coder's mixture and the models of a token file."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from logweave.llm import files, piece_table, range_coder, token_files

JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("limit", [30, piece_table.LIMIT])
def test_pieces_have_the_ids_they_have_in_their_text(limit, monkeypatch):
    monkeypatch.setattr(piece_table, "AT_ONCE", 5000)
    odd = [" ", " ", "\n", "\t", "\r", "'", "'s", "'ll", "\x00", "\x0b", "\x1c", "\x7f", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u200b", "\u202f", "\u205f", "\u3000",
           "\ufeff", "\xe9", "\xdf", "\xd7", "\xf7", "\xaa", "\xb2", "\xff", "\u0100", "e\u0301", "\u201d", "\u2026", "\u044f", "\u65e5\u672c", "\u306e", "\U0001f600", "a", "Ab", "of",
           "the", "7", "12", ".", ",", "!!", "_", "(", "<|", "|>", "<|endoftext|>", "x" * 30, "\u044f" * 40]
    rng = random.Random(5)
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(14))) for _ in range(6000)]
    texts += ["\n", "\n\n", "a\n", "\na", "'", " ", "", *odd, "a\0b", "a\0\0"]
    library = Tokenizer.from_file(JSON)
    for special in (True, False):
        library.encode_special_tokens = not special
        own = token_files.Tokens(JSON, special)
        own.table.limit = limit
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        for _ in range(2):  # new pieces, then those that are held
            assert [x.tolist() for x in own(texts)] == want
        assert own.table.n <= limit


def test_words_are_known_whatever_marks_are_around_them():
    class Counting:
        def __init__(self, own):
            self.own, self.sent = own, 0

        def encode_batch_fast(self, texts, **kw):
            self.sent += sum(map(len, texts))
            return self.own.encode_batch_fast(texts, **kw)

    own = token_files.Tokens(JSON)
    own.tokenizer = Counting(own.tokenizer)
    words = [f"({a}{b}{end}\n" for a in "abcdefgh" for b in ("ing", "tion", "ä", "er") for end in ("", ",", ".", "!!", ";", "'", "?", "...")]
    text = " ".join(words)
    assert own([text])[0].tolist() == Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids
    assert own.tokenizer.sent < len(text) // 5


def test_an_id_has_the_share_that_the_mixture_gives_it():
    rng = np.random.default_rng(2)
    ids = np.where(rng.random((300, 40)) < 0.7, np.arange(300)[:, None] % 7, rng.integers(0, 30, (300, 40))).astype(np.uint16)
    model = range_coder.Model.of(ids)
    seen = set()
    for t in range(2, 60):
        # Every id in turn after one history: the parts abut and fill the interval.
        tried = np.repeat(ids[t - 2:t + 1, :1], len(model.present), axis=1)
        tried[2] = model.present
        start, size = model.shares(tried, 2, 3)
        assert (size > 0).all() and start[0, 0] == 0
        assert (np.append(start[0, 1:], 1 << range_coder.IDS_BITS + range_coder.WEIGHT_BITS) == start[0] + size[0]).all()
        c1, c2, kind = model.predict(tried[:1].astype(np.uint32), tried[1:2].astype(np.uint32))
        seen.add((c1 == c2)[0, 0])
    assert True in seen
    blocks = range_coder.encode_by(model, ids)
    again = range_coder.Model.unpack(model.pack())
    assert (range_coder.decode_by(again, blocks, 300) == ids).all()
    assert (range_coder.decode_by(again, blocks[7:8], 300) == ids[:, 7:8]).all()  # alone, with the model


def test_blocks_learn_from_each_other(tmp_path):
    rng = np.random.default_rng(1)
    share = 1 / np.arange(1, 3001)
    ids = rng.choice(3000, 1 << 17, p=share / share.sum()).astype("<u2")
    bits = -(share / share.sum() * np.log2(share / share.sum())).sum()
    path, out = files.new_file(str(tmp_path), ".ids")
    writer = token_files.Writer(out)
    writer.add(1, ids)
    writer.close()
    assert writer.at < 1.1 * len(ids) * bits / 8
    (doc, parts), = token_files.read_documents(path)
    assert doc == 1 and (np.concatenate(parts) == ids).all()


@pytest.mark.parametrize("place", ["model", "block"])
def test_damage_is_found_in_models_and_blocks(tmp_path, place):
    path, out = files.new_file(str(tmp_path), ".ids")
    writer = token_files.Writer(out, block=16, lanes=4)
    for d in range(30):
        writer.add(d, np.arange(d, d + 10).astype("<u2"))
    writer.close()
    raw = bytearray(open(path, "rb").read())
    raw[raw.rfind(token_files.MODEL_MAGIC if place == "model" else token_files.BLOCK_MAGIC) + 17] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError):
        list(token_files.read_documents(path))
