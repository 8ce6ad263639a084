import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallybook.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def transducer():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Transducer(f.read())


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    yield from ["", " ", "Hello World's don't I'LL  ", "a\x1cb\x1fc\x85d​e f　g", "<|endoftext|>x<|startoftext|> <|END", "ΑΣ ΣΑΣ", "İstanbul ß ﬁ Å é é", "1²½٣ⅷ", "日本語😀😀", "ªµº×÷ÀÞ", "_a_b__"]
    rnd = random.Random(3)
    for _ in range(60):
        yield "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz"[: rnd.randint(1, 26)]) for _ in range(rnd.randint(100, 9000)))
        yield "".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(160, 0x2FF), rnd.randint(0x400, 0x482), rnd.randint(0x4E00, 0x9000)])) for _ in range(200))
    for w in ("the", "an", "ha", "!", "é", "啊", "aaab"):
        yield w * 4000


def test_same_as_the_library(transducer, library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 1000)
    for s in texts():
        pieces, decoder = list(transducer.encode(s)), bpe.Decoder(transducer)
        ids = np.frombuffer(b"".join(pieces), "<u4").tolist()
        want = library.encode(s, add_special_tokens=False).ids
        assert ids == want
        decoded = library.decode(want, skip_special_tokens=False)
        assert "".join([*map(decoder.feed, pieces), decoder.feed(b"", True)]) == decoded
        one = bpe.Decoder(transducer)  # token by token
        assert "".join([*(one.feed(np.array([i], "<u4").tobytes()) for i in ids), one.feed(b"", True)]) == decoded


def test_pieces_of_bounded_size(transducer, library, monkeypatch):
    for name, value in (("PIECE", 500), ("CACHE_BYTES", 2000)):
        monkeypatch.setattr(bpe, name, value)
    for s in ("a1b2-c3!" * 900, "x" * 9000, "e\u0301" * 4000, "!'s" * 2000, "don't" * 900, "x'll've" * 900, "'" * 3000, "\u1100\u1161\u11a8" * 900, "a" * 499 + "\u0301" * 900 + "b", "-" * 1200 + "z" * 1200 + "7" * 30, "İΣ" * 900, "word " * 800 + "y1" * 3000, "été1" * 2000 + " end"):
        pieces = list(transducer.encode(s))
        assert np.frombuffer(b"".join(pieces), "<u4").tolist() == library.encode(s, add_special_tokens=False).ids
        assert max(map(len, pieces)) <= 4 * 2 * 500 + 4 * transducer.window and transducer.cached <= 2000 + 500 * (2 * bpe.ENTRY)


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1000])
def test_word_in_parts_and_whole_word_agree(transducer, size):
    """Whatever parts a word comes in, its tokens are those of merging it whole, which the transducer never does."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 900))) for letters in ("etaoinshr", "ab", "a", "the and of ing", "!?.-", "é日a") for _ in range(6)]
    for w in words:
        data = w.replace(" ", "").encode()
        parts = [data[i : i + size] for i in range(0, len(data), size)]
        assert b"".join(transducer.transduce(iter(parts))) == transducer.word(data.decode())


def test_tokens_leave_before_the_word_ends(transducer):
    """Tokens are out once the lookahead behind them is known, while the rest of their word is still to come."""
    word = "internationalisationsverständigungen" * 60
    taken, left = 0, []

    def parts():
        nonlocal taken
        for i in range(0, len(word.encode()), 40):
            taken += 40
            yield word.encode()[i : i + 40]

    for packed in transducer.transduce(parts()):
        left.append((taken, len(packed) // 4))
    assert left[0][0] <= transducer.lookahead + 80 and sum(n for t, n in left if t < len(word.encode()) * 0.8) > sum(n for _, n in left) / 2
    assert b"".join(transducer.transduce(iter([word.encode()]))) == transducer.word(word)


def test_cache_gives_what_the_transducer_gives(transducer, library):
    text = "some words come again and some words do not: " * 3
    transducer.cache.clear()
    first, again = (b"".join(transducer.encode(text)) for _ in range(2))
    assert first == again and all(ids == transducer.word(w) for w, ids in transducer.cache.items())


def test_memory_is_constant(transducer, monkeypatch):
    """Texts without white space, of a few characters again and again or of one: the peak doesn't grow with the text."""
    import tracemalloc

    monkeypatch.setattr(bpe, "PIECE", 1 << 12)

    def peak(text):
        tracemalloc.start()
        for _ in transducer.encode(text):
            pass
        _, most = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        return most

    transducer.cache.clear()
    small, large = (peak("ab1-" * n) for n in (1 << 13, 1 << 16))
    assert large < small * 1.2 + 1e5 and large < 2e6
    small, large = (peak("日" * n) for n in (1 << 13, 1 << 15))
    assert large < small * 1.2 + 1e5


def test_incremental_decoding(transducer):
    packed = b"".join(transducer.encode("Größe 日本 ok"))
    d = bpe.Decoder(transducer, plain=True)
    assert "".join([*(d.feed(packed[i : i + 4]) for i in range(0, len(packed), 4)), d.feed(b"", True)]) == "größe 日本 ok "


def test_table(spark, library):
    schema = "doc_id long, text string, n_tokens int, ids_sha256 string"  # clashing names are those of other columns
    rows = [(1, None, 9, "x"), (2, "Some words, some more", 9, None), (2, "Some words, some more", 9, None), (None, "z" * 5000, 9, "x")]
    out = {r.doc_id: r for r in bpe.encoded(spark.createDataFrame(rows, schema), PATH, tokens=True).collect()}
    want = library.encode(rows[1][1], add_special_tokens=False).ids
    assert list(out[2].token_ids) == want and out[2].n_tokens == len(want)
    assert out[2].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert out[1].n_tokens == 0 and out[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[None].n_tokens == len(library.encode("z" * 5000, add_special_tokens=False).ids)
    assert bpe.encoded(spark.createDataFrame([], schema), PATH).count() == 0
