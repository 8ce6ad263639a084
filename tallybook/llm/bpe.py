"""BPE as a bounded-lookahead streaming transducer, and an incremental decoder.

From the merge list alone follows how many bytes to the right can still change a token boundary: a merge
(a, b) can only be prevented by an earlier merge (s, x) whose s is on the right edge of b, which an earlier
one can prevent in turn, and so on with falling ranks. The longest such chain that begins at a token's right edge is the lookahead that suffices behind
it; the longest of all bounds the window. Every word goes through the transducer, its bytes as they come: tokens leave
once the lookahead behind them is known, which for long words is before the word ends, and tokenization goes
on from there, since the pieces on both sides of a final boundary merge independently. A cache of words spares the second time.

Texts are normalised and cut into words piece by piece, and a word may go on from piece to piece. So beside the text that Spark hands
over, memory is constant: one piece and its tokens, one window, the rule table and a cache of words of bounded bytes. (Only a run of apostrophes without any other
character is one piece however long it is.) The decoder is a state machine that takes the tokens as the encoder emits them.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm.arrow import map_batches
from tallybook.session import table

#: Bytes of the cache of words before it is emptied, counting ENTRY for what Python adds to each word.
CACHE_BYTES, ENTRY = 64 << 20, 160
#: Characters of a text handled at once; pieces are cut at white space, which no word crosses. Without any, they are cut inside words.
PIECE = 1 << 20
#: Characters of the longest word that is kept whole, and bytes of a longer one that are taken in at once to begin with.
WHOLE, STEP = 128, 64

# Fixed values of the tokenizer's format: contractions, and white space as its regular expressions know it.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_SPACE = r"\t-\r \x85\xa0  -     　"
_ASCII = re.compile(rf"{_CONTRACTIONS}|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_LATIN = re.compile(rf"{_CONTRACTIONS}|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")

#: Characters that Unicode added after 15.1 may be classed otherwise than in the library.
_ANY = regex.compile(rf"{_CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")


@cache
def byte_characters() -> list[str]:
    """The visible character that stands for each byte: itself where printable in Latin-1, else from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


_BLANK = re.compile(f"[{_SPACE}]")


def word_pattern(text: str):
    """The pattern that finds the words of a normalised text, as simple as its characters allow."""
    if text.isascii():
        return _ASCII
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _ANY
    return _LATIN


#: How a run of letters and a run of neither letters, digits nor white space go on.
_RUNS = [regex.compile(r"\p{L}+"), regex.compile(rf"[^{_SPACE}\p{{L}}\p{{N}}]+")]
_SHORT = re.compile(_CONTRACTIONS)
#: Characters before which a text can be normalised in two parts: none of them is ever joined to what is before it.
_APART = regex.compile(r"[\x00-\u02FF\u3400-\u9FFF\uAC00-\uD7A3]")


def text_pieces(text: str, start: int = 0, end: int | None = None) -> Iterator[str]:
    """Normalised pieces of text[start:end], of about PIECE characters: cut before white space, or without any before a character that nothing joins, and not inside a contraction."""
    end = len(text) if end is None else end
    while end - start > PIECE:
        blank = _BLANK.search(text, start + PIECE, min(end, start + 2 * PIECE))
        cut = blank.start() if blank else start + PIECE
        while not blank and cut < end and not (_APART.match(text, cut) and ("'" not in text[cut - 2 : cut] or _SHORT.fullmatch(text, cut - 2, cut))):
            cut += 1
        if cut >= end:
            break
        yield normalised(text[start:cut])
        start = cut
    yield normalised(text[start:end])


def normalised(text: str) -> str:
    """NFC and lower case, each character by itself (no final sigma)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


class Transducer:
    """Encoder and decoder for a tokenizer file's vocabulary and merges with a word-end suffix."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: t for t, i in (vocab | self.special).items()}
        #: For each id its text and the space before the next, as UTF-8.
        self.printed = [strings.get(i, "").encode() + b" " for i in range(max(strings) + 1)]
        characters = byte_characters()
        self.inner = [vocab[c] for c in characters]
        self.final = [vocab[c + self.suffix] for c in characters]
        back = {c: b for b, c in enumerate(characters)}
        self.raw = [b""] * len(self.printed)
        for t, i in vocab.items():
            word, end = (t.removesuffix(self.suffix), b" " * t.endswith(self.suffix))
            self.raw[i] = bytes(back[c] for c in word) + end
        for t, i in self.special.items():
            self.raw[i] = t.encode()
        #: (left id, right id) -> rank and merged id in one number each.
        self.rules: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        for rank, (a, b) in enumerate(merges):
            made = vocab[a + b]
            self.rules[vocab[a] << 20 | vocab[b]] = rank << 20 | made
            self.parts.setdefault(made, (vocab[a], vocab[b]))
        self.reach = self._reach(merges, vocab)
        self.lookahead = max(self.reach.values(), default=0) + 1
        self.window = max(256, 4 * self.lookahead)
        self.behind: dict[int, int] = {}
        self.cache: dict[str, bytes] = {}
        self.cached = 0
        self._cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def _reach(self, merges: list, vocab: dict[str, int]) -> dict[int, int]:
        """For each symbol the most bytes behind it that a rule with it on the left depends on."""
        reach: dict[int, int] = {}
        for a, b in merges:
            left, right = vocab[a], vocab[b]
            reach[left] = max(reach.get(left, 0), len(self.raw[right].rstrip(b" ")) + self._edge(right, reach))
        return reach

    def _edge(self, symbol: int, reach: dict[int, int]) -> int:
        """The most that `reach` says of the symbols on the right edge of a symbol, itself included."""
        need = 0
        while True:
            need = max(need, reach.get(symbol, 0))
            if symbol not in self.parts:
                return need
            symbol = self.parts[symbol][1]

    def _behind(self, symbol: int) -> int:
        """The bytes that have to be known behind a token before it can leave: one at least, as a word's last byte is another symbol."""
        if symbol not in self.behind:
            self.behind[symbol] = max(1, self._edge(symbol, self.reach))
        return self.behind[symbol]

    def _merged(self, ids: list[int]) -> list[int]:
        """The merge process on the symbols of a window: always the earliest rule, from the left."""
        rules = self.rules
        none = 1 << 60
        if len(ids) < 2:
            return ids
        ranks = [rules.get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while True:
            best = min(ranks)
            if best == none:
                return ids
            made = best & 0xFFFFF
            i = ranks.index(best)
            while True:
                ids[i : i + 2] = [made]
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = rules.get(made << 20 | ids[i + 1], none)
                if i:
                    ranks[i - 1] = rules.get(ids[i - 1] << 20 | made, none)
                if not ranks:
                    return ids
                try:
                    i = ranks.index(best, i)
                except ValueError:
                    break

    def word(self, word: str) -> bytes:
        """The ids of one word of the window's size at most, as little-endian 32-bit numbers."""
        data = word.encode("utf-8", "replace")
        ids = [self.inner[b] for b in data]
        ids[-1] = self.final[data[-1]]
        return np.array(self._merged(ids), "<u4").tobytes()

    def transduce(self, parts: Iterator[bytes]) -> Iterator[bytes]:
        """The ids of one word that comes in parts, as soon as they are stable; memory is that of a part and the lookahead."""
        held = b""
        following = next(parts, None)
        while following is not None:
            held, following = held + following, next(parts, None)
            if following is None:
                break
            ids, length, out = self._merged([self.inner[b] for b in held]), 0, []
            for i in ids:
                if len(held) - length - len(self.raw[i]) < self._behind(i):
                    break
                length += len(self.raw[i])
                out.append(i)
            if out:
                yield np.array(out, "<u4").tobytes()
                held = held[length:]
        if held:
            ids = [self.inner[b] for b in held]
            ids[-1] = self.final[held[-1]]
            yield np.array(self._merged(ids), "<u4").tobytes()

    def stepped(self, texts: Iterator[str]) -> Iterator[bytes]:
        """The bytes of a long word in parts that grow from STEP to the window, as little is gained by steps far below the lookahead."""
        size = STEP
        for text in texts:
            at = 0
            while at < len(text):
                yield text[at : at + size].encode("utf-8", "replace")
                at += size
                size = min(2 * size, self.window // 4)

    def _words(self, words: list[str]) -> Iterator[bytes]:
        cache = self.cache
        fresh = set(words).difference(cache)
        long_ = {w for w in fresh if len(w) > WHOLE}
        for w in fresh - long_:
            cache[w] = ids = b"".join(self.transduce(iter((w.encode("utf-8", "replace"),))))
            self.cached += len(w) + len(ids) + ENTRY
        if not long_:
            yield b"".join([cache[w] for w in words])
        else:
            for w in words:
                if w in long_:
                    yield from self.transduce(self.stepped(iter((w,))))
                else:
                    yield cache[w]
        if self.cached > CACHE_BYTES:
            cache.clear()
            self.cached = 0

    def encode(self, text: str) -> Iterator[bytes]:
        """Yield the ids of a text piece by piece, as packed bytes; special strings in it are their own ids."""
        at = 0
        for special in self._cut.finditer(text) if self._cut is not None else ():
            yield from self._span(text, at, special.start())
            yield self.special[special[0]].to_bytes(4, "little")
            at = special.end()
        yield from self._span(text, at, len(text))

    def _span(self, text: str, start: int, end: int) -> Iterator[bytes]:
        pieces = text_pieces(text, start, end)
        piece, following = next(pieces, ""), next(pieces, None)
        while piece or following is not None:
            words = word_pattern(piece).findall(piece)
            last = words[-1] if words else ""
            if following is None or not piece.endswith(last) or not last or _BLANK.match(following) or _SHORT.fullmatch(last):
                yield from self._words(words)
                piece, following = following or "", next(pieces, None)
                continue
            # The last word may go on in the pieces to come.
            yield from self._words(words[:-1])
            run = next((r for r in _RUNS if r.match(last)), None)
            rest: list[str] = []

            def going_on() -> Iterator[str]:
                nonlocal following
                yield last
                while following is not None:
                    goes = run.match(following) if run else None
                    upto = goes.end() if goes else 0
                    yield following[:upto]
                    if upto < len(following):
                        rest.append(following[upto:])
                        following = next(pieces, None)
                        return
                    following = next(pieces, None)

            yield from self.transduce(self.stepped(going_on()))
            piece = rest[0] if rest else ""


class Decoder:
    """Ids to text, incrementally. State: whether a token came before, and the bytes of a character whose rest is still to come.

    The tokenizer's file has no decoder of its own, so the library prints the tokens' strings with a space between
    them; plain gives what the tokens stand for instead, the normalised text.
    """

    def __init__(self, transducer: Transducer, plain: bool = False):
        self.strings = transducer.raw if plain else transducer.printed
        self.between, self.begun = not plain, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, packed: bytes, last: bool = False) -> str:
        """The text that packed ids complete; last: nothing follows, so what is incomplete is replaced."""
        strings = self.strings
        data = b"".join([strings[i] for i in np.frombuffer(packed, "<u4").tolist()])
        if self.between and data:
            data = (b" " if self.begun else b"") + data[:-1]  # the space after the last token waits for the next one
            self.begun = True
        return self.utf8.decode(data, last)


_LOADED: dict[str, Transducer] = {}


def loaded(spec: str) -> Transducer:
    """One transducer for each worker and file."""
    name = hashlib.md5(spec.encode()).hexdigest()
    if name not in _LOADED:
        _LOADED[name] = Transducer(spec)
    return _LOADED[name]


def encoded(docs: DataFrame, tokenizer_json: str, key: str = "doc_id", text: str = "text", tokens: bool = False, carry: str | None = None) -> DataFrame:
    """One row per row: key, n_tokens, ids_sha256, decoded_sha256, token_ids where tokens is set, and the column `carry` as it is.

    tokenizer_json: path of the tokenizer's file, which the driver reads and broadcasts (a few MB at any input
    size). A null text is empty and has no tokens; equal texts give equal values; an empty table gives no
    rows; other columns are ignored.
    """
    with open(tokenizer_json, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    holder: list[Transducer] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not holder:
            holder.append(loaded(spec.value))
        t = holder[0]
        counts, ids_sha, text_sha, ids = [], [], [], []
        for s in batch.column(1).to_pylist():
            h, d, n, kept, decoder = hashlib.sha256(), hashlib.sha256(), 0, [], Decoder(t)
            for packed in t.encode(s or ""):
                h.update(packed)
                d.update(decoder.feed(packed).encode())
                n += len(packed) // 4
                if tokens:
                    kept.append(packed)
            d.update(decoder.feed(b"", True).encode())
            counts.append(n)
            ids_sha.append(h.hexdigest())
            text_sha.append(d.hexdigest())
            if tokens:
                ids.append(np.frombuffer(b"".join(kept), "<u4").astype(np.int32))
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
        names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
        if tokens:
            columns.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("token_ids")
        if carry:
            columns.append(batch.column(2))
            names.append(carry)
        return pa.record_batch(columns, names=names)

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * tokens
    schema += f", `{carry}` {docs.schema[carry].dataType.simpleString()}" if carry else ""
    kept = [F.col(f"`{carry}`").alias("_carry")] if carry else []
    return map_batches(docs.select(F.col(key), F.col(text).cast("string").alias("_text"), *kept), run, schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op4_bpe": op4_bpe}
