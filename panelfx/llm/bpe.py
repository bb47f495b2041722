"""Byte-pair encoding and decoding as streams with bounded memory.

Encoding is a transducer with bounded lookahead. Text that follows can only change the end of what has been merged: the
first merge that differs takes the last token, the next one to its left must come later in the merge list and its right
side must begin with that token, and so on. The longest such chain of merges, measured in symbols, is the lookahead:
boundaries that far from the end are final and what stands before them can be emitted. Decoding turns tokens into bytes
and bytes into text with an incremental state machine that keeps at most one unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import regex
from pyspark.sql import DataFrame

from .common import keyed, per_row

_BITS = 20
_MASK = (1 << _BITS) - 1
_NONE = 1 << 62
_PIECE = 1 << 16
#: Entries of each cache, and the longest stretch that enters one.
_KNOWN = 1 << 18
_SHORT = 64


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, extra = [], 256
    for b in range(256):
        letters.append(chr(b if b in plain else extra))
        extra += b not in plain
    return letters


def lookahead(merges: Iterable[tuple[str, str]], symbols) -> int:
    """Symbols from the end of a text at which boundaries are final whatever follows (see the module's text).

    ``symbols`` splits a token into its symbols. One pass over the merges in order: a chain that ends in a merge extends
    the longest earlier chain whose last left side begins this merge's right side.
    """
    chain: dict[tuple, int] = {}
    longest = 1
    for left, right in merges:
        a, b = symbols(left), symbols(right)
        here = len(a) + max((chain.get(b[:k], 0) for k in range(1, len(b) + 1)), default=0)
        chain[a] = max(chain.get(a, 0), here)
        longest = max(longest, here)
    return longest


class Transducer:
    """Merges symbols to tokens. ``pairs`` maps (left id, right id) to (rank, merged id); ``size`` gives a token's symbols."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], size: dict[int, int], ahead: int) -> None:
        self._pairs = {a << _BITS | b: rank << _BITS | c for (a, b), (rank, c) in pairs.items()}
        self._size = size
        self.ahead = ahead

    def merge(self, symbols: list[int]) -> list[int]:
        """All merges of a bounded run, lowest rank first and leftmost first among equals."""
        get = self._pairs.get
        out = list(symbols)
        ranks = [get(a << _BITS | b, _NONE) for a, b in zip(out, out[1:])]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            out[i:i + 2] = [best & _MASK]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(out[i] << _BITS | out[i + 1], _NONE)
            if i:
                ranks[i - 1] = get(out[i - 1] << _BITS | out[i], _NONE)
        return out

    def stream(self, symbols: Iterable[int]) -> Iterator[int]:
        """Tokens of a run of any length, each as soon as it is final; at most twice the lookahead is held."""
        held: list[int] = []
        for s in symbols:
            held.append(s)
            if len(held) < 2 * self.ahead:
                continue
            done = 0
            for token in self.merge(held):
                if done + self._size[token] > len(held) - self.ahead:
                    break
                done += self._size[token]
                yield token
            held = held[done:]
        yield from self.merge(held)


class Tokenizer:
    """A word-level byte BPE as stored in a tokenizer JSON file: specials, NFC, lower case, words, bytes, merges."""

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        size = {i: len(self._symbols(t)) for t, i in vocab.items()}
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            pairs[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.transducer = Transducer(pairs, size, lookahead(merges, self._symbols))
        letters = byte_letters()
        self._inner = [vocab.get(c) for c in letters]
        self._last = [vocab.get(c + self.end) for c in letters]
        self._bytes = {c: b for b, c in enumerate(letters)}
        self._words = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self._cuts = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self._controls = regex.compile("[\x1c-\x1f]")
        self._gap = regex.compile(r"[ \t\n]")
        self._known: dict[str, tuple[int, ...]] = {}
        self._chunks: dict[str, tuple[int, ...]] = {}

    def _symbols(self, token: str) -> tuple[str, ...]:
        end = self.end
        if end and token.endswith(end) and token != end:
            return (*token[:-len(end) - 1], token[-len(end) - 1:])
        return tuple(token)

    def _word(self, word: str) -> tuple[int, ...] | Iterator[int]:
        data = word.encode("utf-8", "surrogatepass")
        ids = [self._inner[b] for b in data[:-1]]
        ids.append(self._last[data[-1]])
        ids = [i for i in ids if i is not None]
        if len(ids) > 2 * self.transducer.ahead:
            return self.transducer.stream(ids)
        known = tuple(self.transducer.merge(ids))
        if len(word) > _SHORT:
            return known
        if len(self._known) >= _KNOWN:
            self._known.clear()
        self._known[word] = known
        return known

    def _pieces(self, text: str) -> Iterator[str]:
        """Parts of bounded size that begin with white space, where neither words nor normal forms are cut."""
        at = 0
        while len(text) - at > _PIECE:
            gap = self._gap.search(text, at + _PIECE)
            if gap is None:
                break
            yield text[at:gap.start()]
            at = gap.start()
        yield text[at:]

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a short stretch without white space; words and stretches that come again are looked up."""
        ids: list[int] = []
        for word in self._words.findall(chunk):
            ids.extend(self._known.get(word) or self._word(word))
        if len(self._chunks) >= _KNOWN:
            self._chunks.clear()
        self._chunks[chunk] = out = tuple(ids)
        return out

    def _plain(self, text: str) -> Iterator[list[int]]:
        chunks = self._chunks
        for piece in self._pieces(text):
            if not unicodedata.is_normalized("NFC", piece):
                piece = unicodedata.normalize("NFC", piece)
            # lower case letter by letter: the final sigma is no special case
            piece = piece.replace("Σ", "σ").lower()
            out: list[int] = []
            # split() also cuts at four control characters that are no white space here
            for chunk in [piece] if self._controls.search(piece) else piece.split():
                if len(chunk) <= _SHORT:
                    got = chunks.get(chunk)
                    out.extend(self._chunk(chunk) if got is None else got)
                    continue
                for m in self._words.finditer(chunk):
                    out.extend(self._known.get(m.group()) or self._word(m.group()))
                    if len(out) > _PIECE:
                        yield out
                        out = []
            yield out

    def encode(self, text: str | None) -> Iterator[list[int]]:
        """Token ids in blocks; null and empty texts have none."""
        text = text or ""
        at = 0
        if self._cuts is not None and "<" in text:
            for cut in self._cuts.finditer(text):
                yield from self._plain(text[at:cut.start()])
                yield [self.special[cut.group()]]
                at = cut.end()
        yield from self._plain(text[at:])

    def decoder(self, joined: bool = False) -> "Decoder":
        return Decoder(self, joined)


class Decoder:
    """Ids to text, fed in blocks. ``joined``: the tokens as the vocabulary writes them, with spaces between."""

    def __init__(self, tokenizer: Tokenizer, joined: bool) -> None:
        self._text = tokenizer.text_of
        self._joined = joined
        self._first = True
        self._state = codecs.getincrementaldecoder("utf-8")("replace")
        self._end, self._byte, self._special = tokenizer.end, tokenizer._bytes, set(tokenizer.special.values())

    def _raw(self, i: int) -> bytes:
        token = self._text[i]
        if i in self._special:
            return token.encode() + b" "
        stop = bool(self._end) and token.endswith(self._end)
        return bytes(self._byte[c] for c in (token[:-len(self._end)] if stop else token)) + b" " * stop

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        if not self._joined:
            return self._state.decode(b"".join(map(self._raw, ids)))
        text = " ".join(map(self._text.__getitem__, ids))
        if not self._first:
            text = " " + text
        self._first = False
        return text

    def finish(self) -> str:
        return "" if self._joined else self._state.decode(b"", True)


def load(path: str) -> bytes:
    """The tokenizer file, read on the driver and sent compressed with the tasks: its size is that of the vocabulary."""
    with open(path, "rb") as f:
        return zlib.compress(f.read())


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids: the token ids of every whole text; null and empty texts give an empty array. One row a row."""
    packed = load(path)
    src = keyed(docs, doc_id, text).toDF("doc_id", "text")

    def make():
        tok = Tokenizer(zlib.decompress(packed))
        return lambda r: (r["doc_id"], [i for block in tok.encode(r["text"]) for i in block])

    return per_row(src, make, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, text: words in lower case with one space after each; null and empty arrays give an empty text."""
    packed = load(path)
    src = keyed(encoded, doc_id, ids).toDF("doc_id", "ids")

    def make():
        tok = Tokenizer(zlib.decompress(packed))

        def row(r: dict) -> tuple:
            state = tok.decoder()
            return r["doc_id"], state.feed(r["ids"] or []) + state.finish()
        return row

    return per_row(src, make, "doc_id long, text string")


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, for comparing two encodings of a corpus.

    Blocks of ids go from the encoder through the decoder into the two hashes, so nothing but a block is held. The ids
    are hashed as decimals with one space between, the decoded text as the tokens with one space between.
    """
    packed = load(path)
    src = keyed(docs, doc_id, text).toDF("doc_id", "text")

    def make():
        tok = Tokenizer(zlib.decompress(packed))

        def row(r: dict) -> tuple:
            n, one, two, state = 0, hashlib.sha256(), hashlib.sha256(), tok.decoder(joined=True)
            for block in tok.encode(r["text"]):
                if block:
                    one.update(((" " if n else "") + " ".join(map(str, block))).encode())
                    two.update(state.feed(block).encode())
                    n += len(block)
            two.update(state.finish().encode())
            return r["doc_id"], n, one.hexdigest(), two.hexdigest()
        return row

    return per_row(src, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")




def recode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them, of every whole text; nulls as in ``encode``."""
    packed = load(path)
    src = keyed(docs, doc_id, text).toDF("doc_id", "text")

    def make():
        tok = Tokenizer(zlib.decompress(packed))

        def row(r: dict) -> tuple:
            state, ids, parts = tok.decoder(), [], []
            for block in tok.encode(r["text"]):
                ids += block
                parts.append(state.feed(block))
            return r["doc_id"], len(ids), ids, "".join(parts) + state.finish()
        return row

    return per_row(src, make, "doc_id long, n_tokens long, ids array<int>, text string")
