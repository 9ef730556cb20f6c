"""Exact BPE encoding by per-prefix dynamic programming, and decoding.

A piece (what the tokenizer's split leaves) is encoded left to right: for each
prefix, the tokens that end there (every suffix of the prefix that is in the
vocabulary, found as suffix matches) are tried, and the one whose predecessor -
the stored last token of the remaining prefix - is compatible with it is stored.
That last token is unique, so back-pointers give exactly the ids that the merge
list would. Two tokens are compatible if no merge rule would have joined a token
on the right edge of the first with one on the left edge of the second while both
were still there; merges happen in the order of their rank, so a token on an edge
lives from its own rank to its parent's.

Pieces are found within white-space words; a bounded memo per Python worker maps
a word to its packed ids and its decoded bytes. No shuffle, no driver state; the
vocabulary's file is read on each executor from the path given as a parameter.

Defined results: null and empty texts have no tokens (hash of the empty string);
the two special tokens' strings in a text become their ids, as in the library;
repeated documents each get a row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from simplexa.llm.common import by_id, kept_between_tasks, released

#: Words whose ids a worker keeps; the memo is emptied when it is full.
MEMO_WORDS = 250_000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_ODD_SPACE = regex.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


class Encoder:
    """Encoder and decoder of a word-end BPE file in the tokenizers library's JSON form."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.alphabet = dict(enumerate(byte_alphabet()))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pieces = regex.compile(split.replace(r"\s", r"\p{White_Space}")).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.rule: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token -> its parts and the rank of the merge that makes it
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rule[a, b] = rank
            self.made.setdefault(whole, (a, b, rank))
        # inner tokens, and those that end a word (keyed without the suffix), by their characters
        self.inner = {t: i for t, i in self.vocab.items() if not t.endswith(self.end)}
        self.final = {t[: -len(self.end)]: i for t, i in self.vocab.items() if t.endswith(self.end)}
        self.heads = {t[:n] for t in (*self.inner, *self.final) for n in range(len(t) + 1)}
        # the automaton, grown as texts need it; a state is the longest suffix of what was read that begins a token
        self.state = {"": 0}
        self.suffix = [""]
        self.step: list[dict[str, int]] = [{}]
        self.ends: list[tuple[tuple[int, int], ...] | None] = [()]  # inner tokens that end in a state, longest first, with their lengths
        self.ends_word: list[tuple[tuple[int, int], ...] | None] = [()]
        self.packed = {i: i.to_bytes(4, "little") for i in self.token}
        self.said = {i: t.encode() for i, t in self.token.items()}
        self.fits: dict[int, bool] = {}
        self.left = lru_cache(None)(lambda t: self._edge(t, 0))
        self.right = lru_cache(None)(lambda t: self._edge(t, 1))
        self.whole = lru_cache(None)(self._whole)
        self.memo: dict[str, tuple[bytes, bytes]] = {}
        self.parts: dict[str, tuple[bytes, bytes]] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens on one edge of a token's merge tree, each with the rank at which it is merged away."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self.made:
                return out
            until, token = self.made[token][2], self.made[token][side]

    def _apart(self, a: int, b: int, limit: float, own: tuple[int, int] | None = None) -> bool:
        """No rule of a rank below ``limit`` joins a's right edge with b's left edge while both tokens live."""
        rule = self.rule.get
        for x, x_until in self.right(a):
            for y, y_until in self.left(b):
                rank = rule((x, y))
                # at equal rank the merge further left comes first: x's own wins, y's loses
                if rank is not None and (x, y) != own and rank < min(x_until, limit) and rank <= min(y_until, limit):
                    return False
        return True

    def _whole(self, token: int) -> bool:
        """Whether the merges make this token of its own characters."""
        if token not in self.made:
            return True
        a, b, rank = self.made[token]
        return self.whole(a) and self.whole(b) and self._apart(a, b, rank, (a, b))

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            found = self.fits[key] = self._apart(a, b, float("inf"))
        return found

    def _enter(self, state: int, char: str) -> int:
        """The state after one more character."""
        read = self.suffix[state] + char
        while read not in self.heads:
            read = read[1:]
        to = self.state.get(read)
        if to is None:
            to = self.state[read] = len(self.suffix)
            self.suffix.append(read)
            self.step.append({})
            for ends, known in ((self.ends, self.inner), (self.ends_word, self.final)):
                found = ((known.get(read[i:]), len(read) - i) for i in range(len(read)))
                ends.append(tuple((t, n) for t, n in found if t is not None and self.whole(t)))
        self.step[state][char] = to
        return to

    def piece(self, text: str) -> list[int]:
        """Ids of a piece given in the byte alphabet."""
        n = len(text)
        last = [-1] * (n + 1)  # the unique last token of each prefix
        size = [0] * (n + 1)
        fits, step, ends, state = self.fits, self.step, self.ends, 0
        for i in range(1, n + 1):
            char = text[i - 1]
            state = step[state].get(char) or self._enter(state, char)
            for token, long in ends[state] if i < n else self.ends_word[state]:
                if long == i:
                    last[i], size[i] = token, long
                    break
                before = last[i - long]
                if before >= 0:
                    ok = fits.get(before << 20 | token)
                    if ok or ok is None and self.compatible(before, token):
                        last[i], size[i] = token, long
                        break
        out, i = [], n
        while i:
            out.append(last[i])
            i -= size[i]
        return out[::-1]

    def ids(self, text: str) -> list[int]:
        return list(array("I", self.encode(text)[0]))

    def decode(self, ids: list[int]) -> str:
        """As the library does for a file without a decoder: the tokens, blank-separated."""
        return " ".join(self.token[i] for i in ids)

    def _word(self, word: str) -> tuple[bytes, bytes]:
        """Packed ids and decoded bytes of a white-space word."""
        if not word.isascii():
            word = unicodedata.normalize("NFC", word).replace("Σ", "σ")
        word = word.lower()
        if word.isalpha():
            return self._part(word)
        found = self.pieces(word)
        if len(found) == 1:
            return self._part(found[0])
        both = [self._part(p) for p in found]
        return b"".join(x[0] for x in both), b" ".join(x[1] for x in both)

    def _part(self, piece: str) -> tuple[bytes, bytes]:
        out = self.parts.get(piece)
        if out is None:
            if len(self.parts) > MEMO_WORDS:
                self.parts.clear()
            ids = self.piece(piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(self.alphabet))
            out = self.parts[piece] = b"".join([self.packed[i] for i in ids]), b" ".join([self.said[i] for i in ids])
        return out

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text in UTF-8."""
        chunks = self.specials.split(text) if self.specials is not None and "<|" in text else [text]
        ids: list[bytes] = []
        said: list[bytes] = []
        for chunk in chunks:
            if chunk in self.special:
                ids.append(array("I", [self.special[chunk]]).tobytes())
                said.append(chunk.encode())
                continue
            words = [chunk] if _ODD_SPACE.search(chunk) else chunk.split()
            memo = self.memo
            try:
                both = [memo[w] for w in words]
            except KeyError:
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                both = []
                for w in words:
                    if (x := memo.get(w)) is None:
                        x = memo[w] = self._word(w)
                    both.append(x)
            ids += [x[0] for x in both]
            said += [x[1] for x in both if x[1]]
        return b"".join(ids), b" ".join(said)


_encoders: dict[str, Encoder] = kept_between_tasks()


def encoder(path: str) -> Encoder:
    """This worker's encoder, until a task of another operator releases it."""
    released(_encoders)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def digests(path: str):
    """A mapInArrow function over (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            n, ids_hash, said_hash = [], [], []
            for text in batch.column(1):
                ids, said = e.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                said_hash.append(hashlib.sha256(said).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(said_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def tokens(path: str):
    """A mapInArrow function over (doc_id, text) that returns the ids and the decoded text themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            both = [e.encode(text.as_py() or "") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([list(array("I", x[0])) for x in both], pa.list_(pa.int32())), pa.array([x[1].decode() for x in both], pa.string())], names=["doc_id", "ids", "decoded"]
            )

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded), a row a document."""
    return by_id(docs).mapInArrow(tokens(path), "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), a row a document, without the ids leaving the worker."""
    return by_id(docs).mapInArrow(digests(path), SCHEMA)
