"""Encoding with the tokenizers library, at the speed a corpus needs.

Most of a corpus is made of words seen before. With a byte-level BPE whose
pre-tokenizer keeps the space in front of a word, a text may be cut at every
single space between two characters that are not white space: neither the
pre-tokenizer's pattern nor the merges cross such a place. So a text is split
there, and each distinct piece is encoded once per worker. Most pieces are words,
numbers and marks, perhaps over a line's end: their parts go straight to the
library's model, as the pre-tokenizer would send them; any other piece goes
through the whole library. A text with other white space next to a space, and
every text of another kind of tokenizer, goes to the library whole. The strings
of added tokens (such as an end-of-text mark) are tokens wherever they stand in
a text, as the library has it; what is between them is encoded as above. All
ways give the same ids.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from operator import attrgetter

import numpy as np

#: Pieces of a table's generation, a bound on memory only: a full one becomes the old one, whose pieces move up when met.
CACHE_PIECES = 600_000
#: Characters encoded between two looks at the tables' sizes.
SLICE_CHARS = 1 << 20

_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
#: All ASCII marks but the apostrophe, with which the pre-tokenizer has special cases.
_MARK = "!-&(-/:-@\\[-`{-~"
#: A piece of words, numbers, marks and single line ends between them, and the tokens that the pre-tokenizer's pattern makes of it.
_PLAIN = re.compile(f"[{_LETTER}0-9{_MARK}]+(?:\n[{_LETTER}0-9{_MARK}]+)*")
_ENDS = frozenset(".,;:!?)]}\"")
_PARTS = re.compile(f"[{_LETTER}]+|[0-9]+|[{_MARK}]+|\n")


class _Unsafe(Exception):
    """A piece with white space at its edges."""


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is visible, else the next free one."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b if b in visible else 256 + sum(x not in visible for x in range(b)) for b in range(256)}


_LETTERS = _byte_letters()


def _letters(text: str) -> str:
    return text.encode().decode("latin-1").translate(_LETTERS)


class _Table(dict):
    """Ids by key, in two generations: `old` is looked at when a key isn't found."""

    def __init__(self, encoder: Encoder):
        self.old: dict[str, bytes] = {}
        tokenize, raw, id_of = encoder.tokenizer.model.tokenize, encoder.raw.__getitem__, attrgetter("id")
        self.joined = lambda letters: b"".join(map(raw, map(id_of, tokenize(letters))))

    def aged(self, encoder: Encoder) -> _Table:
        """This table, or where it is full a new one that has it as the old one."""
        if len(self) <= CACHE_PIECES:
            return self
        new, self.old = type(self)(encoder), {}
        new.old = self
        return new


class _Bare(_Table):
    """Ids of tokens of the pre-tokenizer without a space in front, by the model alone."""

    def __missing__(self, token: str) -> bytes:
        if (ids := self.old.get(token)) is None:
            ids = self.joined(token if token.isascii() and token != "\n" else _letters(token))
        self[token] = ids
        return ids


class _Pieces(_Table):
    """Ids of pieces with the space in front of them; a word is a piece, too."""

    def __init__(self, encoder: Encoder):
        super().__init__(encoder)
        self.bare, self.whole, self.space = encoder.bare, encoder.whole, _letters(" ")

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.old.get(piece)) is not None:
            pass
        elif piece.isalpha() and (piece.isascii() or max(piece) < "\u0180"):
            ids = self.joined(self.space + (piece if piece.isascii() else _letters(piece)))
        elif piece[-1:] in _ENDS and (word := piece[:-1]).isalpha() and (word.isascii() or max(word) < "\u0180"):
            ids = self[word] + self.bare[piece[-1]]
        elif _PLAIN.fullmatch(piece):
            head, *parts = _PARTS.findall(piece)
            if parts:
                ids = self[head] + b"".join(map(self.bare.__getitem__, parts))
            else:  # a number, or marks
                ids = self.joined(self.space + head)
        elif not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Unsafe
        else:
            ids = self.whole(" " + piece)
        self[piece] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.cuttable = (
            spec["model"]["type"] == "BPE"
            and not spec["model"].get("dropout")
            and spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex") is True
            and pre.get("add_prefix_space") is False
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", ()))
        )
        # Of several added tokens at one place, the longest is taken.
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        longest = sorted(self.added, key=len, reverse=True)
        self.cut_added = re.compile("(" + "|".join(map(re.escape, longest)) + ")").split if longest else None
        self.raw = [i.to_bytes(self.dtype.itemsize, "little") for i in range(size)]
        self.bare = _Bare(self)
        self.pieces = _Pieces(self)
        self.first: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _one(self, text: str) -> bytes:
        if not text or not self.cuttable:
            return self.whole(text) if text else b""
        if any(map(text.__contains__, self.added)):
            parts = self.cut_added(text)  # texts and added tokens in turn
            return b"".join(self.raw[self.added[x]] if k % 2 else self._between(x) for k, x in enumerate(parts))
        return self._between(text)

    def _between(self, text: str) -> bytes:
        """Ids of a text without the strings of added tokens."""
        head, *rest = text.split(" ")
        try:
            if rest and head and head[-1].isspace():
                raise _Unsafe
            tail = b"".join(map(self.pieces.__getitem__, rest))
        except _Unsafe:
            return self.whole(text)
        if head not in self.first:
            self.first[head] = self.whole(head) if head else b""
        return self.first[head] + tail

    def encode_raw(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text, in order, as little-endian integers of this encoder's type; a null text has none."""
        size = 0
        for text in texts:
            yield self._one(text or "")
            size += len(text or "")
            if size >= SLICE_CHARS:
                size = 0
                self.bare = self.bare.aged(self)
                self.pieces = self.pieces.aged(self)
                self.pieces.bare = self.bare
                if len(self.first) > CACHE_PIECES:
                    self.first.clear()

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for raw in self.encode_raw(texts):
            yield np.frombuffer(raw, dtype=self.dtype)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
