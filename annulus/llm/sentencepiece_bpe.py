"""Operator 13: SentencePiece encoding and decoding for merge-type vocabularies.

The vocabulary's merges are applied here: a text's characters are symbols, an
agenda holds every pair of adjacent symbols whose joined string is a piece, the
pair with the best score is merged first (of equal scores the leftmost), and the
new symbol's pairs with its neighbours join the agenda, until none is left.
Characters outside the vocabulary become their UTF-8 bytes' pieces.

No piece of such a vocabulary has a space mark behind another character, or marks
beside letters, or digits and line ends beside anything, so no merge crosses such
places (this is looked up in the vocabulary, not assumed). A text is cut there, and
each distinct segment goes through the agenda once per worker: those of up to WIDE
characters together, a row of costs for each, of which every round takes the best;
longer ones each with a heap, whose work grows with n log n. Decoding joins the
pieces' bytes of a whole slice at once. Spark deals out the rows; a worker sees
Arrow batches and gives its results back in slices of bounded size. There is no
shuffle and no state besides the table of segments, whose size is bounded.

With `verify`, each slice's texts also go through the sentencepiece library,
both ways, and `verified` says whether ids and decoded text are the same.

Defined cases: a null text counts as the empty one, which has no ids and decodes
to the empty text; repeated rows are encoded each for itself; an empty table
gives an empty table. Columns of the input named `ids`, `decoded` or `verified`
are replaced, all others stay. A text may hold the space mark U+2581 itself: it
is encoded as a space and decodes to one, as in the library.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: What the library writes for a space, an unknown id and a byte that is no UTF-8 (fixed values).
SPACE, UNKNOWN, BAD_BYTE = "▁", " ⁇ ", "�"
#: Segments in a generation of the table: a bound on memory only.
CACHE_SEGMENTS = 400_000
#: Characters of segments whose agendas are worked off together, and how many at a time.
WIDE, ROWS = 24, 4096
#: Ids as a worker holds them, and as Arrow takes them.
DTYPE = np.dtype("<i4")
#: Characters of the texts in one slice of results.
SLICE_CHARS = 1 << 20


class Codec:
    """A merge-type vocabulary read from a sentencepiece model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        kinds, norm = spec.SentencePiece, spec.normalizer_spec
        if spec.trainer_spec.model_type != spec.trainer_spec.BPE or not spec.trainer_spec.byte_fallback:
            raise ValueError("not a merge-type vocabulary with byte fallback")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("only the identity normalization with a space in front is known here")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError("user-defined and unused pieces are not known here")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [p.piece for p in spec.pieces]
        normal = [(i, p) for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL]
        self.id_of = {p.piece: i for i, p in normal}
        self.cost = {p.piece: -p.score for _, p in normal}
        self.bytes = {i: int(p.piece[3:5], 16) for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        self.byte_id = {b: i for i, b in self.bytes.items()}
        self.silent = {i for i, p in enumerate(spec.pieces) if p.type == kinds.CONTROL}
        self.unknown = {i for i, p in enumerate(spec.pieces) if p.type == kinds.UNKNOWN}
        self.cut = re.compile(_segments(p for p in self.id_of if len(p) > 1)).findall
        beside = {(a.isalpha(), b.isalpha()) for p in self.id_of for a, b in zip(p, p[1:]) if _kind(a) == "-" and b.isalpha() or _kind(b) == "-" and a.isalpha()}
        self.word = None if beside else re.compile(f"( *[^\\W\\d_]+)([{_CLASSES['-']}]+)").fullmatch
        self.segments: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.one = np.full(0x110000, -1, np.int32)  # a character's piece
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.one[ord(p)] = i
        self.one[ord(" ")] = self.one[ord(SPACE)]
        pairs = sorted((self.id_of[p[:k]] * len(self.pieces) + self.id_of[p[k:]], self.cost[p], i) for p, i in self.id_of.items() for k in range(1, len(p)) if p[:k] in self.id_of and p[k:] in self.id_of)
        self.pair_keys, self.pair_costs, self.pair_ids = (np.array(x, t) for x, t in zip(list(zip(*pairs)) or [[]] * 3, (np.int64, np.float64, np.int32)))
        self.whole = all(self.one[ord(c)] >= 0 for p in self.id_of for c in p)
        texts = [bytes([self.bytes[i]]) if i in self.bytes else b"" if i in self.silent else (UNKNOWN if i in self.unknown else p.replace(SPACE, " ")).encode() for i, p in enumerate(self.pieces)]
        self.text_ends = np.cumsum([0, *map(len, texts)])
        self.text_bytes = np.frombuffer(b"".join(texts), np.uint8)

    def merged(self, segment: str) -> list[int]:
        """Ids of a segment by the agenda."""
        segment = segment.replace(" ", SPACE)
        cost, symbols = self.cost.get, list(segment)
        n, left = len(symbols), 0
        agenda = []
        for a, b in zip(segment, segment[1:]):
            c = cost(a + b)
            if c is not None:
                agenda.append((c, left, left + 1, 2))
            left += 1
        heapify(agenda)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        while agenda:
            _, left, right, size = heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != size:
                continue  # one of them was merged meanwhile
            new = a + b
            symbols[left], symbols[right] = new, ""
            after[left] = beyond = after[right]
            if beyond >= 0:
                before[beyond] = left
                pair = new + symbols[beyond]
                c = cost(pair)
                if c is not None:
                    heappush(agenda, (c, left, beyond, len(pair)))
            ahead = before[left]
            if ahead >= 0:
                pair = symbols[ahead] + new
                c = cost(pair)
                if c is not None:
                    heappush(agenda, (c, ahead, left, len(pair)))
        ids: list[int] = []
        for symbol in filter(None, symbols):
            known = self.id_of.get(symbol)
            ids += [known] if known is not None else [self.byte_id[b] for b in symbol.encode()]
        return ids

    def surface(self, ids: list[int]) -> str:
        """The text of any ids, the space in front included. A silent id parts the bytes beside it."""
        ids = np.array(ids, np.int64)
        parts = np.split(ids, np.flatnonzero(np.isin(ids, list(self.silent))))
        return "".join(_utf8(self._joined(p)[0].tobytes()) for p in parts)

    def _joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, and how many each has."""
        starts, sizes = self.text_ends[ids], np.diff(self.text_ends)[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.text_bytes[places], sizes

    def decode(self, ids: list[int]) -> str:
        """The text of any ids; the space that encoding puts in front is taken away."""
        first = next((i for i in ids if i not in self.silent), None)
        text = self.surface(ids)
        return text[1:] if first is not None and first not in self.bytes and self.pieces[first].startswith(SPACE) else text

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost and id of what pairs of symbols merge to; an endless cost where they don't."""
        keys = left.astype(np.int64) * len(self.pieces) + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        found = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(found, self.pair_costs[at], np.inf), self.pair_ids[at]

    def merged_together(self, segments: list[str]) -> list[bytes]:
        """Ids of short segments: every round merges the best pair of each, until none has one."""
        k, sizes = len(segments), np.fromiter(map(len, segments), np.int64, len(segments))
        width = int(sizes.max())
        codes = np.array(segments, f"<U{width}").view(np.uint32).reshape(k, width)
        symbols = np.full((k, width + 1), -2, np.int32)  # -1: outside the vocabulary, -2: merged into another, or beyond the end
        symbols[:, :-1] = np.where(np.arange(width) < sizes[:, None], self.one[codes], -2)
        # a pair stands where its left symbol does; the last column takes what would be beside the edges
        costs, made = np.full((k, width + 1), np.inf), np.zeros((k, width + 1), np.int32)
        costs[:, :-1], made[:, :-1] = self._pair(symbols[:, :-1], symbols[:, 1:])
        after = np.tile(np.arange(1, width + 2), (k, 1))
        before = np.tile(np.arange(-1, width), (k, 1))
        rows = np.arange(k)
        while len(rows):
            at = costs[rows].argmin(axis=1)  # of equal costs the leftmost
            going = costs[rows, at] < np.inf
            rows, at = rows[going], at[going]
            right, left = after[rows, at], before[rows, at]
            beyond = np.minimum(after[rows, right], width)
            symbols[rows, at] = new = made[rows, at]
            symbols[rows, right], costs[rows, right] = -2, np.inf
            after[rows, at], before[rows, beyond] = beyond, at
            costs[rows, at], made[rows, at] = self._pair(new, symbols[rows, beyond])
            costs[rows, left], made[rows, left] = self._pair(symbols[rows, left], new)
        kept = symbols != -2
        ends = np.concatenate([[0], np.cumsum(kept.sum(axis=1))]) * DTYPE.itemsize
        raw = symbols[kept].astype(DTYPE).tobytes()
        found = [raw[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
        for i in np.flatnonzero((symbols == -1).any(axis=1)):
            found[i] = np.array(self.merged(segments[i]), DTYPE).tobytes()
        return found

    def learn(self, segments: set[str]) -> None:
        """Put segments into the table."""
        new, made = set(), []
        for x in segments:
            if (ids := self.old.get(x)) is not None:
                self.segments[x] = ids
            elif self.word and (parts := self.word(x)):  # a word with marks behind it: often a known word
                made.append((x, *parts.groups()))
                new.update(parts.groups())
            else:
                new.add(x)
        short = []
        for x in new - self.segments.keys():
            if len(x) <= WIDE and self.whole and len(self.pair_keys):
                short.append(x)
            else:
                self.segments[x] = np.array(self.merged(x), DTYPE).tobytes()
        short.sort(key=len)
        for k in range(0, len(short), ROWS):
            self.segments.update(zip(short[k : k + ROWS], self.merged_together(short[k : k + ROWS])))
        for x, word, marks in made:
            self.segments[x] = self.segments[word] + self.segments[marks]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts."""
        cuts = [self.cut(" " + t.replace(SPACE, " ")) if t else [] for t in texts]  # with plain spaces most texts are narrow strings
        if len(self.segments) > CACHE_SEGMENTS:  # a full table becomes the old one
            self.segments, self.old = {}, self.segments
        found = [list(map(self.segments.get, c)) for c in cuts]
        lacking = [k for k, ids in enumerate(found) if None in ids]
        self.learn({x for k in lacking for x, ids in zip(cuts[k], found[k]) if ids is None})
        for k in lacking:
            found[k] = list(map(self.segments.__getitem__, cuts[k]))
        return list(map(b"".join, found))

    def decode_own(self, raws: list[bytes]) -> pa.Array:
        """The texts of ids as `encode` gives them: whole characters behind a space. All are joined at once."""
        counts = np.array([len(r) // DTYPE.itemsize for r in raws], np.int64)
        joined, sizes = self._joined(np.frombuffer(b"".join(raws), DTYPE))
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ends = upto[np.concatenate([[0], np.cumsum(counts)])]
        starts = ends[:-1][counts > 0]
        kept = np.delete(joined, starts)  # the space in front of each text
        offsets = (ends - np.concatenate([[0], np.cumsum(counts > 0)])).astype(np.int32)
        return pa.StringArray.from_buffers(len(raws), pa.py_buffer(offsets.tobytes()), pa.py_buffer(kept.tobytes()))

    def agrees(self, texts: list[str], raws: list[bytes], decoded: list[str]) -> list[bool]:
        """Whether the library has the same ids for each text, and the same text for the ids."""
        again = self.library.encode(texts, num_threads=1)
        back = self.library.decode(again, num_threads=1)
        return [np.array(ids, DTYPE).tobytes() == raw and text == own for ids, text, raw, own in zip(again, back, raws, decoded)]


def _segments(pieces: Iterable[str]) -> str:
    """A pattern of the stretches of a text that no merge leaves, for the pieces of two characters or more. Spaces stand for space marks."""
    pairs = {(_kind(a), _kind(b)) for p in pieces for a, b in zip(p, p[1:])}
    never = lambda *more: not pairs & {*more}
    alone = [k for k in "nd" if never(*((k, x) for x in "nds-w"), *((x, k) for x in "nds-w"))]
    if not never(("w", "s"), ("-", "s"), ("n", "s"), ("d", "s")) or "n" not in alone:
        return "(?s:.+)"
    solo = "".join(_CLASSES[k] for k in alone)
    if never(("w", "-"), ("-", "w")) and "d" in alone:
        return f"[{solo}]| *[{_CLASSES['-']}]+| *[^ {solo}{_CLASSES['-']}]+| +"
    return f"[{solo}]| *[^ {solo}]+| +"


#: Kinds of characters, as a pattern's classes: line ends, digits, ASCII marks; besides them spaces (s) and all others (w).
_CLASSES = {"n": "\\n", "d": "0-9", "-": "!-/:-@\\[-`{-~"}
_MATCHES = {k: re.compile(f"[{c}]").match for k, c in _CLASSES.items()}


def _kind(c: str) -> str:
    return "s" if c == SPACE else next((k for k, found in _MATCHES.items() if found(c)), "w")


def _utf8(raw: bytes) -> str:
    """Decoded bytes; each byte that is part of no character becomes one mark."""
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out += [raw[: e.start].decode(), BAD_BYTE]
            raw = raw[e.start + 1 :]
    return "".join(out)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each worker process and model file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _slices(batch: pa.RecordBatch, place: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch of about SLICE_CHARS characters, and their texts."""
    start, size, texts = 0, 0, []
    for k, value in enumerate(batch.column(place)):
        texts.append(value.as_py() or "")
        size += len(texts[-1])
        if size >= SLICE_CHARS:
            yield batch.slice(start, k + 1 - start), texts
            start, size, texts = k + 1, 0, []
    if texts:
        yield batch.slice(start), texts


def encode(docs: DataFrame, model_path: str, text: str = "text", verify: bool = False) -> DataFrame:
    """The rows of `docs` with ids (array of int) and decoded, with `verify` also verified."""
    added = "ids array<int>, decoded string" + (", verified boolean" if verify else "")
    own = docs.drop("ids", "decoded", "verified") if text.lower() not in ("ids", "decoded", "verified") else docs
    columns = own.columns
    place = columns.index(text)

    def encoded(batches):
        bpe = codec(model_path)
        for batch in batches:
            for part, texts in _slices(batch, place):
                raws = bpe.encode(texts)
                ends = np.cumsum([0, *(len(x) // DTYPE.itemsize for x in raws)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raws), DTYPE)))
                values = [ids, bpe.decode_own(raws)]
                if verify:
                    values.append(pa.array(bpe.agrees(texts, raws, values[1].to_pylist()), pa.bool_()))
                yield pa.RecordBatch.from_arrays([*part.columns, *values], [*columns, *(x.split()[0] for x in added.split(", "))])

    return own.mapInArrow(encoded, StructType([*own.schema.fields, *StructType.fromDDL(added).fields]))


def decode(rows: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """The rows with `decoded`, the text of any ids; null ids decode to null, null and unknown members are refused by the worker."""
    own = rows.drop("decoded")
    columns = own.columns
    place = columns.index(ids)

    def decoded(batches):
        bpe = codec(model_path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*columns, "decoded"])

    return own.mapInArrow(decoded, StructType([*own.schema.fields, *StructType.fromDDL("decoded string").fields]))
