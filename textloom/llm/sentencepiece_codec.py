"""Encoding and decoding with a public SentencePiece BPE model by suffix-array matching.

A batch's texts are concatenated, whole, and the suffixes of that are sorted by as many characters as the longest piece
has: by four characters first, then by pairs of the ranks found, twice as many characters each time. Every piece is
binary-searched for the range of suffixes that begin with it; its occurrences are edges from their start to their end. The
edges are sorted by their end's place in its unit and relaxed from left to right, all units at once. (Units are words with
the spaces and signs before them; loading proves that no piece goes on from a letter to a sign, or from anything to a
space.) Relaxing: the merge order of BPE admits exactly one last piece for each prefix, the one that may stand beside the
last piece of the prefix before it (two pieces may stand side by side if merging their characters yields just these two;
a worker remembers that of PAIRS pairs of pieces, no text). Walking back from each unit's end gives its pieces, the same
that the model's own merging gives.

Texts get the model's dummy space in front; characters without a piece become their UTF-8 bytes' pieces. Decoding joins
the pieces' bytes, drops that space and replaces malformed UTF-8. The round trip is exact unless the text holds
U+2581, which stands for a space itself.

Defined cases: null texts have null ids, empty texts none. Very long texts are indexed in blocks of about BLOCK
characters, cut where a unit starts. Repeated rows and further columns are of no effect.
The model's path is a parameter; the driver reads it and ships its pieces (bounded by the vocabulary) to the workers.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import held, parts, tidy

MODEL = os.path.join("/opt/tokenizers", "piece_bpe_32k.model")
SPACE = "▁"
BLOCK, PAIRS = 1 << 18, 1 << 21  # characters of an index; pairs of pieces that a worker remembers
FIRST, BITS = 4, 16  # characters of the first key, and bits for each
NEVER = 1 << 30


class _ByCharacter:
    """A number for each code point: a table for the basic plane, a sorted list beyond it."""

    def __init__(self, numbers: dict[int, int], default: int):
        self._table, self._default = np.full(1 << 16, default, np.int32), default
        high = sorted(c for c in numbers if c >= 1 << 16)
        for c, n in numbers.items():
            if c < 1 << 16:
                self._table[c] = n
        self._codes, self._numbers = np.array([*high, 1 << 21], np.uint32), np.array([*(numbers[c] for c in high), default], np.int32)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        out = self._table[np.minimum(codes, 0xFFFF)]
        if len(high := np.flatnonzero(codes >= 1 << 16)):
            at = np.searchsorted(self._codes, codes[high])
            out[high] = np.where(self._codes[at] == codes[high], self._numbers[at], self._default)
        return out


class Vocabulary:
    """The normal pieces of a model with their ranks, and the ids of its byte pieces."""

    def __init__(self, pieces: list[str], order: dict[str, int], ids: dict[str, int], byte_ids: list[int]):
        self.pieces, self.order, self.ids, self.byte_ids = pieces, order, ids, byte_ids
        self.longest = max(map(len, ids))
        for p in ids:
            if SPACE in p.lstrip(SPACE):
                raise ValueError(f"piece {p!r} crosses a unit's start")
        if any("\n" in p for p in ids):
            raise ValueError("a piece holds a line break")
        if len({c for p in ids for c in p}) + 2 > 1 << BITS:
            raise ValueError("too many characters for a key")
        neighbours = {(a, b) for p in ids for a, b in zip(p, p[1:], strict=False) if re.match(r"\w", a)}
        self.going_on: set[str] = set()  # word characters that a piece continues with something else: they count as signs
        while more := {a for a, b in neighbours if a not in self.going_on and (b in self.going_on or not re.match(r"\w", b))}:
            self.going_on |= more
        word = {m.start(): 1 for m in re.finditer(r"\w", "".join(map(chr, range(0x110000))))}
        word = {c: k for c, k in word.items() if chr(c) not in self.going_on}
        self.kind = _ByCharacter(word | {ord(SPACE): 2, ord("\n"): 3}, 0)  # 0: signs
        self.name = hashlib.md5("\0".join(pieces).encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i))]
        ranked = sorted(normal, key=lambda i: (-model.get_score(i), i))
        byte_ids = [-1] * 256
        for i in range(n):
            if model.is_byte(i):
                byte_ids[int(pieces[i][3:5], 16)] = i
        return cls(pieces, {pieces[i]: k for k, i in enumerate(ranked)}, {pieces[i]: i for i in normal}, byte_ids)

    def merged(self, text: str) -> list[str]:
        """The pieces that merging the best pair again and again yields; for the short strings of `beside`."""
        parts, rank = list(text), self.order.get
        ranks = [rank(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != NEVER:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], NEVER)
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], NEVER)
        return parts


class _Pairs:
    """An open-addressing table from pairs of pieces to whether they may stand side by side."""

    def __init__(self, beside):
        self._beside = beside
        self._clear()

    def _clear(self, bits: int = 12) -> None:
        self._bits = bits
        self._keys, self._fine, self._n = np.full(1 << self._bits, -1, np.int64), np.zeros(1 << self._bits, bool), 0

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(64 - self._bits)).astype(np.int64) + probe) & ((1 << self._bits) - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys, 0)
        held, out = self._keys[slot], self._fine[slot]
        todo, probe = np.flatnonzero(held != keys), 0
        missing = [keys[todo][held[todo] < 0]]
        todo = todo[held[todo] >= 0]
        while len(todo):
            probe += 1
            slot = self._slot(keys[todo], probe)
            held = self._keys[slot]
            out[todo] = self._fine[slot]
            missing.append(keys[todo[held < 0]])
            todo = todo[(held >= 0) & (held != keys[todo])]
        if len(new := np.unique(np.concatenate(missing))):
            fine = np.fromiter(map(self._beside, new.tolist()), bool, len(new))
            at = np.minimum(np.searchsorted(new, keys), len(new) - 1)
            out = np.where(new[at] == keys, fine[at], out)
            self._add(new, fine)
        return out

    def _add(self, keys: np.ndarray, fine: np.ndarray) -> None:
        if self._n + len(keys) > PAIRS:
            self._clear()
            keys, fine = keys[:PAIRS], fine[:PAIRS]
        if (need := (2 * (self._n + len(keys))).bit_length()) > self._bits:  # at most half full; grows with what is held
            held = self._keys >= 0
            keys, fine = np.concatenate((self._keys[held], keys)), np.concatenate((self._fine[held], fine))
            self._clear(need)
        self._n += len(keys)
        probe = 0
        while len(keys):
            slot = self._slot(keys, probe)
            free = self._keys[slot] < 0
            self._keys[slot[free]], self._fine[slot[free]] = keys[free], fine[free]
            left = self._keys[slot] != keys
            self._fine[slot[~left]] = fine[~left]
            keys, fine, probe = keys[left], fine[left], probe + 1


class Encoder:
    """Ids of texts, by an index of the texts."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        normal = sorted(v.ids, key=lambda p: [ord(c) for c in p])  # in the order of the symbols, so searches run forward
        letters = sorted({c for p in normal for c in p})
        self._symbol = _ByCharacter({ord(c): i + 2 for i, c in enumerate(letters)}, 1)  # 1: no piece holds it; 0: between texts
        self._kind = v.kind
        self._ids = np.array([v.ids[p] for p in normal], np.int32)
        self._lengths = np.zeros(len(v.pieces) + 1, np.int32)
        self._lengths[self._ids] = [len(p) for p in normal]
        self._lengths[-1] = 1  # -1: a character without a piece
        self._width = FIRST
        while self._width < v.longest:
            self._width *= 2
        symbols = np.zeros((len(normal), self._width), np.uint64)
        for row, p in zip(symbols, normal, strict=True):
            row[: len(p)] = self._symbol(_codes(p))
        self._sizes = np.fromiter(map(len, normal), np.int64, len(normal))
        groups = symbols.reshape(len(normal), -1, FIRST)
        fill = np.uint64((1 << BITS) - 1)
        self._low, self._high = _packed(groups), _packed(np.where(groups == 0, fill, groups))
        self._pairs = _Pairs(self._fits)

    def _fits(self, key: int) -> bool:
        """Whether two pieces may stand side by side; characters without a piece (-1) always may."""
        a, b = (key >> 20) - 1, (key & 0xFFFFF) - 1
        pieces = self.vocabulary.pieces
        return a < 0 or b < 0 or self.vocabulary.merged(pieces[a] + pieces[b]) == [pieces[a], pieces[b]]

    def _edges(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece id of every occurrence of every piece in the symbols, by their suffix array."""
        n = len(symbols)
        padded = np.concatenate((symbols, np.zeros(FIRST, symbols.dtype))).astype(np.uint64)
        key = _packed(np.lib.stride_tricks.sliding_window_view(padded, FIRST)[:n])
        order, rank, distinct, first = _ranked(key)
        some = np.arange(len(self._ids))  # pieces that may still occur
        low, high = np.searchsorted(distinct, self._low[:, 0]), np.searchsorted(distinct, self._high[:, 0], "right")
        some = some[low < high]
        found = {0: (low[some], high[some])}  # by the group of characters: ranks that begin with it
        for g in range(1, self._width // FIRST):
            low, high = np.zeros(len(some), np.int64), np.full(len(some), len(distinct))
            on = self._sizes[some] > g * FIRST
            low[on], high[on] = np.searchsorted(distinct, self._low[some[on], g]), np.searchsorted(distinct, self._high[some[on], g], "right")
            found[g] = low, high
        width = FIRST
        while width < self._width:
            after = np.concatenate((rank[width:] + 1, np.zeros(min(width, n), np.int64)))[:n]  # 0: beyond the end
            order, rank, distinct, first = _ranked(rank.astype(np.uint64) << np.uint64(32) | after.astype(np.uint64))
            joined = {}
            for g in range(0, len(found), 2):
                (a, b), (c, d) = found[g], found[g + 1]
                whole = self._sizes[some] > g // 2 * 2 * width + width  # the second group has characters, so the first is full
                begin = a.astype(np.uint64) << np.uint64(32) | np.where(whole, c + 1, 0).astype(np.uint64)
                end = np.where(whole, a, b - 1).clip(0).astype(np.uint64) << np.uint64(32) | np.where(whole, d, 0xFFFFFFFF).astype(np.uint64)
                low, high = np.searchsorted(distinct, begin), np.searchsorted(distinct, end, "right")
                none = (a >= b) | whole & (c >= d)
                joined[g // 2] = np.where(none, 0, low), np.where(none, 0, high)
            keep = joined[0][0] < joined[0][1]
            some, found = some[keep], {g: (x[keep], y[keep]) for g, (x, y) in joined.items()}
            width *= 2
        low, high = found[0]
        begin, times = first[low], first[high] - first[low]
        return order[_ranges(begin, times)], np.repeat(self._ids[some], times)

    def _solved(self, codes: np.ndarray, gaps: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the characters' pieces in order, and the place where each ends; gaps: characters between texts."""
        symbols = self._symbol(codes)
        symbols[gaps] = 0
        start, piece = self._edges(symbols)
        lone = np.flatnonzero(symbols == 1).astype(start.dtype)
        start, piece = np.concatenate((start, lone)), np.concatenate((piece, np.full(len(lone), -1, np.int32)))
        unit = np.cumsum(begins) - 1
        at = np.flatnonzero(begins)
        from_ = start - at[unit[start]]
        end = start + self._lengths[piece]
        offset = from_ + self._lengths[piece]
        order = np.argsort(offset.astype(np.uint16), kind="stable") if not len(offset) or offset.max() < 1 << 16 else np.argsort(offset, kind="stable")
        start, piece, end, from_ = start[order], piece[order], end[order], from_[order]
        last = np.full(len(codes) + 1, -2, np.int32)  # the last piece of the prefix that ends here
        for a, b in zip(*_groups(offset[order]), strict=True):
            p = piece[a:b]
            before = last[start[a:b]]
            fits = from_[a:b] == 0
            rest = np.flatnonzero(~fits & (before != -2))
            fits[rest] = self._pairs((before[rest].astype(np.int64) + 1) << 20 | (p[rest].astype(np.int64) + 1))
            last[end[a:b][fits]] = p[fits]
        ends = np.concatenate((at[1:], [len(codes)]))
        real = symbols[at] != 0
        at, walk = at[real], ends[real]
        chosen = np.zeros(len(codes) + 1, bool)
        while len(walk):
            chosen[walk] = True
            walk = walk - self._lengths[last[walk]]
            on = walk > at
            at, walk = at[on], walk[on]
        place = np.flatnonzero(chosen)
        return last[place], place

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each text has."""
        whole = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        sizes = np.fromiter(map(len, whole), np.int64, len(whole))
        codes = _codes("\0".join(whole))
        gaps = np.cumsum(sizes + 1)[:-1] - 1
        kind = self._kind(codes)
        before = np.concatenate(([3], kind[:-1]))
        begins = (kind == 3) | (before == 3) | (kind == 2) & (before != 2) | (kind == 0) & (before == 1)
        begins[gaps] = True
        begins[gaps[gaps + 1 < len(codes)] + 1] = True
        cuts, starts = [0], np.flatnonzero(begins)
        while cuts[-1] < len(codes):
            k = np.searchsorted(starts, cuts[-1] + BLOCK)
            cuts.append(int(starts[k]) if k < len(starts) else len(codes))
        found = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            inside = gaps[np.searchsorted(gaps, a) : np.searchsorted(gaps, b)] - a
            token, place = self._solved(codes[a:b], inside, begins[a:b])
            found.append((token, place + a))
        token, place = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        times = np.ones(len(token), np.int64)
        if len(none := np.flatnonzero(token < 0)):  # the bytes of characters without a piece
            spelt = [[self.vocabulary.byte_ids[x] for x in chr(c).encode("utf-8", "replace")] for c in codes[place[none] - 1].tolist()]
            times[none] = list(map(len, spelt))
            bytes_at = np.repeat(token < 0, times)
            token = np.repeat(token, times)
            token[bytes_at] = [x for s in spelt for x in s]
        upto = np.concatenate(([0], np.cumsum(times)))[np.searchsorted(place, np.cumsum(sizes + 1) - 1, "right")]
        return token.astype(np.int64), np.diff(upto, prepend=0)


_ENCODERS: dict[str, Encoder] = held("encoders")


def encoder_of(vocabulary: Vocabulary) -> Encoder:
    """The process's encoder for a vocabulary: made once, so that a worker's tasks share it until it does other work."""
    if vocabulary.name not in _ENCODERS:
        _ENCODERS[vocabulary.name] = Encoder(vocabulary)
    return _ENCODERS[vocabulary.name]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _packed(groups: np.ndarray) -> np.ndarray:
    """FIRST symbols of the last axis as one number, in the order of the symbols."""
    out = groups[..., 0].astype(np.uint64)
    for k in range(1, FIRST):
        out = out << np.uint64(BITS) | groups[..., k]
    return out


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The places in the order of their keys, each place's rank, the distinct keys, and where each begins in the order (and the end)."""
    order = np.argsort(key)
    ranked = key[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))[: len(key)]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return order, rank, ranked[first], np.concatenate((first, [len(key)]))


class Decoder:
    """Bytes of ids."""

    def __init__(self, vocabulary: Vocabulary):
        spelt = [p.replace(SPACE, " ").encode() if p in vocabulary.ids else b"" for p in vocabulary.pieces]
        spelt[0] = spelt[0] or " ⁇ ".encode()  # the unknown piece
        for value, i in enumerate(vocabulary.byte_ids):
            if i >= 0:
                spelt[i] = bytes([value])
        self._size = np.fromiter(map(len, spelt), np.int64, len(spelt))
        self._start = np.concatenate(([0], np.cumsum(self._size)[:-1]))
        self._pool = np.frombuffer(b"".join(spelt), np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts of runs of ids, as bytes without the dummy space."""
        n = self._size[ids]
        joined = self._pool[_ranges(self._start[ids], n)].tobytes()
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [joined[a + (joined[a : a + 1] == b" " and a < b) : b] for a, b in zip(ends, ends[1:], strict=False)]


def _groups(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Start and end of each run of equal values."""
    if not len(x):
        return [], []
    cut = (np.flatnonzero(x[1:] != x[:-1]) + 1).tolist()
    return [0, *cut], [*cut, len(x)]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each range, n of them, one range after the other."""
    before = np.cumsum(n) - n
    return np.repeat(start - before, n) + np.arange(int(n.sum()))


def encode(docs: DataFrame, path: str = MODEL, batch: int = 1024) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip): the ids of every text, and whether they decode to it."""
    vocabulary = Vocabulary.load(path)

    def encoded(batches):
        encoder, decoder = encoder_of(vocabulary), Decoder(vocabulary)
        for rows in batches:
            for part in parts(rows, batch, BLOCK):
                texts = part.column("text").to_pylist()
                ids, n = encoder.encode([t or "" for t in texts])
                back = decoder.decode(ids, n)
                same = [t is not None and t.encode("utf-8", "surrogatepass") == b for t, b in zip(texts, back, strict=True)]
                null = np.fromiter((t is None for t in texts), bool, len(texts))
                ends = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32), mask=np.append(null, False))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())), pa.array(n), pa.array(same)],
                    names=["doc_id", "ids", "n_tokens", "round_trip"])

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    return docs.select("doc_id", "text").mapInArrow(tidy(encoded, "encoders"), schema)


def decode(tokens: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); malformed UTF-8 is replaced."""
    vocabulary = Vocabulary.load(path)

    def decoded(batches):
        decoder = Decoder(vocabulary)
        for rows in batches:
            lists = rows.column("ids").to_pylist()
            n = np.fromiter((len(x or ()) for x in lists), np.int64, len(lists))
            ids = np.fromiter((i for x in lists for i in x or ()), np.int64, int(n.sum()))
            texts = [None if x is None else t.decode("utf-8", "replace") for x, t in zip(lists, decoder.decode(ids, n), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = tokens.schema["doc_id"].dataType
    return tokens.select("doc_id", "ids").mapInArrow(tidy(decoded), T.StructType([T.StructField("doc_id", kind), T.StructField("text", T.StringType())]))
