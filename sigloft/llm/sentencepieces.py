"""SentencePiece encoding and decoding as shortest paths of a weighted finite-state transducer.

A model file is compiled into machines over the tropical semiring, where paths add weights and the least one counts.

* The normaliser rewrites a text: the longest entry of the model's character map at each place, spaces as the space sign, the sign before
  the text, and runs of spaces as the model has it.
* The lexicon is a trie; an arc leads from any place of the text along a piece to the place behind it and writes the piece. Pieces weigh
  what their score says (unigram models: its negative) or one each (models trained by merging).
* Byte fallback is an arc for a symbol without a piece; it writes its bytes, or the unknown piece where the model has no byte pieces.
* The acceptor reads pieces. That of a unigram model has one state and accepts all. That of a merging model has the last piece as its
  state and gives infinite weight to a piece that merging would not leave beside it (see ``merges``), so one path of finite weight is left.

Their composition with a text is never laid out: arcs are made place by place along the trie and relaxed at once. It is cut into units
that no piece crosses, at spaces and at symbols that are in no piece; the different units of a stretch of texts go side by side, a column each, so a step relaxes one arc of each. Units
that need the fallback, and long ones, go alone. Nothing but answers of the acceptor, in arrays of fixed size, is kept from stretch to
stretch.

Of paths of equal weight the one whose last piece is longer counts; where a library's sums are rounded otherwise, such ties (the same
pieces in another order) may fall otherwise there. Null texts are empty and have no pieces. Any text can be encoded. Decoding gives the text back, except that the space sign itself, where a
text has it, becomes a space, and what the normaliser rewrites stays rewritten. Repeated rows and ids give one row each, empty tables
none; only the named columns are read. Models with pieces of the user, and kinds other than these two, are refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloft.llm.common import id_and_text, portions
from sigloft.llm.merges import PairEncoding

SPACE = "▁"
#: Units of more symbols go alone; units that go side by side at once.
SHORT, SIDE_BY_SIDE = 48, 1 << 15
#: Answers of the acceptor that are kept.
ANSWERS = 1 << 21
#: Fixed values of the model file's format: kinds of pieces, model kinds, the penalty of the unknown piece, how it is shown.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGING = 1, 2
PENALTY, SURFACE = 10.0, " \u2047 "


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The numbered fields of one message of the model file."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        size = {0: 0, 1: 8, 5: 4}.get(key & 7)
        if size == 0:
            yield key >> 3, varint()
            continue
        size = varint() if size is None else size
        yield key >> 3, raw[at : at + size]
        at += size


class Normaliser:
    """The rewriting of a text before it is cut into pieces."""

    def __init__(self, spec: dict):
        compiled = spec.get(2, b"")
        size = int.from_bytes(compiled[:4], "little")
        self.trie = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist() if compiled else []
        self.written = compiled[4 + size :]
        self.prefix = SPACE if spec.get(3, 1) else ""
        self.single_spaces = bool(spec.get(4, 1))
        if not spec.get(5, 1):
            raise ValueError("a model that keeps spaces as they are is not supported")

    def _rewritten(self, raw: bytes, at: int) -> tuple[int, str]:
        """How many bytes the longest entry of the map takes at a place, and what it writes; else one symbol, as it is."""
        node, best = 0, None
        if self.trie:
            node ^= self._step(self.trie[0])
            for i in range(at, len(raw)):
                node ^= raw[i]
                if node >= len(self.trie):
                    break
                unit = self.trie[node]
                if unit & 0x800000FF != raw[i]:
                    break
                node ^= self._step(unit)
                if unit >> 8 & 1:
                    best = (i + 1 - at, self.trie[node] & 0x7FFFFFFF)
        if best is not None:
            return best[0], self.written[best[1] : self.written.index(0, best[1])].decode()
        first = raw[at]
        size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return size, raw[at : at + size].decode()

    @staticmethod
    def _step(unit: int) -> int:
        return (unit >> 10) << ((unit & 1 << 9) >> 6)

    def write(self, text: str) -> str:
        if self.trie:
            raw, at, parts = text.encode(), 0, []
            while at < len(raw):
                size, part = self._rewritten(raw, at)
                parts.append(part)
                at += size
            text = "".join(parts)
        if self.single_spaces:
            text = re.sub(" +", " ", text).strip(" ")
        return self.prefix + text.replace(" ", SPACE) if text else ""


class FreeAcceptor:
    """One state: any piece may follow any other."""

    def weights(self, last: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        return np.zeros(len(tokens), np.float32)


class _Neighbours(PairEncoding):
    def _automaton(self) -> None:
        """The trie is the lexicon's; only the order of merges is needed here."""


class MergeAcceptor:
    """The last piece is the state (-1: none): finite weight for a piece that merging leaves beside it."""

    def __init__(self, symbols: list[str], rank: dict[str, int]):
        self.order = _Neighbours(symbols, rank)
        self.size = len(self.order.texts)
        self.pairs, self.answers = np.zeros(1, np.int64) - 1, np.zeros(1, np.float32)

    def _one(self, pair: int) -> float:
        last, token = divmod(pair, self.size)
        apart = self.order._last_merge(self.order.texts[token]) is not None if last == self.size else self.order._apart(last * self.size + token)
        return 0.0 if apart else np.inf

    def weights(self, last: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        pairs = np.where(last < 0, self.size, last).astype(np.int64) * self.size + tokens
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        new = np.unique(pairs[self.pairs[at] != pairs])
        if len(new):
            if len(self.pairs) + len(new) > ANSWERS:
                self.pairs, self.answers, new = self.pairs[:1], self.answers[:1], np.unique(pairs)
            found = np.fromiter(map(self._one, new.tolist()), np.float32, len(new))
            merged = np.concatenate((self.pairs, new))
            order = np.argsort(merged, kind="stable")
            self.pairs, self.answers = merged[order], np.concatenate((self.answers, found))[order]
            at = np.searchsorted(self.pairs, pairs)
        return self.answers[at]


class Lexicon:
    """The trie of all pieces as sorted arrays: (state, symbol) to the next state, and the piece that ends in a state."""

    def __init__(self, texts: list[str]):
        state_of, self.longest = {"": 0}, max(map(len, texts))
        arcs, ending = {}, {}
        for token, text in enumerate(texts):
            for i, symbol in enumerate(text, 1):
                state = state_of.setdefault(text[:i], len(state_of))
                arcs[state_of[text[: i - 1]] << 21 | ord(symbol)] = state
            ending[state] = token
        self.keys = np.array(sorted(arcs), np.int64)
        self.next = np.array([arcs[k] for k in self.keys.tolist()], np.int32)
        self.token = np.full(len(state_of), -1, np.int32)
        self.token[list(ending)] = list(ending.values())

    def follow(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and which of the arcs exist."""
        keys = states.astype(np.int64) << 21 | symbols
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.next[at], self.keys[at] == keys


class PieceTransducer:
    def __init__(self, path: str):
        with open(path, "rb") as file:
            model = file.read()
        self.pieces: list[str] = []
        scores, kinds, trainer, normaliser = [], [], {}, {}
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normaliser = dict(fields(value))
        kind = trainer.get(3, UNIGRAM)
        if kind not in (UNIGRAM, MERGING) or USER in kinds or (kind == MERGING and UNUSED in kinds):
            raise ValueError("supported are unigram and merging models without pieces of the user")
        self.normaliser = Normaliser(normaliser)
        normal = {p: i for i, p in enumerate(self.pieces) if kinds[i] == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece goes on after a space sign")
        self.byte = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if kinds[i] == BYTE}
        self.unknown = kinds.index(UNKNOWN)
        self.of_byte = {i: b for b, i in self.byte.items()}
        if kind == MERGING:
            order = {s: r for r, s in enumerate(sorted({-scores[i] for i in normal.values()}))}
            symbols = sorted({c for p in normal for c in p})
            rank = {p: order[-scores[i]] for p, i in normal.items() if len(p) > 1}
            self.acceptor = MergeAcceptor(symbols, rank)
            texts = self.acceptor.order.texts
            self.weight, self.fallen = np.ones(len(texts)), None
        else:
            self.acceptor, texts = FreeAcceptor(), list(normal)
            self.weight = np.array([-scores[normal[p]] for p in texts])
            self.fallen = np.float32(PENALTY) - np.float32(min(scores[i] for i in normal.values()))
        self.is_byte = np.array([k == BYTE for k in kinds], bool)
        self.lexicon = Lexicon(texts)
        self.token = {p: t for t, p in enumerate(texts)}
        #: The number of each token in the model; a symbol of merged pieces that is no piece itself goes byte by byte.
        self.number = np.array([normal.get(p, -1) for p in texts], np.int32)
        self.plain = {p for t, p in enumerate(texts) if len(p) == 1 and self.number[t] >= 0}
        known = "".join(map(re.escape, sorted({c for p in texts for c in p} - {SPACE})))
        # No piece goes on after a space sign or over a symbol that is in none.
        self.units = re.compile(f"{SPACE}*[{known}]+|{SPACE}+|[^{SPACE}{known}]+")
        surface = trainer[44].decode() if 44 in trainer else SURFACE
        self.shown = ["" if k == CONTROL else surface if k == UNKNOWN else p.replace(SPACE, " ") for p, k in zip(self.pieces, kinds)]

    def _paths(self, units: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece numbers along the shortest paths of units of known symbols, one after the other, and how many each has."""
        height, count = int(sizes.max()), len(units)
        padded = "".join(u.ljust(height, "\0") for u in units).encode("utf-32-le")
        symbols = np.ascontiguousarray(np.frombuffer(padded, "<u4").reshape(count, height).T).astype(np.int64)
        weight = np.full((height + 1, count), np.inf, np.float32)
        last, back = np.full((height + 1, count), -1, np.int32), np.zeros((height + 1, count), np.int8)
        weight[0] = 0
        for start in range(height):
            column = np.nonzero((sizes > start) & np.isfinite(weight[start]))[0]
            state, end = np.zeros(len(column), np.int32), start
            while len(column) and end < height:
                state, arc = self.lexicon.follow(state, symbols[end, column])
                column, state, end = column[arc], state[arc], end + 1
                token = self.lexicon.token[state]
                at, token = column[token >= 0], token[token >= 0]
                if not len(at):
                    continue
                path = weight[start, at].astype(np.float64) + (self.weight[token] + self.acceptor.weights(last[start, at], token))
                less = path < weight[end, at]
                at = at[less]
                weight[end, at], last[end, at], back[end, at] = path[less], token[less], start
        taken, at, column, n = np.zeros((height, count), np.int32), sizes.copy(), np.arange(count), np.zeros(count, np.int64)
        while len(column):
            taken[n[column], column] = last[at[column], column]
            n[column] += 1
            at[column] = back[at[column], column]
            column = column[at[column] > 0]
        used = np.arange(height)[::-1, None] < n
        return self.number[taken[::-1].T[used.T]], n

    def _alone(self, unit: str) -> list[int]:
        """The piece numbers along the shortest path of one unit, with fallback arcs."""
        size, free = len(unit), self.fallen is not None
        weight, last, back = [np.float32(np.inf)] * (size + 1), [-1] * (size + 1), [0] * (size + 1)
        weight[0] = np.float32(0)
        for start in range(size):
            if not np.isfinite(weight[start]):
                continue
            arcs = [(t, k) for k in range(1, min(self.lexicon.longest, size - start) + 1) if (t := self.token.get(unit[start : start + k])) is not None]
            tokens = np.array([t for t, _ in arcs], np.int64)
            passed = self.acceptor.weights(np.full(len(arcs), last[start]), tokens) if arcs else ()
            for (token, k), extra in zip(arcs, passed):
                path = float(weight[start]) + float(self.weight[token] + extra)
                if path < weight[start + k]:
                    weight[start + k], last[start + k], back[start + k] = np.float32(path), token, start
            if not arcs or arcs[0][1] > 1:
                path = weight[start] + (self.fallen if free else np.float32(len(unit[start].encode())))
                if path < weight[start + 1]:
                    weight[start + 1], last[start + 1], back[start + 1] = path, -1, start
        out: list[list[int]] = []
        while size:
            token, start = last[size], back[size]
            number = int(self.number[token]) if token >= 0 else -1
            out.append([number] if number >= 0 else [self.byte.get(b, self.unknown) for b in unit[start:size].encode()] if self.byte else [self.unknown])
            size = start
        return [i for part in reversed(out) for i in part]

    def _encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The piece numbers of different units, one after the other, and for each unit where its own begin and how many there are."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        alone = np.fromiter((len(u) > SHORT or not self.plain.issuperset(u) for u in units), bool, len(units))
        order = np.argsort(np.where(alone, np.iinfo(np.int64).max, sizes), kind="stable")
        together = order[: int((~alone).sum())]
        numbers, counts = [], []
        ends = np.searchsorted(sizes[together], [2, 4, 8, 16, 32, SHORT], "right").tolist()
        for low, high in zip([0, *ends[:-1]], ends):
            for at in range(low, high, SIDE_BY_SIDE):
                some = together[at : min(at + SIDE_BY_SIDE, high)]
                ids, n = self._paths([units[x] for x in some], sizes[some])
                numbers.append(ids)
                counts.append(n)
        for x in order[len(together) :].tolist():
            ids = self._alone(units[x])
            numbers.append(np.array(ids, np.int32))
            counts.append(np.array([len(ids)], np.int64))
        count, begin = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        if len(units):
            count[order] = np.concatenate(counts)
            begin[order] = np.cumsum(count[order]) - count[order]
        return (np.concatenate(numbers) if numbers else np.zeros(0, np.int32)), begin, count

    def encode_all(self, texts: pd.Series) -> Iterator[np.ndarray]:
        """The piece numbers of each text; the different units of a bounded stretch of texts go together."""
        for part in portions(texts):
            found = [self.units.findall(self.normaliser.write(text)) for text in part]
            place: dict[str, int] = {}
            for units in found:
                for unit in units:
                    place.setdefault(unit, len(place))
            numbers, begin, count = self._encoded(list(place))
            for units in found:
                at = np.fromiter(map(place.__getitem__, units), np.int64, len(units))
                n = count[at]
                ends = np.cumsum(n)
                ids = numbers[np.repeat(begin[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
                # Neighbouring unknown symbols are one unknown piece.
                again = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
                yield np.delete(ids, np.nonzero(again)[0] + 1) if again.any() else ids

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text])).tolist()

    def decode(self, ids: np.ndarray | list[int]) -> str:
        found, of_byte, shown = np.asarray(ids, np.int32), self.of_byte, self.shown
        if not self.is_byte[found].any():
            text = "".join(map(shown.__getitem__, found.tolist()))
        else:
            raw = bytearray()
            for i in found.tolist():
                if i in of_byte:
                    raw.append(of_byte[i])
                else:
                    raw += shown[i].encode()
            text = raw.decode(errors="replace")
        return text.removeprefix(" ") if self.normaliser.prefix else text


@lru_cache(maxsize=1)
def transducer(path: str) -> PieceTransducer:
    """One transducer for each Python worker and model."""
    return PieceTransducer(path)


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the piece numbers of each text. ``model``: a path that every executor can read."""

    texts = id_and_text(docs, id_col, text_col)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in batches:
            ids, at = batch.column("doc_id"), 0
            for part in portions(batch.column("text").to_pylist()):
                found = list(machine.encode_all(part))
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), lists], names=["doc_id", "ids"])
                at += len(part)

    return texts.mapInArrow(encode, texts.select("doc_id").schema.add("ids", T.ArrayType(T.IntegerType())))


def decoded(pieces: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text``: the text of each array of piece numbers; null gives an empty text."""

    @F.pandas_udf("string")
    def text(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = transducer(model)
        for batch in ids:
            yield batch.map(lambda x: "" if x is None else machine.decode(x))

    return pieces.select(F.col(id_col).alias("doc_id"), text(F.col(ids_col)).alias("text"))


def round_trips(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_pieces, n_byte_pieces, ids_sha256, round_trip``: each text encoded and decoded in one pass.

    ids_sha256 is over the numbers as 32 bits each, lowest byte first. round_trip: decoding gave the text back.
    """

    @F.pandas_udf("n_pieces long, n_byte_pieces long, ids_sha256 string, round_trip boolean")
    def trip(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = transducer(model)
        for batch in texts:
            rows = []
            for text, found in zip(batch, machine.encode_all(batch)):
                fallen = int(machine.is_byte[found].sum())
                rows.append((len(found), fallen, hashlib.sha256(found.astype("<i4").tobytes()).hexdigest(), machine.decode(found) == text.replace(SPACE, " ")))
            yield pd.DataFrame(rows, columns=["n_pieces", "n_byte_pieces", "ids_sha256", "round_trip"])

    return id_and_text(docs, id_col, text_col).select("doc_id", trip("text").alias("t")).select("doc_id", "t.*")
