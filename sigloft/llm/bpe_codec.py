"""Byte-pair encoding and decoding with segment trees over the ranks of neighbouring pairs.

A vocabulary file's splitting pattern cuts a text into pieces that merges never cross. A piece starts as its bytes. Each pair of
neighbours is a leaf with the rank of its merge and its place, a leaf without a merge is infinite, and each inner node holds the lesser
of its two children, so the root names the leftmost of the pairs of lowest rank. A merge changes three leaves: its own, that of the part
it swallows, and that of the pair before; each is carried up to the root. A piece of n bytes costs n log n steps whatever it is made of,
so one word of some million letters is no special case.

Texts are worked through in stretches of bounded length, each text whole. The different pieces of a stretch are merged side by side: the
trees of pieces of one size class stand in one array, a column each, and every step takes the root of each and merges there, until no tree
has a pair left. Long pieces have a tree of their own. Nothing is kept from stretch to stretch, so memory is bounded by a stretch or text.

Null texts are empty and have no tokens. The vocabulary's added tokens are one token each where their string stands in a text, as the
library has it by default; decoding writes them out. Repeated rows and ids give one row each, empty tables none; only the named columns
are read. A vocabulary file that asks for another splitting or any normalising is refused.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloft.llm.common import id_and_text, portions
from sigloft.llm.token_counts import PATTERN, byte_of_char

#: Leaves are rank << PLACE | place.
PLACE = 40
NEVER = 1 << 80
#: The same for trees side by side.
PLACE_BITS, OPEN_END = 16, np.int64(1 << 62)
#: Pieces of more bytes have a tree of their own; trees that stand in one array at once.
SHORT, SIDE_BY_SIDE = 64, 1 << 15


class PairTree:
    """The parts of one piece, and the least (rank, place) of all pairs of neighbours."""

    def __init__(self, parts: list[int], merges: dict[tuple[int, int], tuple[int, int]]):
        self.parts, self.merges = parts, merges
        n = len(parts)
        self.after, self.before = list(range(1, n + 1)), list(range(-1, n - 1))
        self.width = 1 << max(n - 2, 0).bit_length()
        leaves = [self._leaf(i, i + 1) for i in range(n - 1)]
        self.nodes = [NEVER] * self.width + leaves + [NEVER] * (self.width - len(leaves))
        for at in range(self.width - 1, 0, -1):
            self.nodes[at] = min(self.nodes[2 * at], self.nodes[2 * at + 1])

    def _leaf(self, i: int, j: int) -> int:
        found = self.merges.get((self.parts[i], self.parts[j]))
        return NEVER if found is None else found[0] << PLACE | i

    def _set(self, i: int, leaf: int) -> None:
        nodes, at = self.nodes, self.width + i
        nodes[at] = leaf
        while at > 1:
            at >>= 1
            left, right = nodes[2 * at], nodes[2 * at + 1]
            least = left if left < right else right
            if nodes[at] == least:
                return
            nodes[at] = least

    def merge_all(self) -> list[int]:
        """Merges until no pair may; what is left, in order."""
        parts, after, before, n = self.parts, self.after, self.before, len(self.parts)
        while (best := self.nodes[1]) != NEVER:
            i = best & (1 << PLACE) - 1
            j = after[i]
            parts[i] = self.merges[parts[i], parts[j]][1]
            k = after[i] = after[j]
            if j < n - 1:
                self._set(j, NEVER)
            if k < n:
                before[k] = i
                self._set(i, self._leaf(i, k))
            else:
                self._set(i, NEVER)
            if (h := before[i]) >= 0:
                self._set(h, self._leaf(h, i))
        out, at = [], 0
        while at < n:
            out.append(parts[at])
            at = after[at]
        return out


class PairTable:
    """Which two parts merge, with what rank and into what, over arrays."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]], vocabulary: int):
        ordered = sorted((a * vocabulary + b, rank, made) for (a, b), (rank, made) in merges.items())
        self.vocabulary = vocabulary
        self.pairs, self.ranks, made = (np.array(c, np.int64) for c in zip(*ordered))
        self.made = np.zeros(int(self.ranks.max()) + 1, np.int32)
        self.made[self.ranks] = made

    def leaves(self, left: np.ndarray, right: np.ndarray, places: np.ndarray | int) -> np.ndarray:
        """rank << PLACE_BITS | place of each pair, OPEN_END where two parts don't merge."""
        pairs = left.astype(np.int64) * self.vocabulary + right
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, self.ranks[at] << PLACE_BITS | places, OPEN_END)


def merged_side_by_side(parts: np.ndarray, sizes: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """The parts left of many pieces, one after the other, and how many each has.

    ``parts``: a column for each piece, of two parts or more each, filled up below its size. The trees are the columns of one array: node 1
    is the root, node n has the children 2 n and 2 n + 1, and the leaves are the last half.
    """
    height, count = parts.shape
    width = 1 << (height - 2).bit_length()
    every = np.arange(count)
    after = np.repeat(np.arange(1, height + 1, dtype=np.int16)[:, None], count, axis=1)
    before = after - np.int16(2)
    alive = np.arange(height)[:, None] < sizes
    nodes = np.full((2 * width, count), OPEN_END)
    inside = alive[1:]
    places = np.arange(height - 1)[:, None] + np.zeros_like(sizes)
    nodes[width : width + height - 1][inside] = table.leaves(parts[:-1][inside], parts[1:][inside], places[inside])
    for at in range(width - 1, 0, -1):
        np.minimum(nodes[2 * at], nodes[2 * at + 1], out=nodes[at])

    column = every[nodes[1] != OPEN_END]
    while len(column):
        best = nodes[1, column]
        i = best & (1 << PLACE_BITS) - 1
        j = after[i, column].astype(np.int64)
        k = after[j, column].astype(np.int64)
        new = table.made[best >> PLACE_BITS]
        parts[i, column], after[i, column], alive[j, column] = new, k, False
        on = k < sizes[column]
        before[k[on], column[on]] = i[on]
        leaf = np.full(len(column), OPEN_END)
        leaf[on] = table.leaves(new[on], parts[k[on], column[on]], i[on])
        nodes[width + i, column] = leaf
        swallowed = j < width
        nodes[width + j[swallowed], column[swallowed]] = OPEN_END
        h = before[i, column].astype(np.int64)
        back = h >= 0
        nodes[width + h[back], column[back]] = table.leaves(parts[h[back], column[back]], new[back], h[back])
        changed = [(width + i, column), (width + j[swallowed], column[swallowed]), (width + h[back], column[back])]
        for _ in range(width.bit_length() - 1):
            for n, (at, c) in enumerate(changed):
                at = at >> 1
                nodes[at, c] = np.minimum(nodes[2 * at, c], nodes[2 * at + 1, c])
                changed[n] = (at, c)
        column = column[nodes[1, column] != OPEN_END]
    return parts.T[alive.T], alive.sum(axis=0)


class ByteCodec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        splitting = spec.get("pre_tokenizer") or {}
        plain = splitting.get("type") == "ByteLevel" and not splitting.get("add_prefix_space") and splitting.get("use_regex", True)
        if spec.get("normalizer") or not plain or spec["model"].get("type", "BPE") != "BPE":
            raise ValueError("only byte-level pair encoding with the standard splitting and no normaliser is supported")
        code, vocab = byte_of_char(), spec["model"]["vocab"]
        self.single = np.array([vocab[c] for c, _ in sorted(code.items(), key=lambda p: p[1])], np.int32)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.find_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.bytes_of = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(code[c] for c in token) if all(c in code for c in token) else token.encode()
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.table = PairTable(self.merges, len(self.bytes_of))
        self.split = regex.compile(PATTERN)

    def _merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of different pieces, one after the other, and where each piece's begin."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(sizes, kind="stable")
        ends = np.searchsorted(sizes[order], [1, *(2**e for e in range(1, 7)), np.iinfo(np.int64).max], "right")
        tokens, lengths = [], []
        for low, high in zip([0, *ends[:-1].tolist()], ends.tolist()):
            for at in range(low, high, SIDE_BY_SIDE):
                some = order[at : min(at + SIDE_BY_SIDE, high)]
                n = sizes[some]
                if n[-1] > SHORT:
                    trees = [PairTree(self.single[np.frombuffer(pieces[x], np.uint8)].tolist(), self.merges).merge_all() for x in some]
                    tokens += [np.array(t, np.int32) for t in trees]
                    lengths.append(np.fromiter(map(len, trees), np.int64, len(trees)))
                    continue
                height = int(n[-1])
                filled = np.frombuffer(b"".join(pieces[x].ljust(height, b"\0") for x in some), np.uint8).reshape(len(some), height)
                parts = np.ascontiguousarray(self.single[filled].T)
                left, count = (parts[0], np.ones(len(some), np.int64)) if height == 1 else merged_side_by_side(parts, n, self.table)
                tokens.append(left)
                lengths.append(count)
        count = np.empty(len(pieces), np.int64)
        count[order] = np.concatenate(lengths) if lengths else 0
        begin = np.zeros(len(pieces), np.int64)
        begin[order] = np.cumsum(np.concatenate(lengths)) - count[order] if lengths else 0
        return (np.concatenate(tokens) if tokens else np.zeros(0, np.int32)), np.stack((begin, count))

    def _pieces(self, text: str) -> list[str | int]:
        """The pieces of a text, an added token as its number."""
        if self.find_added is None:
            return self.split.findall(text)
        out, at = [], 0
        for m in self.find_added.finditer(text):
            out += self.split.findall(text[at : m.start()])
            out.append(self.added[m.group()])
            at = m.end()
        return out + self.split.findall(text[at:]) if at else self.split.findall(text)

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The token numbers of each text; the different pieces of a bounded stretch of texts are merged together."""
        for part in portions(texts):
            found = [self._pieces(text) for text in part]
            number: dict[str | int, int] = {}
            for pieces in found:
                for piece in pieces:
                    number.setdefault(piece, len(number))
            plain = [p.encode() for p in number if not isinstance(p, int)]
            tokens, spans = self._merged(plain)
            added = [p for p in number if isinstance(p, int)]
            where = np.array([not isinstance(p, int) for p in number], bool)
            begin, count = np.empty(len(number), np.int64), np.ones(len(number), np.int64)
            begin[where], count[where] = spans
            begin[~where] = len(tokens) + np.arange(len(added))
            tokens = np.concatenate((tokens, np.array(added, np.int32)))
            for pieces in found:
                at = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
                n = count[at]
                ends = np.cumsum(n)
                yield tokens[np.repeat(begin[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text])).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode(errors="replace")


@lru_cache(maxsize=1)
def codec(path: str) -> ByteCodec:
    """One codec for each Python worker."""
    return ByteCodec(path)


def encoded(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the token numbers of each text. ``vocabulary``: the path of the file, which every executor can read."""

    @F.pandas_udf("array<int>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = codec(vocabulary)
        for batch in texts:
            yield pd.Series(list(of.encode_all(batch)))

    return id_and_text(docs, id_col, text_col).select("doc_id", encode("text").alias("ids"))


def decoded(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text``: the text of each array of token numbers; null gives an empty text. Broken sequences of bytes show as U+FFFD."""

    @F.pandas_udf("string")
    def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = codec(vocabulary)
        for batch in ids:
            yield batch.map(lambda x: "" if x is None else of.decode(x.tolist()))

    return tokens.select(F.col(id_col).alias("doc_id"), decode(F.col(ids_col)).alias("text"))


def round_trips(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: each text encoded and decoded in one pass, one text's tokens at a time.

    ids_sha256 is over the decimal numbers joined by commas, decoded_sha256 over the decoded text in UTF-8.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def trip(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = codec(vocabulary)
        for batch in texts:
            rows = []
            for found in of.encode_all(batch):
                ids = found.tolist()
                written = ",".join(map(str, ids)).encode()
                rows.append((len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(of.decode(ids).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).select("doc_id", trip("text").alias("t")).select("doc_id", "t.*")
