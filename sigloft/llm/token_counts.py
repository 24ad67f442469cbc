"""Exact token counts at every prefix of a text.

The vocabulary is a byte-level BPE file. Its splitting pattern cuts a text into pieces that merges never cross; within a piece a table
over its prefixes (see ``merges``) holds the number of tokens of each prefix. Together they give the exact count of every prefix of the
text, as encoding that prefix alone would, so that truncation and budget questions need no encoding again.

Null texts are empty and have no tokens. The vocabulary's added tokens count as one token where their string stands in a text, as the
library has it. Texts are worked through piece by piece: memory is bounded by one text and by tables of fixed size. Repeated rows and
ids give one row each, empty tables none; only the named columns are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloft.llm.common import id_and_text, portions
from sigloft.llm.merges import PairEncoding, Remembered

#: Fixed value: the pattern by which byte-level BPE vocabularies of this kind cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer pieces are worked out each time, so that what is remembered stays small.
SHORT = 64


def byte_of_char() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary: a printable byte for itself, the others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        code = byte_of_char()
        raw = lambda token: bytes(code[c] for c in token)
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        symbols = [bytes([b]) for b in range(256)]
        self.bpe = PairEncoding(symbols, {raw(a + b): i for i, (a, b) in enumerate(pairs)}, {(raw(a), raw(b)) for a, b in pairs})
        self.split = regex.compile(PATTERN)
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.totals = Remembered(lambda piece: self.bpe.prefixes(piece.encode())[1][-1], longest=SHORT)
        self.total = self.totals.__getitem__

    def prefixes(self, piece: str) -> list[int]:
        """The number of tokens of each prefix of a piece, in code points, from the empty one on."""
        raw = piece.encode()
        counts = self.bpe.prefixes(raw)[1]
        if len(raw) == len(piece):
            return counts[:]
        return [counts[0], *(counts[j] for j in np.cumsum([len(c.encode()) for c in piece]))]

    def stretches(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between added tokens, and these."""
        at = 0
        for m in self.added.finditer(text) if self.added else ():
            yield text[at : m.start()], False
            yield m.group(), True
            at = m.end()
        yield text[at:], False

    def counts(self, texts: list[str]) -> list[int]:
        """The numbers of tokens of several texts."""
        return [n for n, _ in self.measured(texts)]

    def measured(self, texts: list[str], limit: int | None = None) -> Iterator[tuple[int, int]]:
        """The number of tokens of each text, and how much of it stays under ``limit`` (see ``truncate``).

        The new pieces of all texts are worked out together.
        """
        found = [[(part, None if added else self.split.findall(part)) for part, added in self.stretches(text)] for text in texts]
        self.totals.prepare(set().union(*(pieces for parts in found for _, pieces in parts if pieces is not None)))
        for text, parts in zip(texts, found):
            n = sum(1 if pieces is None else sum(map(self.total, pieces)) for _, pieces in parts)
            yield n, len(text) if limit is None or n <= limit else self._within(parts, limit)

    def _within(self, parts: list[tuple[str, list[str] | None]], limit: int) -> int:
        """The number of code points before the first prefix of over ``limit`` tokens."""
        base = at = 0
        for part, pieces in parts:
            if pieces is None:
                counts = [base + self._plain(part[:i]) for i in range(1, len(part))] + [base + 1]
                if max(counts) > limit:
                    return at + next(i for i, c in enumerate(counts) if c > limit)
                base += 1
            else:
                sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
                bases = base + np.concatenate(([0], np.cumsum(np.fromiter(map(self.total, pieces), np.int64, len(pieces)))))
                # A stretch has no more tokens than bytes, so no prefix in the other pieces has too many.
                for i in np.nonzero(bases[:-1] + 4 * (sizes + np.concatenate(([0], sizes[:-1]))) > limit)[0].tolist():
                    space = pieces[i - 1] if i and pieces[i - 1].isspace() else ""
                    counts = self._inside(int(bases[i]), space, pieces[i])
                    if max(counts) > limit:
                        return at + int(sizes[:i].sum()) + next(k for k, c in enumerate(counts) if c > limit)
                base = int(bases[-1])
            at += len(part)
        return at

    def _plain(self, text: str) -> int:
        return sum(map(self.total, self.split.findall(text)))

    def _inside(self, base: int, space: str, piece: str) -> list[int]:
        """The token counts of the prefixes that end in a piece, behind ``base`` tokens of which the last are white space or none."""
        if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():
            return [base + self._plain(piece[:i]) for i in range(1, len(piece))] + [base + self.total(piece)]
        counts = [base + c for c in self.prefixes(piece)[1:]]
        if space and piece[0].isspace():  # cut here, the white space before ends the text and is one piece
            counts[0] = base - self.total(space) + self.total(space + piece[0])
        return counts

    def prefix_counts(self, text: str) -> np.ndarray:
        """The exact token count of ``text[:i]`` for every i from 0 to its length."""
        out, base = [0], 0
        for part, added in self.stretches(text):
            if added:
                out += [base + self._plain(part[:i]) for i in range(1, len(part))] + [base + 1]
                base += 1
                continue
            space = ""
            for piece in self.split.findall(part):
                out += self._inside(base, space, piece)
                base += self.total(piece)
                space = piece if piece.isspace() else ""
        return np.array(out, np.int64)

    def truncate(self, text: str, limit: int) -> int:
        """The number of code points before the first prefix of over ``limit`` tokens; all if the whole text has no more."""
        return next(self.measured([text], limit))[1]


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One counter for each Python worker and vocabulary."""
    return PrefixCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, kept_chars``; kept_chars: the code points to keep for at most ``limit`` tokens.

    ``vocabulary``: the path of the file, which every executor must be able to read.
    """

    @F.pandas_udf("n_tokens long, kept_chars long")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = counter(vocabulary)
        for batch in texts:
            rows = [row for part in portions(batch) for row in of.measured(part, limit)]
            yield pd.DataFrame(np.array(rows, np.int64).reshape(-1, 2), columns=["n_tokens", "kept_chars"])

    out = id_and_text(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), counted("text").alias("c"))
    return out.select("doc_id", "n_bytes", "c.n_tokens", (F.col("c.n_tokens") > limit).alias("over_limit"), "c.kept_chars")
