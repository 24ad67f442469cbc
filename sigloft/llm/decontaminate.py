"""Benchmark decontamination by an embedding of edit distance and bit-sampling hashing.

Texts and items are sequences of lower-cased words, without signs at their ends; in scripts that put no spaces between words each character is
a word. A random walk over a sequence writes the word under its
pointer and moves on or stays, as a random function of the step and the word tells; two sequences at edit distance k get rows of writings
that differ in a number of places bounded in k (Chakraborty, Goldenberg, Koucky). A table samples a few places of the walk of one random
function; windows of a text whose samples all agree with an item's are candidates. The number of tables is set so that, at the allowed
number of edits, a simulation over the items themselves reaches the target recall; tables and walks are added until it does. Items of over LONGEST words are searched in pieces of
about that size, each a match of its own. Candidates are verified: the exact edit distance of the whole item to the best stretch of the
text may be at most MOST_EDITS of its words.

Windows have the sizes of the items, in classes within a factor of GROWTH; an item is looked up by its first words, as many as its class
has. A window is walked only if enough pairs of neighbouring words in it are neighbours in any item: an edit undoes two pairs at most and
moves one out of the window, so one with fewer has more edits to every item than are allowed, and this leaves out no match. Items are
worked on in blocks of bounded size, each block against all texts, so what is sent to the tasks is bounded however large the benchmark is.

Short items are searched like others: what has no room for an edit is found where it stands verbatim. Since items of fewer than SURE words
also stand in clean texts, their matches are reported and alone don't make `clean` drop a row.

Null texts are empty. Items without a word, null ones among them, have no match; repeated items are each reported by their id, equal rows once. Rows with a null id are reported under a null id, repeated rows once each.
Empty tables give no rows. Only the named columns are read.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloft.llm.common import id_and_text

MOST_EDITS, SURE, LONGEST, GROWTH = 0.15, 5, 256, 1.2
#: Below this number of words each size is a class of its own.
SMALLEST_CLASS = 8
#: Tables and walks come in rounds; if the last round is reached, the target recall can't be had and an error says so.
WALKS, TABLES, ROUNDS = 4, 32, 32
SAMPLED, RECALL, TRIALS, SEED = 3, 0.98, 400, 11
#: Steps of a walk for each word of a window: at one move in two steps it gets to the window's end.
STEPS = 1.6
#: Words of the items of one block.
BLOCK_WORDS = 400_000
#: A key is first looked up in a table of this many flags.
FLAGS = 1 << 16
#: Flags of pairs of neighbouring words.
PAIRS = 1 << 22
#: Words of texts that are filtered, and windows that are walked, at once.
CHUNK_WORDS, CHUNK_WINDOWS = 1 << 20, 1 << 15
SIGNS = string.punctuation + "«»“”„‘’‚¿¡…–—·"
#: Thai, Lao, Myanmar, Khmer, Kana and Han, by their blocks.
SPACELESS = "\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003ffff"
_SPACELESS = re.compile(f"[{SPACELESS}]")
_STRETCH = re.compile(rf"[{SPACELESS}]|[^\s{SPACELESS}]+")
MATCH = "doc_id long, item_id long, start int, end int, edits int, item_words int"


def words_of(text: str) -> list[str]:
    """Lower-cased stretches without white space and without signs at their ends; those of signs alone are left out."""
    low = text.lower()
    if not low.isascii():
        low = _SPACELESS.sub(r" \g<0> ", low)
    return [w for w in (x.strip(SIGNS) for x in low.split()) if w]


def places_of(text: str) -> list[tuple[int, int]]:
    """Where each of the words stands in the text; lower-casing may change a text's length."""
    low = text.lower()
    origin = None if len(low) == len(text) else [i for i, c in enumerate(text) for _ in c.lower()]
    out = []
    for m in _STRETCH.finditer(low):
        left = len(m.group()) - len(m.group().lstrip(SIGNS))
        if word := m.group().strip(SIGNS):
            a = m.start() + left
            out.append((a, a + len(word)) if origin is None else (origin[a], origin[a + len(word) - 1] + 1))
    return out


def best_edits(item: list, text: list) -> tuple[int, int]:
    """The least edit distance of the item to a stretch of the text, and where the first such stretch ends.

    One bit for each word of the item holds the differences down a column of the distance table (Myers).
    """
    n = len(item)
    places: dict = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best, end = n, 0
    for j, w in enumerate(text):
        same = places.get(w, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        plus, minus = down | ~(diagonal | up) & full, diagonal & up
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(diagonal | plus) & full, diagonal & plus
        if score < best:
            best, end = score, j + 1
    return best, end


def cut(words: list[str]) -> list[list[str]]:
    """The words of an item, long ones in pieces of nearly equal size of at most LONGEST."""
    n = -(-len(words) // LONGEST)
    return [words[len(words) * i // n : len(words) * (i + 1) // n] for i in range(n)]


class WindowIndex:
    """The tables of one block of items. Words that no item has are all number 0."""

    def __init__(self, items: list[tuple[int, str]], most_edits: float = MOST_EDITS, recall: float = RECALL):
        self.most_edits = most_edits
        split = [(i, w) for i, t in items for w in cut(words_of(t))]
        self.number = {w: n for n, w in enumerate(sorted({w for _, words in split for w in words}), 1)}
        self.items: list[tuple[int, np.ndarray]] = [(i, self.numbers(words)) for i, words in split]
        random = np.random.default_rng(SEED)
        # A step's random function of the words: a bit of the product with the step's odd number says stay or move on.
        self.longest = max((len(w) for _, w in self.items), default=0)
        self.moves = random.integers(1 << 63, size=(WALKS, int(self.longest * STEPS) + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.pairs = np.zeros(PAIRS, bool)
        classes: dict[int, list[int]] = {}
        for at, (_, words) in enumerate(self.items):
            self.pairs[self._pairs(words)] = True
            size = min(SMALLEST_CLASS, len(words))
            while size >= SMALLEST_CLASS and int(size * GROWTH) + 1 <= len(words):
                size = int(size * GROWTH) + 1
            classes.setdefault(size, []).append(at)
        self.classes = []
        for size, members in sorted(classes.items()):
            heads = np.stack([self.items[at][1][:size] for at in members])
            # The first words of an item can hold all the edits that the whole may have.
            edits = max(int(len(self.items[at][1]) * most_edits) for at in members)
            tables = self._tables(heads, edits, recall, size, random)
            found, flags = [], np.zeros((len(tables), FLAGS), bool)
            for t, keys in enumerate(self._keys(heads.ravel(), np.arange(len(members)) * size, size, tables)):
                places: dict[int, list[int]] = {}
                for at, key in zip(members, keys.tolist()):
                    places.setdefault(key, []).append(at)
                flags[t, (keys % np.uint64(FLAGS)).astype(np.int64)] = True
                found.append(places)
            self.classes.append((size, edits, tables, found, flags))

    @staticmethod
    def _pairs(words: np.ndarray) -> np.ndarray:
        """The flag of each pair of neighbours."""
        return (words[:-1].astype(np.int64) * 1_000_003 + words[1:]) % PAIRS

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.get, words, repeat(0)), np.int32, len(words))

    def _tables(self, heads: np.ndarray, edits: int, recall: float, size: int, random: np.random.Generator) -> list[tuple[int, list[int]]]:
        """Pairs of a walk and its sampled steps: as many as bring edited copies of the items back often enough."""
        steps = int(size * STEPS)
        drawn = lambda first: [(first + t % WALKS, sorted(random.choice(steps, min(SAMPLED, steps), replace=False).tolist())) for t in range(TABLES)]
        tables = drawn(0)
        if not edits:
            return tables[:1]
        picked = heads[random.integers(len(heads), size=TRIALS)]
        copies = []
        for row in picked:
            words = row.tolist()
            for _ in range(edits):
                kind, at, other = random.integers(3), int(random.integers(len(words))), int(random.integers(len(self.number) + 1))
                if kind == 0:
                    words[at] = other
                elif kind == 1 and len(words) > 1:
                    del words[at]
                else:
                    words.insert(at, other)
            copies.append((words + [0] * size)[:size])
        starts, met = np.arange(TRIALS) * size, np.zeros(TRIALS, bool)
        one, other = picked.ravel(), np.array(copies, np.int32).ravel()
        for r in range(ROUNDS):
            if r:
                tables += drawn(r * WALKS)
                if len(self.moves) == r * WALKS:
                    more = random.integers(1 << 63, size=(WALKS, self.moves.shape[1]), dtype=np.uint64)
                    self.moves = np.concatenate((self.moves, more * np.uint64(2) + np.uint64(1)))
            new = tables[r * TABLES :]
            for n, (x, y) in enumerate(zip(self._keys(one, starts, size, new), self._keys(other, starts, size, new)), r * TABLES + 1):
                met |= x == y
                if met.mean() >= recall:
                    return tables[:n]
        raise ValueError(f"{len(tables)} tables bring back {met.mean():.3f} of items of {size} words with {edits} edits, not {recall}")

    def _keys(self, words: np.ndarray, starts: np.ndarray, size: int, tables: list[tuple[int, list[int]]]) -> Iterator[np.ndarray]:
        """For each table the sampled writings of its walk over each window, mixed into one number."""
        written = {}
        padded = np.append(words, 0)
        for walk in sorted({w for w, _ in tables}):
            wanted = {s for w, steps in tables if w == walk for s in steps}
            at = np.zeros(len(starts), np.int64)
            for step in range(max(wanted) + 1):
                symbol = np.where(at < size, padded[np.minimum(starts + at, len(words))], 0).astype(np.uint64)
                if step in wanted:
                    written[walk, step] = symbol
                at += ((symbol + np.uint64(1)) * self.moves[walk, step] >> np.uint64(63)).astype(np.int64)
        for t, (walk, steps) in enumerate(tables):
            key = np.full(len(starts), t + 1, np.uint64)
            for step in steps:
                key = (key ^ written[walk, step]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            yield key

    def candidates(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(start, item) of every window that meets an item in a table."""
        if not len(words):
            return []
        known = np.concatenate(([0], np.cumsum(self.pairs[self._pairs(words)] & (words[:-1] > 0) & (words[1:] > 0))))
        out = set()
        for size, edits, tables, found, flags in self.classes:
            ends = np.minimum(np.arange(len(known)) + size - 1, len(known) - 1)
            passing = np.nonzero(known[ends] - known >= size - 1 - 3 * edits)[0]
            if not edits:
                passing = passing[words[passing] > 0]
            for i in range(0, len(passing), CHUNK_WINDOWS):
                starts = passing[i : i + CHUNK_WINDOWS]
                for t, keys in enumerate(self._keys(words, starts, size, tables)):
                    for at in np.nonzero(flags[t, (keys % np.uint64(FLAGS)).astype(np.int64)])[0].tolist():
                        for item in found[t].get(int(keys[at]), ()):
                            out.add((int(starts[at]), item))
        return sorted(out, key=lambda x: (x[1], x[0]))

    def matches(self, words: np.ndarray, met: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
        """(item id, first word, end word, edits, item words) of the verified candidates; overlapping ones of an item once."""
        out, done = [], {}
        for start, at in met:
            item_id, item = self.items[at]
            n, most = len(item), int(len(item) * self.most_edits)
            if start < done.get(at, 0):
                continue
            # All stretches that start within ``most`` words of this window or the next ``most`` ones lie within what is compared.
            low = max(0, start - most)
            edits, end = best_edits(item.tolist(), words[low : start + n + 3 * most].tolist())
            if edits > most:
                done[at] = start + most + 1
            else:
                back, length = best_edits(item[::-1].tolist(), words[low : low + end][::-1].tolist())
                out.append((item_id, low + end - length, low + end, edits, n))
                done[at] = low + end
        return out


def blocks(benchmark: DataFrame, item_col: str, text_col: str, most_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, read one partition of the benchmark after the other."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL").distinct()
    for r in rows.toLocalIterator():
        block.append((r.item_id, r.text))
        size += len(r.text) // 4 + 1
        if size >= most_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    most_edits: float = MOST_EDITS, recall: float = RECALL, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """MATCH for each stretch of a text that is an item within the allowed edits; start and end in code points, end exclusive."""
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col)
    found = spark.createDataFrame([], MATCH)
    for block in blocks(benchmark, item_col, item_text_col, block_words):
        index = spark.sparkContext.broadcast(WindowIndex(block, most_edits, recall))

        def search(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            of = index.value
            for batch in batches:
                out, waiting, size = [], [], 0
                for doc_id, text in zip(batch["doc_id"], batch["text"]):
                    words = of.numbers(words_of(text))
                    if len(words):
                        waiting.append((doc_id, text, words))
                        size += len(words)
                    if size >= CHUNK_WORDS:
                        out += _matched(of, waiting)
                        waiting, size = [], 0
                out += _matched(of, waiting)
                yield pd.DataFrame(out, columns=[c.split()[0] for c in MATCH.split(", ")]).astype({"doc_id": "Int64", "item_id": "Int64"})

        found = found.unionByName(texts.mapInPandas(search, MATCH))
    return found


def _matched(index: WindowIndex, texts: list[tuple[int, str, np.ndarray]]) -> list[tuple]:
    """The matches of several texts, whose windows are walked together; windows that cross into the next text don't verify."""
    if not texts or not index.classes:
        return []
    # A stretch of unknown words between two texts keeps their windows apart.
    gap = np.zeros(index.longest, np.int32)
    ends = np.cumsum([len(w) + len(gap) for _, _, w in texts])
    met = index.candidates(np.concatenate([x for _, _, w in texts for x in (w, gap)]))
    by_text: dict[int, list[tuple[int, int]]] = {}
    for start, item in met:
        i = int(np.searchsorted(ends, start, "right"))
        by_text.setdefault(i, []).append((start - int(ends[i] - len(gap) - len(texts[i][2])), item))
    out = []
    for i, own in sorted(by_text.items()):
        doc_id, text, words = texts[i]
        if hits := index.matches(words, own):
            places = places_of(text)
            out += [(doc_id, item, places[a][0], places[b - 1][1], edits, n) for item, a, b, edits, n in hits]
    return out


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = SURE) -> DataFrame:
    """The rows of ``docs`` without a match of ``least_words``. Rows with a null id stay; rows of one id go together."""
    gone = contaminated(docs, benchmark, id_col, text_col).filter(F.col("item_words") >= least_words).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
