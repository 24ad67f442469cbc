"""Passages that repeat across documents, found by collinear chaining of shared k-mers.

Seeds are hashes of K lower-cased words; of each W neighbouring ones the least stands for all. Where a seed occurs several times in a
document, the first occurrence of one document is matched with the first of another, the second with the second, and so on; the second
and later ones are matched with the anchor's first as well, so each stretch of a document that repeats a passage of its anchor is found,
while a second stretch of the anchor is only paired with a second one of the document. Every seed that two documents share is matched with the document of the smallest id that has it, its anchor, so a passage that many documents share
makes as many matches as documents and not as many as pairs. The matches of a document with an anchor are chained in order: a chain's
score is WEIGHT for each match less GAP for each word passed in either document, and a Fenwick tree holds the best chain before each
place. Chains of MATCHES matches are aligned word by word, between their matches and beyond both ends, and cut where the words between
two passages would break the limit of edits; a passage is an alignment of at least LEAST words on both sides with at most EDITS edits for
each word.

The seeds of a passage may have other anchors each, if it is made of lines that are frequent by themselves. So seeds that no passage covers
and that stand among shared seeds only, over SPREAD places, are followed by a search for equal stretches of LEAST words around them, of
which each has an anchor of its own: all documents that have the stretch meet there, and it is a passage by itself. So each seed that two
documents have in an equal stretch of LEAST words or more is in some passage. Passages with edits get a third search: of the seeds that no
passage covers yet, every two of a document with K to LEAST words between their places are a key of their own, with its own anchor, so seeds
that are frequent by themselves find the documents that have them together. Only where all such pairs of a passage have an anchor without the
passage, that is, are frequent as pairs, is a passage with edits missed.

Seeds are sure for exact passages; of passages with edits some have none. `test_recall` plants passages of 50, 65, 80 and 100 random words with
substitutions, deletions and insertions at random places inside, 5 to 20 for 100 words, and finds 99 to 100 % of each kind that keep 50 words
and that brute force takes for a passage.

Result rows pair a document with an anchor; documents that share a passage are all paired with the same anchor, so pairs between them
need not be listed. Null and short texts have no passage. Rows with a null id are not searched, since a row could not name them. Rows of
one id count as one document; if their texts differ, the alignment holds for one of them. Exact copies are passages as long as the
text. Empty tables give no rows. Only the two named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloft.llm.common import id_and_text, portions
from sigloft.llm.decontaminate import best_edits
from sigloft.session import small_batches, stored

K, W, LEAST, EDITS = 5, 4, 50, 0.2
WEIGHT, GAP = 16.0, 0.25
#: Words beside a chain that an alignment may reach, how far it looks behind an edit, and for how many equal words.
MARGIN, LOOK, RESUME = 64, 4, 3
#: Matches that a chain needs. With EDITS the words between edits may be few, so nothing is asked of how far apart they are.
MATCHES = 2
#: Any exact passage of LEAST words has shared seeds without another between them over this many places.
SPREAD = LEAST - K - 4 * (W - 1)
#: Bits of the filter that shared seeds pass, as a power of two.
FILTER = 27
#: ``step``: places to the document's next seed, -1 in rows of second and later occurrences by number.
SEEDS = "key long, doc long, pos int, step int"
RUNS = "doc long, key long, start int, stop int, open boolean"
WINDOWS = "key long, doc long, pos int"
PAIRS = "key long, doc long, pos int, far int"
#: One row for each document: its chains one after the other, and of each the anchor, the words of the anchor to align with, and its length.
#: Binary columns are the bytes of int32 numbers; for keys of int64, for steps, which are at most W, of int8 ones.
CHAINS = "doc long, links array<struct<anchor: long, low: int, high: int>>, sizes binary, anchor_pos binary, pos binary"
#: The same with the shared seeds of the document, by place, and how many places lie from the first to the last.
CHAINS_AND_SEEDS = f"{CHAINS}, places binary, steps binary, keys binary, reach int"
#: The words of one side of a chain; rows of the anchor's side have no ``doc``.
STRETCHES = "anchor long, low int, high int, doc long, start int, anchor_pos binary, pos binary, words binary"
PASSAGES = "doc_id long, start_word int, end_word int, other_id long, other_start int, other_end int, edits int"
#: Code points of texts, rows of matches and seeds that are worked on at once; places of different documents are kept as far apart as FAR.
LETTERS, ROWS, SEEDS_AT_ONCE, FAR = 1 << 20, 1 << 16, 1 << 14, 1 << 40


def words_of(text: str) -> np.ndarray:
    found = text.lower().encode().split()
    return np.fromiter(map(zlib.crc32, found), np.uint32, len(found))


def _words_of_all(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of the texts that have LEAST of them, one after the other, how many each has, and which texts these are."""
    words = [words_of(text) for text in texts]
    which = np.array([i for i, w in enumerate(words) if len(w) >= LEAST], np.int64)
    kept = [words[i] for i in which]
    return np.concatenate([np.zeros(0, np.uint32), *kept]), np.array([len(w) for w in kept], np.int64), which


def seed_rows(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The keys (seed and number of its occurrence), texts, places and steps of the seeds of texts of LEAST words or more; ``words`` has
    those of all texts, one after the other.

    Second and later occurrences come again, at the end, under the key of the first, with the place's complement.
    """
    if not len(sizes):
        return (np.zeros(0, np.int64),) * 4
    hashes = np.zeros(len(words) - K + 1, np.uint64)
    for i in range(K):
        hashes = (hashes ^ words[i : i + len(hashes)]) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(32)
    counts = sizes - K + 1
    starts = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(sizes)), counts)
    hashes = hashes[np.arange(len(text)) + text * (K - 1)]
    # The least of each window that lies in one text, at its start.
    least = np.zeros(len(hashes), np.uint64)
    least[: len(hashes) - W + 1] = np.minimum.reduce([hashes[i : len(hashes) - W + 1 + i] for i in range(W)])
    for i in range(1, W):
        least[starts + counts - i] = 0
    # A place is taken if it is the least of any window that holds it.
    most = least.copy()
    for i in range(1, W):
        most[i:] = np.maximum(most[i:], least[:-i])
    at = np.nonzero(most == hashes)[0]
    taken, text = hashes[at], text[at]
    places = at - starts[text]
    order = np.argsort(taken, kind="stable")
    first = np.concatenate(([True], (taken[order][1:] != taken[order][:-1]) | (text[order][1:] != text[order][:-1])))
    number = np.empty(len(order), np.uint64)
    number[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    steps = np.where(np.append(text[1:] == text[:-1], False), np.diff(places, append=0), 0)
    again = number > 0
    taken, number = np.concatenate((taken, taken[again])), np.concatenate((number, 0 * number[again]))
    keys = (taken ^ (number * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
    steps = np.concatenate((np.where(again, -1, steps), steps[again]))
    return keys.view(np.int64), np.concatenate((text, text[again])), np.concatenate((places, ~places[again])), steps


def seeds_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys and places of the rows of a text's seeds."""
    keys, _, places, _ = seed_rows(words, np.array([len(words)]))
    return keys, places


def _seeds(batches: Iterator[pa.RecordBatch], shared: np.ndarray) -> Iterator[pa.RecordBatch]:
    """SEEDS of all texts that pass the filter (see ``shared_keys``)."""
    for batch in batches:
        docs, done = batch.column("doc_id").to_numpy(), 0
        for part in portions(batch.column("text").to_pylist(), LETTERS):
            words, sizes, which = _words_of_all(part)
            keys, text, places, steps = seed_rows(words, sizes)
            passing = _passing(shared, keys)
            doc = docs[done + which[text[passing]]].astype(np.int64)
            done += len(part)
            if len(doc):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[passing]), pa.array(doc), pa.array(places[passing].astype(np.int32)), pa.array(steps[passing].astype(np.int32))], ["key", "doc", "pos", "step"])


def _passing(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys pass a filter."""
    at = _bits(keys)
    return (held[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _bits(keys: np.ndarray) -> np.ndarray:
    """Each key's place in the filter: its highest bits."""
    return (keys.view(np.uint64) >> np.uint64(64 - FILTER)).astype(np.int64)


def shared_keys(docs: DataFrame) -> np.ndarray:
    """A filter of 2 ** FILTER bits, packed, that the key of every seed passes which several rows of ``docs`` have.

    Keys alone travel, packed by ranges of theirs: a task sends each at most twice a batch, so a frequent one stays small, and the number of
    ranges follows the number of tasks, so a range stays small too. A range gives its part of the filter, whose size doesn't depend on the
    table: over very many seeds it lets more pass that are not shared, which costs work and changes nothing.
    """
    ranges = _ranges(docs)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch.column("text").to_pylist(), LETTERS):
                keys, _, places, _ = seed_rows(*_words_of_all(part)[:2])
                # First rows alone: a text has each key once.
                keys, times = np.unique(keys[places >= 0].view(np.uint64), return_counts=True)
                if len(keys):
                    yield _packed(np.repeat(keys, np.minimum(times, 2)), ranges)

    return _filter(docs.select("text").mapInArrow(packed, PACKED), ranges, 2)


PACKED = "part int, keys binary"


def _ranges(df: DataFrame) -> int:
    return 1 << max(8, min(FILTER - 3, (4 * df.rdd.getNumPartitions() - 1).bit_length()))


def _packed(keys: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Sorted keys by ranges, PACKED."""
    part, start = np.unique(keys >> np.uint64(64 - ranges.bit_length() + 1), return_index=True)
    return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([x.tobytes() for x in np.split(keys, start[1:])], pa.binary())], ["part", "keys"])


def _filter(parts: DataFrame, ranges: int, times: int) -> np.ndarray:
    """A filter of 2 ** FILTER bits, packed, that each key passes which comes so many times (once or twice) in ``parts``, PACKED."""

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, keys in zip(batch["part"], batch["keys"]):
                kept.setdefault(int(part), []).append(keys)
        rows, width = [], (1 << FILTER) // ranges
        for part, blobs in kept.items():
            keys = np.sort(np.frombuffer(b"".join(blobs), np.uint64))
            bits = np.zeros(width, bool)
            bits[_bits(keys[times - 1 :][keys[times - 1 :] == keys[: len(keys) - times + 1]]) - part * width] = True
            rows.append((part, np.packbits(bits).tobytes()))
        yield pd.DataFrame(rows, columns=["part", "bits"])

    whole = np.zeros((1 << FILTER) // 8, np.uint8)
    for r in parts.repartition(max(ranges // 16, 1), "part").mapInPandas(marked, "part int, bits binary").toLocalIterator():
        size = len(whole) // ranges
        whole[r.part * size : (r.part + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return whole


def chains_of(anchor: np.ndarray, pos: np.ndarray) -> list[list[int]]:
    """The chains of a pair's matches, as lists of their numbers, the best first; each match is in one chain at most.

    Matches come sorted by ``pos``. The tree holds, over the anchor's places, the best value of a chain's score plus the gap costs saved.
    """
    n = len(pos)
    order = np.unique(anchor, return_inverse=True)[1].tolist()
    a, b = anchor.tolist(), pos.tolist()
    size = max(order) + 1
    tree = [(-1.0, -1)] * (size + 1)
    score, before = [0.0] * n, [-1] * n
    waiting: list[int] = []
    for j in range(n):
        # A match follows only matches at earlier places of both documents.
        while waiting and b[waiting[0]] < b[j]:
            i = waiting.pop(0)
            value, at = (score[i] + GAP * (a[i] + b[i]), i), order[i] + 1
            while at <= size:
                if tree[at][0] < value[0]:
                    tree[at] = value
                at += at & -at
        best, at = (0.0, -1), order[j]
        while at:
            if tree[at][0] > best[0]:
                best = tree[at]
            at -= at & -at
        gain = best[0] - GAP * (a[j] + b[j])
        score[j], before[j] = WEIGHT + max(0.0, gain), best[1] if gain > 0 else -1
        waiting.append(j)
    out, used = [], [False] * n
    for j in sorted(range(n), key=lambda x: -score[x]):
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(j)
            j = before[j]
        if chain:
            out.append(chain[::-1])
    return out


def _labels(pair: np.ndarray, anchor: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The chain of each match, named by its last match. Matches come sorted by pair (numbered upwards), ``pos`` and ``anchor``.

    Where both places only grow, no match of a pair has a better one to follow than the one before it: a chain's value, its score with the gap
    costs saved, then only grows. So those pairs are chained all at once, as ``chains_of`` would do.
    """
    n = len(pair)
    same = pair[1:] == pair[:-1]
    starts = np.concatenate(([0], np.nonzero(~same)[0] + 1))
    stops = np.append(starts[1:], n)
    number = np.repeat(np.arange(len(starts)), stops - starts)
    turns = same & ((anchor[1:] <= anchor[:-1]) | (pos[1:] <= pos[:-1]))
    turning = np.bincount(number[1:], turns, len(starts)) > 0
    # Value of a chain up to each match: WEIGHT more than the value before it or the match's own start, the greater; pairs are kept apart.
    own = GAP * (anchor + pos) - WEIGHT * np.arange(n)
    apart = (own.max() - own.min() + 1.0) * number
    value = np.maximum.accumulate(own + apart) - apart
    begins = np.concatenate(([True], ~same | (own[1:] >= value[:-1])))
    score = value - own + WEIGHT
    # A chain goes from the best match of what is left back to the first; what follows it is left.
    left = np.cumsum(begins)
    apart = (score.max() + 1.0) * (left[-1] - left)
    best = np.maximum.accumulate((score + apart)[::-1])[::-1]
    ends = np.concatenate(((score + apart)[:-1] >= best[1:], [True])) | np.append(begins[1:], True)
    at = np.nonzero(ends)[0]
    labels = at[np.searchsorted(at, np.arange(n), "left")]
    for k in np.nonzero(turning)[0].tolist():
        i, j = starts[k], stops[k]
        for chain in chains_of(anchor[i:j], pos[i:j]):
            labels[i + np.array(chain)] = i + chain[-1]
    return labels


def _whole_documents(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns over all rows of some documents; rows come by ``doc``, the first column. The last document waits for the next rows."""
    kept, waiting, size = [np.zeros(0, np.int64) for _ in columns], [], 0
    for batch in batches:
        waiting.append([batch.column(c).to_numpy() for c in columns])
        size += batch.num_rows
        if size >= max(ROWS, len(kept[0])):
            values = [np.concatenate(x) for x in zip(kept, *waiting)]
            last = int(np.searchsorted(values[0], values[0][-1]))
            if last:
                yield [v[:last] for v in values]
            kept, waiting, size = [v[last:] for v in values], [], 0
    values = [np.concatenate(x) for x in zip(kept, *waiting)]
    if len(values[0]):
        yield values


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts))).astype(np.int32)


def _blobs(values: np.ndarray, counts: np.ndarray, kind: type = np.int32) -> pa.Array:
    """The bytes of so many values for each row, one row after the other."""
    values, offsets = np.ascontiguousarray(values, kind), _offsets(counts * np.dtype(kind).itemsize)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _numbers(batch: pa.RecordBatch, name: str, kind: type = np.int32) -> tuple[np.ndarray, np.ndarray]:
    """The values of such a column, and where each row's begin; the last place is the end."""
    column = batch.column(name)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(values.tobytes(), kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def _chains(batches: Iterator[pa.RecordBatch], needed: int, seeds: bool) -> Iterator[pa.RecordBatch]:
    """CHAINS, or CHAINS_AND_SEEDS, of matches that come by document."""
    for doc, anchor, anchor_pos, pos, *more in _whole_documents(batches, ["doc", "anchor", "anchor_pos", "pos", *(["step", "key"] if seeds else [])]):
        docs = np.unique(doc)
        met = np.nonzero(doc != anchor)[0]
        met = met[np.lexsort((anchor_pos[met], pos[met], anchor[met], doc[met]))]
        d, a, x, y = doc[met], anchor[met], anchor_pos[met], pos[met]
        if len(met):
            label = _labels(np.cumsum(np.concatenate(([0], (d[1:] != d[:-1]) | (a[1:] != a[:-1])))), x, y)
            order = np.argsort(label, kind="stable")
            first = np.nonzero(np.concatenate(([True], label[order][1:] != label[order][:-1])))[0]
            sizes = np.diff(first, append=len(order))
            order, sizes = order[np.repeat(sizes >= needed, sizes)], sizes[sizes >= needed]
        else:
            order, sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        first, last = order[ends - sizes], order[ends - 1]
        links = pa.StructArray.from_arrays(
            [pa.array(a[first]), pa.array(np.maximum(x[first] - MARGIN, 0).astype(np.int32)), pa.array((x[last] + K + MARGIN).astype(np.int32))], ["anchor", "low", "high"])
        chains = np.bincount(np.searchsorted(docs, d[first]), minlength=len(docs))
        matched = np.bincount(np.searchsorted(docs, d[order]), minlength=len(docs))
        links = pa.ListArray.from_arrays(pa.array(_offsets(chains)), links)
        columns = [pa.array(docs), links, _blobs(sizes, chains), _blobs(x[order], matched), _blobs(y[order], matched)]
        if seeds:
            # Each seed comes once, under the key of the first occurrence.
            step, key = more
            order = np.nonzero(step >= 0)[0]
            order = order[np.lexsort((key[order], step[order], pos[order], doc[order]))]
            d, x, y, z = doc[order], pos[order], step[order], key[order]
            again = np.concatenate(([False], (d[1:] == d[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1]) & (z[1:] == z[:-1])))[: len(d)]
            counts = np.bincount(np.searchsorted(docs, d[~again]), minlength=len(docs))
            d, x, y, z = d[~again], x[~again], y[~again], z[~again]
            reach = np.zeros(len(docs), np.int32)
            ends = np.cumsum(counts)[counts > 0]
            reach[counts > 0] = x[ends - 1] - x[ends - counts[counts > 0]]
            columns += [_blobs(x, counts), _blobs(y, counts, np.int8), _blobs(z, counts, np.int64), pa.array(reach)]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "links", "sizes", "anchor_pos", "pos", "places", "steps", "keys", "reach"][: len(columns)])


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two sequences have in common from their start."""
    n = min(len(a), len(b))
    different = a[:n] != b[:n]
    return int(different.argmax()) if different.any() else n


#: The ways past an edit, those that pass the fewest words first.
PAST = sorted((max(x, y), x, y) for x in range(LOOK + 1) for y in range(LOOK + 1) if x or y)


def _extended(a: np.ndarray, b: np.ndarray, resume: int = RESUME) -> list[tuple[int, int, int]]:
    """How far an alignment goes on from the start of both, and its edits, step by step: it passes edits behind which words are equal again."""
    i = j = edits = 0
    out = []
    left, right = a.tolist(), b.tolist()
    u_most, v_most = len(left) - resume, len(right) - resume
    while True:
        n = _equal(a[i:], b[j:]) if i < len(left) and j < len(right) and left[i] == right[j] else 0
        i, j = i + n, j + n
        out.append((i, j, edits))
        if i > u_most or j > v_most:
            return out
        for cost, x, y in PAST:
            u, v = i + x, j + y
            if u <= u_most and v <= v_most and left[u] == right[v] and left[u : u + resume] == right[v : v + resume]:
                i, j, edits = u, v, edits + cost
                break
        else:
            return out


def _distance(a: np.ndarray, b: np.ndarray) -> int:
    """The edit distance of two stretches as wholes."""
    if not len(a) or not len(b):
        return max(len(a), len(b))
    if min(len(a), len(b)) == 1:
        return max(len(a), len(b)) - int((a == b).any())
    # Marks that occur nowhere else, as many as words, hold both ends in place.
    pad = len(a) + len(b) + 1
    ends = [[-1] * pad, [-2] * pad]
    return best_edits(ends[0] + a.tolist() + ends[1], ends[0] + b.tolist() + ends[1])[0]


def _longest(gain: np.ndarray, length: np.ndarray) -> tuple[int, int]:
    """First and last run of the longest stretch whose gains don't sum below zero; ``gain`` and ``length``: run, gap, run, ... run."""
    if len(gain) == 1:
        return 0, 0
    sums, ends = np.concatenate(([0.0], np.cumsum(gain))), np.concatenate(([0], np.cumsum(length)))
    starts = np.arange(0, len(gain), 2)
    # A start counts only if the sum before it is the least so far; for each end the first start with a sum not above is the longest.
    least = np.minimum.accumulate(sums[starts])
    first = np.searchsorted(-least, -(sums[starts + 1] + 1e-9), "left")
    last = int((ends[starts + 1] - ends[starts[first]]).argmax())
    return int(first[last]), last


def align(a: np.ndarray, b: np.ndarray, places: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(start, end) in both sequences and the edits of each alignment through the matches of a chain that keeps to EDITS.

    The longest stretch of the chain within the limit is taken, then the longest on either side of it, until each match is in one; each
    is then extended at both ends, as far as the limit and its neighbours allow.
    """
    runs, edits = [], []
    for x, y in places:
        if runs and (x < runs[-1][1] or y < runs[-1][3]):
            continue
        if runs:
            edits.append(_distance(a[runs[-1][1] : x], b[runs[-1][3] : y]))
        n = _equal(a[x:], b[y:])
        runs.append((x, x + n, y, y + n))
    length, cost = np.zeros(2 * len(runs) - 1, np.int64), np.zeros(2 * len(runs) - 1)
    length[::2] = [r[1] - r[0] for r in runs]
    length[1::2] = [max(s[0] - r[1], s[2] - r[3]) for r, s in zip(runs, runs[1:])]
    cost[1::2] = edits
    gain = EDITS * length - cost
    waiting, taken = [(0, len(runs))], []
    while waiting:
        low, high = waiting.pop()
        first, last = _longest(gain[2 * low : 2 * high - 1], length[2 * low : 2 * high - 1])
        taken.append((low + first, low + last))
        waiting += [(x, y) for x, y in ((low, low + first), (low + last + 1, high)) if x < y]
    taken.sort()
    out = []
    for k, (first, last) in enumerate(taken):
        (i, _, j, _), (_, i_end, _, j_end) = runs[first], runs[last]
        low_i, low_j = (out[-1][1], out[-1][3]) if out else (0, 0)
        high_i, high_j = (runs[taken[k + 1][0]][0], runs[taken[k + 1][0]][2]) if k + 1 < len(taken) else (len(a), len(b))
        inner = int(cost[2 * first : 2 * last + 1].sum())
        size = lambda w: max(w[1] - w[0], w[3] - w[2])
        for resume in (RESUME, 1):
            lefts, rights = _extended(a[low_i:i][::-1], b[low_j:j][::-1], resume), _extended(a[i_end:high_i], b[j_end:high_j], resume)
            ways = [(i - x, i_end + u, j - y, j_end + v, inner + e + f) for x, y, e in lefts for u, v, f in rights]
            # The first way has the fewest edits, those of the stretch itself.
            best = max((w for w in ways if w[4] <= EDITS * size(w) + 1e-9), key=size, default=ways[0]) if len(ways) > 1 else ways[0]
            # Only where a passage would be too short, single equal words behind an edit count as well.
            if min(best[1] - best[0], best[3] - best[2]) >= LEAST:
                break
        out.append(best)
    return out


def _list(batch: pa.RecordBatch, name: str) -> tuple[pa.Array, np.ndarray]:
    """The values of a list column, one row after the other, and where each row's begin; the last place is the end."""
    column = batch.column(name)
    offsets = column.offsets.to_numpy()
    return column.flatten(), offsets - offsets[0]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """STRETCHES of the chains of a text's row and of those asked for; rows of one text come one after the other."""
    last, words = None, np.zeros(0, np.uint32)
    for batch in batches:
        links, of = _list(batch, "links")
        anchor, low, high = (links.field(i).to_numpy() for i in range(3))
        (sizes, _), (anchor_pos, _), (pos, _) = (_numbers(batch, c) for c in ("sizes", "anchor_pos", "pos"))
        ends = np.cumsum(sizes)
        start, stop = np.maximum(pos[ends - sizes] - MARGIN, 0) if len(ends) else ends, pos[ends - 1] + K + MARGIN if len(ends) else ends
        asked, asked_of = _list(batch, "asked")
        asked_low, asked_high = (asked.field(i).to_numpy() for i in range(2))
        docs, out, asked_out = batch.column("doc").to_numpy(), [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            if text != last:
                last, words = text, words_of(text)
            out += [words[a:b].tobytes() for a, b in zip(start[of[i] : of[i + 1]].tolist(), stop[of[i] : of[i + 1]].tolist())]
            asked_out += [words[a:b].tobytes() for a, b in zip(asked_low[asked_of[i] : asked_of[i + 1]].tolist(), asked_high[asked_of[i] : asked_of[i + 1]].tolist())]
        none, more = np.zeros(len(asked_out), np.int32), np.diff(asked_of)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate((anchor, np.repeat(docs, more))), pa.int64()), pa.array(np.concatenate((low, asked_low)), pa.int32()),
            pa.array(np.concatenate((high, asked_high)), pa.int32()),
            pa.array(np.concatenate((np.repeat(docs, np.diff(of)), none)), pa.int64(), mask=np.repeat([False, True], [len(out), len(none)])),
            pa.array(np.concatenate((start, none)).astype(np.int32)),
            _blobs(anchor_pos, np.concatenate((sizes, none))), _blobs(pos, np.concatenate((sizes, none))), pa.array(out + asked_out, pa.binary()),
        ], [c.split()[0] for c in STRETCHES.split(", ")])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in PASSAGES.split(", ")]
    types = [pa.int64() if " long" in c else pa.int32() for c in PASSAGES.split(", ")]
    for batch in batches:
        out = []
        (anchor_pos, of), (pos, _) = _numbers(batch, "anchor_pos"), _numbers(batch, "pos")
        columns = [batch.column(c).to_pylist() for c in ("anchor", "low", "doc", "start", "anchor_words", "words")]
        for k, (anchor, low, doc, start, anchor_words, words) in enumerate(zip(*columns)):
            places = list(zip((anchor_pos[of[k] : of[k + 1]] - low).tolist(), (pos[of[k] : of[k + 1]] - start).tolist()))
            a, b = np.frombuffer(anchor_words, np.int32), np.frombuffer(words, np.int32)
            if places[-1][0] >= len(a) or places[-1][1] >= len(b):
                continue  # one of several texts of an id, and not the one with these matches
            for i, i_end, j, j_end, edits in align(a, b, places):
                if min(i_end - i, j_end - j) >= LEAST and edits <= EDITS * max(i_end - i, j_end - j):
                    out.append((doc, start + j, start + j_end, anchor, low + i, low + i_end, edits))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * len(names), types)], names)


def _bare(doc: np.ndarray, pos: np.ndarray, spans: pa.Array, of: np.ndarray) -> np.ndarray:
    """Which seeds no span covers; ``doc``: the row of each. Spans come by start; a seed is covered if one of those that start before it ends behind it."""
    row = np.repeat(np.arange(len(of) - 1), np.diff(of)) * FAR
    starts, stops = (spans.field(i).to_numpy() + row for i in range(2))
    reach = np.concatenate(([-1], np.maximum.accumulate(stops))) if len(stops) else np.array([-1])
    return reach[np.searchsorted(starts, pos + doc * FAR, "right")] < pos + doc * FAR + K


def _seed_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The document, its number, the place, the step and the key of the seeds of some documents, and whether no passage covers them."""
    for batch in batches:
        sizes, begin = np.diff(_numbers(batch, "places")[1]), 0
        for end in range(1, len(sizes) + 1):
            if end < len(sizes) and sizes[begin : end + 1].sum() <= SEEDS_AT_ONCE:
                continue
            part, begin = batch.slice(begin, end - begin), end
            (pos, of), (step, _), (key, _) = _numbers(part, "places"), _numbers(part, "steps", np.int8), _numbers(part, "keys", np.int64)
            pos, number = pos.astype(np.int64), np.repeat(np.arange(len(of) - 1), np.diff(of))
            yield part.column("doc").to_numpy()[number], number, pos, step, key, _bare(number, pos, *_list(part, "spans"))


def _first_of_document(number: np.ndarray, keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which rows have the first place of their key in their document."""
    order = np.lexsort((places, keys, number))
    first = np.ones(len(order), bool)
    first[order[1:]] = (number[order][1:] != number[order][:-1]) | (keys[order][1:] != keys[order][:-1])
    return first


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PAIRS of the seeds that no passage covers, as many for a seed as stand in LEAST words; later occurrences with the place's complement."""
    for doc, number, pos, _, key, bare in _seed_lists(batches):
        doc, number, pos, key = doc[bare], number[bare], pos[bare], key[bare].view(np.uint64)
        out, place = [], pos + number * FAR
        for o in range(1, len(pos)):
            far = place[o:] - place[:-o]
            near = np.nonzero((far >= K) & (far <= LEAST))[0]
            if far.min() > LEAST:
                break
            both = (key[near] * np.uint64(0x9E3779B97F4A7C15) ^ key[near + o]) * np.uint64(0xD6E8FEB86659FD93)
            out.append((both ^ both >> np.uint64(32), near, far[near]))
        if out:
            keys, at, fars = (np.concatenate(x) for x in zip(*out))
            places = np.where(_first_of_document(number[at], keys, pos[at]), pos[at], ~pos[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(doc[at]), pa.array(places.astype(np.int32)), pa.array(fars.astype(np.int32))], ["key", "doc", "pos", "far"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of RUNS: the seeds of stretches that have shared seeds only and may hold an exact passage, the words around each that such a
    passage may reach; open: no passage covers the seed."""
    for doc, number, pos, step, key, bare in _seed_lists(batches):
        if not len(pos):
            continue
        first = np.concatenate(([0], np.nonzero((number[1:] != number[:-1]) | (pos[1:] != pos[:-1] + step[:-1]))[0] + 1))
        sizes = np.diff(first, append=len(pos))
        low, high = pos[first], pos[first + sizes - 1]
        held = np.repeat(high - low >= SPREAD, sizes)
        low, high = np.repeat(np.maximum(low - 2 * W, 0), sizes), np.repeat(high + K + 2 * W, sizes)
        start, stop = np.maximum(low, pos - LEAST + K), np.minimum(high, pos + LEAST)
        yield doc[held], key[held], start[held].astype(np.int32), stop[held].astype(np.int32), bare[held]


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hashes and places of all LEAST neighbouring words in the stretches asked for; later occurrences with the place's complement."""
    for batch in batches:
        out = []
        for doc, text, start, stop in zip(batch["doc"], batch["text"], batch["start"], batch["stop"]):
            words = words_of(text).astype(np.uint64)
            n = len(words) - LEAST + 1
            wanted = np.zeros(max(n, 0) + 1, np.int64)
            holds = (start < n) & (stop - LEAST >= start)
            np.add.at(wanted, start[holds], 1)
            np.add.at(wanted, np.minimum(stop[holds] - LEAST + 1, n), -1)
            places = np.nonzero(np.cumsum(wanted)[:-1] > 0)[0]
            if not len(places):
                continue
            hashes = np.zeros(len(places), np.uint64)
            for i in range(LEAST):
                hashes = (hashes ^ words[places + i]) * np.uint64(0x9E3779B97F4A7C15)
                hashes ^= hashes >> np.uint64(32)
            first = np.zeros(len(places), bool)
            first[np.unique(hashes, return_index=True)[1]] = True
            out.append(pd.DataFrame({"key": hashes.view(np.int64), "doc": doc, "pos": np.where(first, places, ~places)}))
        if out:
            yield pd.concat(out)


def matches(seeds: DataFrame, *more: str) -> DataFrame:
    """Rows of ``seeds`` that several documents share, with the first place of the key in its anchor."""
    shared = seeds.filter("pos >= 0").groupBy("key").agg(F.min("doc").alias("anchor"), F.min_by("pos", "doc").alias("anchor_pos"), F.max("doc").alias("last"))
    shared = shared.filter("anchor < last").select("key", "anchor", "anchor_pos")
    # The seeds are many: they are looked up in the shared keys of a slot and need no order.
    return seeds.join(shared.hint("shuffle_hash"), "key").select("anchor", "doc", "anchor_pos", F.greatest("pos", F.bitwise_not("pos")).alias("pos"), *more)


def chains(met: DataFrame, needed: int = MATCHES) -> DataFrame:
    """CHAINS of every document with its anchors, with its seeds where ``met`` has keys. A document has at most twice as many matches as seeds."""
    seeds = "key" in met.columns
    met = met.repartition("doc").sortWithinPartitions("doc")
    return met.mapInArrow(lambda b: _chains(b, needed, seeds), CHAINS_AND_SEEDS if seeds else CHAINS)


def aligned(chained: DataFrame, texts: DataFrame) -> DataFrame:
    """PASSAGES of the stored chains; ``texts``: doc, text."""
    # The stretches of an anchor that many documents ask for come in several rows, by where they begin.
    asked = chained.select(F.inline("links")).groupBy(F.col("anchor").alias("doc"), F.expr("low div 4096")).agg(F.collect_set(F.struct("low", "high")).alias("asked"))
    own = ["links", "sizes", "anchor_pos", "pos"]
    empty = lambda c: F.array().cast(chained.schema[c].dataType) if c == "links" else F.lit("").cast("binary")
    rows = chained.filter(F.size("links") > 0).select("doc", *own, F.array().cast("array<struct<low: int, high: int>>").alias("asked"))
    rows = rows.unionByName(asked.select("doc", *(empty(c).alias(c) for c in own), "asked"))
    cut = stored(texts.join(rows.hint("shuffle_hash"), "doc").mapInArrow(_cut, STRETCHES), "stretches", "zstd")
    of_anchors = cut.filter("doc IS NULL").select("anchor", "low", "high", F.col("words").alias("anchor_words"))
    return cut.filter("doc IS NOT NULL").join(of_anchors.hint("shuffle_hash"), ["anchor", "low", "high"]).mapInArrow(_aligned, PASSAGES).distinct()


def seeds_and_spans(chained: DataFrame, found: DataFrame) -> DataFrame:
    """The shared seeds of each document, by place, and its passages on either side, by start."""
    sides = [F.struct(*(F.col(c).alias(n) for c, n in zip(x, ("doc", "start", "stop")))) for x in (("doc_id", "start_word", "end_word"), ("other_id", "other_start", "other_end"))]
    spans = found.select(F.inline(F.array(*sides)))
    spans = spans.groupBy("doc", "start").agg(F.max("stop").alias("stop")).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    seeds = chained.filter(F.octet_length("places") > 4).select("doc", "places", "steps", "keys")
    return seeds.join(spans.hint("shuffle_hash"), "doc", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start: int, stop: int>>")))


def open_windows(chained: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
    """WINDOWS around the shared seeds that lie in a stretch of shared seeds and that no passage covers, of all documents that have such a seed."""
    seeds = seeds_and_spans(chained.filter(F.col("reach") >= SPREAD), found)
    seeds, ranges = stored(seeds, "seeds", "zstd"), _ranges(chained)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, _, _, bare in _runs(batches):
            if bare.any():
                yield _packed(np.unique(key[bare].view(np.uint64)), ranges)

    opened = seeds.sparkSession.sparkContext.broadcast(_filter(seeds.mapInArrow(packed, PACKED), ranges, 1))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _runs(batches):
            held = _passing(opened.value, columns[1])
            yield pa.RecordBatch.from_arrays([pa.array(c[held]) for c in columns], [c.split()[0] for c in RUNS.split(", ")])

    # The filter lets few keys pass that are not open; the join none.
    runs = stored(seeds.mapInArrow(passing, RUNS), "runs")
    asked = runs.join(runs.filter("open").select("key").distinct(), "key", "left_semi").groupBy("doc").agg(F.collect_set(F.struct("start", "stop")).alias("asked"))
    return texts.join(asked.select("doc", "asked.start", "asked.stop").hint("shuffle_hash"), "doc").mapInPandas(_windows, WINDOWS)


def open_pairs(chained: DataFrame, found: DataFrame) -> DataFrame:
    """Matches of the seeds that no passage covers with the first document that has another such seed at most LEAST words behind."""
    pairs = stored(seeds_and_spans(chained, found).mapInArrow(_pairs, PAIRS), "pairs")
    shared = pairs.filter("pos >= 0").groupBy("key").agg(
        F.min("doc").alias("anchor"), F.min_by(F.col("pos").cast("long") * (LEAST + 1) + F.col("far"), "doc").alias("first"), F.max("doc").alias("last"))
    both = pairs.join(shared.filter("anchor < last").hint("shuffle_hash"), "key").filter("doc <> anchor")
    first, far, pos = F.expr(f"int(first div {LEAST + 1})"), F.expr(f"int(first % {LEAST + 1})"), F.greatest("pos", F.bitwise_not("pos"))
    ends = F.array(F.struct(first.alias("anchor_pos"), pos.alias("pos")), F.struct((first + far).alias("anchor_pos"), (pos + F.col("far")).alias("pos")))
    return both.select("anchor", "doc", F.inline(ends)).distinct()


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PASSAGES: stretches of words of a document that repeat, within the allowed edits, a stretch of an anchor."""
    small_batches(docs.sparkSession)
    docs = id_and_text(docs, id_col, text_col).filter("doc_id IS NOT NULL")
    texts = docs.select(F.col("doc_id").alias("doc"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(shared_keys(docs))
    seeds = stored(docs.mapInArrow(lambda b: _seeds(b, shared.value), SEEDS), "seeds", "zstd")
    chained = stored(chains(matches(seeds, "key", "step")), "chains", "zstd")
    found = stored(aligned(chained, texts), "passages")
    windows = stored(open_windows(chained, found, texts), "windows")
    found = found.unionByName(stored(aligned(stored(chains(matches(windows), 1), "chains"), texts), "passages"))
    return found.unionByName(aligned(stored(chains(open_pairs(chained, found)), "chains"), texts)).distinct()
