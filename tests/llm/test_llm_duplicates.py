"""Fingerprints, near-duplicates and repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sigloft.llm import components, doc_fingerprints, fuzzy_passages, simhash_dedup


def brute_simhash(text: str) -> int:
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hashes) * 2 > len(hashes))


def prose(pick: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{pick.randrange(vocabulary)}" for _ in range(n)]


def roots(n: int, links: list[tuple[int, int]]) -> list[int]:
    out = list(range(n))
    for _ in range(n):
        for a, b in links:
            out[a] = out[b] = min(out[a], out[b])
    return out


def test_simhash_bits():
    for text in ["", "a", "A b", "A  B\tc\n d", "\x85 x y z", "É é É é x", "to " * 700]:
        assert simhash_dedup.simhash64(text) == brute_simhash(text)


def test_components(spark):
    pick = random.Random(2)
    links = [(pick.randrange(60), pick.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(60, 79)]
    expected = roots(80, links)
    frame = spark.createDataFrame(links + [(None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(frame, "a", "b").collect()}
    assert got == {i: expected[i] for a, b in links if a != b for i in (a, b)}
    assert components.components(frame.limit(0), "a", "b").count() == 0


def test_near_duplicates(spark):
    pick = random.Random(3)
    texts: list[str | None] = []
    for _ in range(12):
        words = prose(pick, 300)
        texts += [" ".join(words), " ".join(words).upper()]
        for _ in range(3):
            words = list(words)
            words[pick.randrange(300)] = "changed"
            texts.append(" ".join(words))
    texts += ["", None, " \n", "one two"]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    prints = [simhash_dedup.simhash64(t or "") for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    expected = roots(len(texts), links)
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in simhash_dedup.near_duplicates(docs).collect()}
    assert [got[i].component_id for i in range(len(texts))] == expected
    assert [got[i].fp % 2**64 for i in range(len(texts))] == prints
    kept = simhash_dedup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(expected))
    assert simhash_dedup.near_duplicates(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (7, "a b c"), (7, "a b c")], "doc_id long, text string")
    assert sorted(r.component_id for r in simhash_dedup.near_duplicates(nulls).collect()) == [7, 7, 7, 7]
    assert simhash_dedup.keep_first(nulls).count() == 4


def test_links_of_balls(spark):
    pick = random.Random(4)
    base = [pick.getrandbits(64) for _ in range(40)]
    prints = list({x ^ sum(1 << b for b in pick.sample(range(64), pick.randint(0, 5))) for x in base for _ in range(6)})
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    got = {frozenset((r.fp % 2**64, r.other % 2**64)) for r in simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert got == {frozenset((a, b)) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3}


def test_block_tables(spark):
    pick = random.Random(5)
    base = [pick.getrandbits(128) for _ in range(40)]
    prints = list({x ^ sum(1 << b for b in pick.sample(range(128), pick.randint(0, 5))) for x in base for _ in range(6)})
    frame = spark.createDataFrame([(doc_fingerprints.hexadecimal(x),) for x in prints * 2], "fingerprint string")
    got = {(int(r.fingerprint, 16), int(r.other, 16)): r.distance for r in doc_fingerprints.near_pairs(frame).collect()}
    assert got == {(a, b): (a ^ b).bit_count() for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3}


def test_neighbours_of_many_rows_without_an_id(spark):
    pick = random.Random(16)
    rows = [(None if i % 3 else i // 30, " ".join(prose(pick, 12))) for i in range(600)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        done = doc_fingerprints.compared_with_edits(spark.createDataFrame(rows, "doc_id long, text string"))
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.edited_sha256, r.near_next) for r in done.collect())
        ranges = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange("doc_id", F.xxhash64("text"))
        nulls = ranges.filter("doc_id IS NULL").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    signed = lambda t: int.from_bytes(xxhash.xxh64_digest(t.encode(), 42), "big", signed=True)
    rows.sort(key=lambda r: (-1 if r[0] is None else r[0], signed(r[1])))
    expected = []
    for (i, own), (_, following) in zip(rows, rows[1:] + rows[:1]):
        near = doc_fingerprints.likeness(doc_fingerprints.fingerprint(own), doc_fingerprints.fingerprint(following))
        expected.append((-1 if i is None else i, hashlib.sha256(doc_fingerprints.edited(own, following).encode()).hexdigest(), near))
    assert got == sorted(expected)
    assert len(nulls) > 1


def test_edited_texts(spark):
    pick = random.Random(6)
    texts = ["", None, "é"] + [" ".join(prose(pick, n)) for n in (1, 2, 3, 40, 200, 900, 5)] + ["same"] * 3
    rows = [(2 * i, t, "x") for i, t in enumerate(texts)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r for r in doc_fingerprints.compared_with_edits(spark.createDataFrame(rows, "doc_id long, text string, part string")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for i, text in enumerate(texts):
        own, following = text or "", texts[(i + 1) % len(texts)] or ""
        k = len(own) // 4
        new = own[: len(own) - k] + following[:k]
        r = got[2 * i]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == doc_fingerprints.hexadecimal(doc_fingerprints.fingerprint(own))
        assert r.near_next == doc_fingerprints.likeness(doc_fingerprints.fingerprint(own), doc_fingerprints.fingerprint(following))
    assert got[16].near_edited > 0.5 > got[16].near_next
    assert doc_fingerprints.compared_with_edits(spark.createDataFrame(rows[:1], "doc_id long, text string, part string")).count() == 1
    assert doc_fingerprints.compared_with_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chains_are_the_best():
    pick = np.random.default_rng(1)
    for _ in range(200):
        n = int(pick.integers(2, 12))
        pos = np.sort(pick.integers(0, 40, n))
        anchor = pick.integers(0, 40, n)
        best = [0.0] * n
        for j in range(n):
            ends = [best[i] - fuzzy_passages.GAP * (anchor[j] - anchor[i] + pos[j] - pos[i]) for i in range(j) if anchor[i] < anchor[j] and pos[i] < pos[j]]
            best[j] = fuzzy_passages.WEIGHT + max([0.0, *ends])
        chains = fuzzy_passages.chains_of(anchor, pos)
        assert sorted(x for c in chains for x in c) == list(range(n))
        first = chains[0]
        gaps = sum(anchor[y] - anchor[x] + pos[y] - pos[x] for x, y in zip(first, first[1:]))
        assert abs(fuzzy_passages.WEIGHT * len(first) - fuzzy_passages.GAP * gaps - max(best)) < 1e-9
        assert all(anchor[x] < anchor[y] and pos[x] < pos[y] for x, y in zip(first, first[1:]))


def test_passages(spark):
    pick = random.Random(8)
    shared, line = prose(pick, 55, 10**6), prose(pick, 12, 10**6)
    fuzzy = list(prose(pick, 80, 10**6))
    changed = [w for i, w in enumerate(fuzzy) if i % 17 != 5]
    whole = prose(pick, 120, 10**6)
    own = lambda n: prose(pick, n, 10**6)
    texts = {
        1: own(90) + shared + own(30), 2: own(200) + [w.upper() for w in shared] + own(3), 3: shared, 4: own(20) + fuzzy + own(50), 5: own(70) + changed + own(8),
        6: whole, 7: whole, 8: line + own(100), 9: line + own(60), 10: own(150), 11: own(200)[:49], 12: [],
    }
    rows = [(i, " ".join(t), "x") for i, t in texts.items()] + [(13, None, "x"), (None, " ".join(whole), "x"), (7, " ".join(whole), "x")]
    got = fuzzy_passages.passages(spark.createDataFrame(rows, "doc_id long, text string, anchor string")).collect()
    pairs = {(r.doc_id, r.other_id): r for r in got}
    assert set(pairs) == {(2, 1), (3, 1), (5, 4), (7, 6)}
    r = pairs[2, 1]
    assert (r.start_word, r.end_word, r.other_start, r.other_end, r.edits) == (200, 255, 90, 145, 0)
    r = pairs[5, 4]
    assert (r.start_word, r.other_start, r.edits) == (70, 20, len(fuzzy) - len(changed)) and r.end_word == 70 + len(changed)
    assert (pairs[7, 6].start_word, pairs[7, 6].end_word) == (0, 120)
    assert fuzzy_passages.passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_longest_stretch():
    pick = np.random.default_rng(2)
    for _ in range(300):
        n = int(pick.integers(1, 9))
        length = pick.integers(1, 30, 2 * n - 1)
        gain = fuzzy_passages.EDITS * length
        gain[1::2] -= pick.integers(0, 20, n - 1)
        first, last = fuzzy_passages._longest(gain, length)
        sizes = {(i, j): length[2 * i : 2 * j + 1].sum() for i in range(n) for j in range(i, n) if gain[2 * i : 2 * j + 1].sum() >= -1e-9}
        assert sizes[first, last] == max(sizes.values())


def test_several_passages_of_a_pair(spark):
    pick = random.Random(9)
    own = lambda n: prose(pick, n, 10**6)
    rows, wanted = [], {}
    for i in range(0, 60, 2):
        head, tail, around = own(100), own(pick.choice((60, 100))), pick.choice((0, 70))
        between = (own(pick.choice((60, 100, 200))), own(pick.choice((0, 60, 100))))
        texts = [own(around) + head + x + tail + own(around) for x in between]
        rows += [(i + k, " ".join(t)) for k, t in enumerate(texts)]
        starts = [(around, around + 100), *((around + 100 + len(x), around + 100 + len(x) + len(tail)) for x in between)]
        wanted[i] = {(starts[0], starts[0]), (starts[2], starts[1])}
    got = fuzzy_passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for i, spans in wanted.items():
        of = [r for r in got if r.doc_id == i + 1]
        covered = [set().union(*(range(r[a], r[b]) for r in of)) for a, b in (("start_word", "end_word"), ("other_start", "other_end"))]
        assert all(set(range(*own)) <= covered[0] and set(range(*other)) <= covered[1] for own, other in spans), (i, of)
        assert all(r.other_id == i and r.edits <= fuzzy_passages.EDITS * max(r.end_word - r.start_word, r.other_end - r.other_start) for r in of)


def test_passage_twice_in_a_document(spark):
    pick = random.Random(10)
    own = lambda n: prose(pick, n, 10**6)
    shared, parts = own(70), own(80)
    texts = {
        1: own(40) + shared + own(30), 2: own(60) + shared + own(90) + shared + own(10), 3: own(30) + shared + own(50) + shared + own(50) + shared,
        4: own(20) + parts + own(30), 5: own(10) + parts[40:] + own(70) + parts[:40] + own(30) + parts + own(5), 6: ["to"] * 300, 7: own(30) + ["to"] * 200,
    }
    got = fuzzy_passages.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")).collect()
    spans = {i: {(r.start_word, r.end_word, r.other_id, r.other_start, r.other_end) for r in got if r.doc_id == i} for i in texts}
    assert spans[2] == {(60, 130, 1, 40, 110), (220, 290, 1, 40, 110)}
    assert spans[3] >= {(a, a + 70, 1, 40, 110) for a in (30, 150, 270)}
    assert spans[5] == {(190, 270, 4, 20, 100)} and not spans[1] and not spans[4]
    assert (30, 230, 6) in {x[:3] for x in spans[7]}


def test_recall(spark):
    pick = random.Random(11)
    own = lambda n: prose(pick, n, 10**9)
    rows, of = [], {}
    for n in (50, 65, 80, 100):
        for percent in (0, 5, 10, 15, 20):
            for _ in range(100):
                passage = own(n)
                copy = list(passage)
                for at in sorted(pick.sample(range(1, n - 1), n * percent // 100), reverse=True):
                    gone, new = pick.choice(((1, 1), (1, 0), (0, 1)))
                    copy[at : at + gone] = own(new)
                if len(copy) < fuzzy_passages.LEAST:
                    continue
                i = len(rows)
                # Brute force: the planted stretches are a passage by the edit distance of the whole.
                if fuzzy_passages._distance(np.array([hash(w) for w in passage]), np.array([hash(w) for w in copy])) <= fuzzy_passages.EDITS * max(n, len(copy)):
                    rows += [(i, " ".join(own(70) + passage + own(40))), (i + 1, " ".join(own(30) + copy + own(80)))]
                    of[i + 1] = (n, percent)
    found = {r.doc_id for r in fuzzy_passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.other_id == r.doc_id - 1}
    share = {x: np.mean([d in found for d in of if of[d] == x]) for x in set(of.values())}
    assert all(share[x] == 1 if x[1] == 0 else share[x] >= 0.95 for x in share)


def test_passages_of_frequent_lines(spark):
    pick = random.Random(12)
    own = lambda n: prose(pick, n, 10**6)
    lines, halves, twice = [own(12) for _ in range(5)], [own(30) for _ in range(2)], [own(12) for _ in range(6)]
    texts = {i: own(40) + line + own(50) for i, line in enumerate(lines + halves + twice)}
    made = [sum(x, []) for x in (lines, halves, twice)]
    texts |= {100: own(30) + made[0] + own(60), 200: own(90) + made[0] + own(7), 110: made[1] + own(70), 210: own(20) + made[1]}
    texts |= {120: own(10) + made[2] + own(40), 220: own(25) + made[2] + own(80) + made[2], 300: made[0], 310: own(9) + lines[3] + own(50)}
    got = fuzzy_passages.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")).collect()
    spans = {(r.doc_id, r.start_word, r.end_word, r.other_id, r.other_start, r.other_end) for r in got if r.edits == 0}
    assert spans >= {(200, 90, 150, 100, 30, 90), (300, 0, 60, 100, 30, 90), (210, 20, 80, 110, 0, 60), (220, 25, 97, 120, 10, 82), (220, 177, 249, 120, 10, 82)}
    assert {r.doc_id for r in got} == {200, 300, 210, 220}


def test_passage_of_overlapping_frequent_stretches(spark):
    pick = random.Random(13)
    own = lambda n: prose(pick, n, 10**6)
    passage = own(90)
    texts = {i: own(40) + passage[a : a + 30] + own(50) for i, a in enumerate(range(0, 61, 15))}
    texts |= {100: own(30) + passage + own(60), 200: own(70) + passage + own(20)}
    got = fuzzy_passages.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.other_id, r.other_start, r.other_end) for r in got} == {(200, 70, 160, 100, 30, 120)}


def test_filter_of_shared_seeds(spark):
    pick = random.Random(21)
    common = list(prose(pick, 60))
    texts = [common + list(prose(pick, 80)) if i % 3 == 0 else list(prose(pick, 90)) for i in range(60)] + [["short"]]
    seeds = [set(fuzzy_passages.seeds_of(fuzzy_passages.words_of(" ".join(t)))[0].tolist()) if len(t) >= fuzzy_passages.LEAST else set() for t in texts]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    held = np.unpackbits(fuzzy_passages.shared_keys(df))
    every, shared = set().union(*seeds), {k for i, a in enumerate(seeds) for b in seeds[:i] for k in a & b}
    bit = lambda k: int(fuzzy_passages._bits(np.array([k]))[0])
    assert shared and all(held[bit(k)] for k in shared) and sum(held[bit(k)] for k in every - shared) <= 2


def test_edited_passages_of_frequent_lines_are_found(spark):
    rng = random.Random(5)
    some = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    lines = [some(12) for _ in range(6)]
    # Every line, and every line with its neighbour, is first in a document of its own, which has nothing else of the passage.
    texts = {i: some(60) + lines[i] + lines[i + 1] + some(60) for i in range(5)}
    whole = sum(lines, [])
    edited = list(whole)
    edited[30], edited[42] = some(2)
    texts |= {100: some(60) + whole + some(60), 101: some(40) + edited + some(30)}
    got = fuzzy_passages.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")).collect()
    found = [r for r in got if (r.doc_id, r.other_id) == (101, 100)]
    assert [(r.start_word, r.end_word, r.other_start, r.other_end, r.edits) for r in found] == [(40, 112, 60, 132, 2)]
    assert all(r.doc_id == 101 for r in got)


def test_chains_and_seeds_of_many_at_once():
    rng = np.random.default_rng(3)
    for k in range(100):
        n = int(rng.integers(1, 60))
        pair = np.sort(rng.integers(0, 6, n))
        pos, anchor = (np.cumsum(rng.integers(1, 90, n)) if k % 2 else rng.integers(0, 300, n) for _ in range(2))
        order = np.lexsort((anchor, pos, pair))
        pair, anchor, pos = pair[order], anchor[order], pos[order]
        labels = fuzzy_passages._labels(pair, anchor, pos)
        got = {tuple(np.nonzero(labels == x)[0].tolist()) for x in labels.tolist()}
        own = [np.nonzero(pair == p)[0] for p in set(pair.tolist())]
        assert got == {tuple(i[c].tolist()) for i in own for c in fuzzy_passages.chains_of(anchor[i], pos[i])}
    texts = [f"w{i % 7} x{i}" * 3 + " to" * i for i in range(45, 60)] + ["to " * 80, "one two"]
    words, sizes, which = fuzzy_passages._words_of_all(texts)
    keys, text, places, _ = fuzzy_passages.seed_rows(words, sizes)
    for k, i in enumerate(which.tolist()):
        alone = fuzzy_passages.seeds_of(fuzzy_passages.words_of(texts[i]))
        assert sorted(zip(keys[text == k].tolist(), places[text == k].tolist())) == sorted(zip(*(x.tolist() for x in alone)))
    assert len(texts) - 1 not in which


def test_texts_travel_once_a_search(spark, monkeypatch):
    pick = random.Random(31)
    own = lambda n: prose(pick, n, 10**6)
    heads = [own(60) for _ in range(20)]
    rows = [(1, " ".join(sum(heads, []))), *((i + 2, " ".join(own(20) + h + own(20))) for i, h in enumerate(heads))]
    asked, cut = [], fuzzy_passages.stored

    def seen(df, purpose, *more):
        out = cut(df, purpose, *more)
        if purpose == "stretches":
            asked.append(out.filter("doc IS NULL").count())
        if purpose == "chains":
            # One row for each document, with all of its chains, goes to the text.
            assert out.count() == out.select("doc").distinct().count()
        return out

    monkeypatch.setattr(fuzzy_passages, "stored", seen)
    got = fuzzy_passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.other_id, r.other_start, r.other_end) for r in got} == {
        (i + 2, 20, 80, 1, 60 * i, 60 * i + 60) for i in range(20)}
    assert asked[0] == 20
