"""Spelling variants against the edit distance of all pairs of words."""

import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from sigloft.llm import spelling_variants as sv
from sigloft.session import stored


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[at + 1 :] == b[at + 1 :]
    return a[at + 1 :] == b[at:] if len(a) > len(b) else a[at:] == b[at + 1 :]


def by_hand(counts: dict[str, int]) -> dict[str, tuple]:
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def result(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_groups_of_made_up_words(spark):
    pick = random.Random(3)
    counts = {}
    for _ in range(250):
        word = "".join(pick.choice("abé") for _ in range(pick.randint(6, 11)))
        counts[word] = 5 ** pick.randint(1, 5)
        for _ in range(3):
            i = pick.randint(0, len(word) - 1)
            other = pick.choice([word[:i] + word[i + 1 :], word[:i] + "z" + word[i:], word[:i] + "y" + word[i + 1 :]])
            if len(other) >= 6:
                counts.setdefault(other, pick.randint(5, 60))
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    expected = by_hand(counts)
    assert result(sv.variant_groups(words)) == expected
    assert max(len({w, f[0], f[1]}) for w, f in expected.items() if f[0]) == 3  # chains of several forms
    pairs = sv.near_pairs(words).collect()
    assert {frozenset((r.a, r.b)) for r in pairs} == {frozenset((a, b)) for a in counts for b in counts if one_edit(a, b)}
    assert len(pairs) == len({frozenset((r.a, r.b)) for r in pairs})


def test_words_with_one_half_in_common(spark):
    """Very many words with one ending: the key that splits them keeps candidates to a small multiple of the words."""
    pick = random.Random(4)
    words = {"".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) + "ations" for _ in range(1500)}
    words |= {w[:2] + w[3:] for w in list(words)[:40]}
    counts = dict.fromkeys(words, 7)
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert result(sv.variant_groups(table)) == by_hand(counts)
    size = F.length("word")
    keys = table.select(F.explode(F.array(*sv._keys(size, (0,)))).alias("key")).groupBy("key").count()
    assert keys.agg(F.max("count")).first()[0] < len(words) / 10


def test_damaged_words_of_documents(spark):
    texts = {i: "Tortoise tortoise! tOrtoise-shell ÉTÉÉTÉÉ x naïvety×s \n" * 5 for i in range(900)}
    rows = [(i, t, "en") for i, t in texts.items()] + [(900, None, "de"), (901, "", "de"), (902, "Garden" * 30000, "en"), (0, texts[0], "en"), (None, "Lonely " * 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    counts = Counter()
    for doc, text, _ in rows:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "\x80" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
            run = ""
    expected = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    found = sv.counted(sv.damaged_words(docs, 199, 6))
    assert {r.word: r.n for r in found.collect()} == expected and len(expected) > 6
    assert result(sv.variant_groups(found)) == by_hand(expected)
    empty = sv.variant_groups(sv.counted(sv.damaged_words(docs.limit(0))))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.count() == 0


def test_ties_go_to_the_smallest_word(spark):
    counts = {"gardem": 5, "garden": 30, "garder": 30, "gardex": 31}
    out = result(sv.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert out["gardem"] == ("gardex", "gardex", 5, 3, 31) and out["garden"][0] is None
    counts["gardex"] = 30
    assert result(sv.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long")))["gardem"][0] == "garden"


def test_no_table_passes_the_driver(spark, monkeypatch):
    """Spark sizes stored tables by their files and exploded rows like their table, so none may be left to a broadcast."""
    made = []
    monkeypatch.setattr(sv, "stored", lambda df, *a: made.append(df) or stored(df, *a))
    counts = {"garden": 900, "gardem": 150, "gardemx": 20, "gardemxy": 5, "tortoise": 40, "tortoisse": 8, "lonely": 7}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    groups = sv.variant_groups(words)
    assert result(groups) == by_hand(counts) and by_hand(counts)["gardemx"][:2] == ("gardem", "garden")
    pairs = sv.near_pairs(stored(words, "words"))
    assert pairs.count() == sum(one_edit(a, b) for a in counts for b in counts) / 2
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (*made, pairs, groups)]
    assert sum("SortMergeJoin" in p for p in plans) >= 5 and not any("Broadcast" in p for p in plans)
