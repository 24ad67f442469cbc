"""The segment tree's merges against plain merging, and its tokens against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sigloft.llm import bpe_codec

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
ODD = [
    "", " ", "  a", "<|endoftext|>", "a<|endoftext|><|endoftext|> b<|endof", " \n\n  x\t y  ", "it's we'll they've I'm I'd 'sx 'll", "日本語 123 ½ ٣   x",
    "a" * 3000, "ab" * 4000, " " * 300 + "z", "😀😀é é", "\u0000\u0001", "!!!???...", "門 Ａ", "x\r\ny",
]


def test_trees_side_by_side():
    pick = random.Random(3)
    for size in (2, 3, 5, 9, 33):
        merges, known = {}, [0, 1, 2]
        for rank in range(14):
            merges.setdefault((pick.choice(known), pick.choice(known)), (rank, 3 + rank))
            known.append(3 + rank)
        pieces = [[pick.randint(0, 2) for _ in range(pick.randint(2, size))] for _ in range(300)] + [[0] * size]
        filled = np.array([p + [0] * (size - len(p)) for p in pieces], np.int32).T.copy()
        left, count = bpe_codec.merged_side_by_side(filled, np.array(list(map(len, pieces))), bpe_codec.PairTable(merges, 20))
        assert [x.tolist() for x in np.split(left, np.cumsum(count)[:-1])] == [plain_merging(p, merges) for p in pieces]


def plain_merging(parts, merges):
    parts = list(parts)
    while True:
        ranked = [(merges[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
        if not ranked:
            return parts
        i = min(ranked)[1]
        parts[i : i + 2] = [merges[parts[i], parts[i + 1]][1]]


def test_tree_merges_like_the_plain_loop():
    pick = random.Random(1)
    for _ in range(60):
        merges, known = {}, [0, 1, 2]
        for rank in range(12):
            merges.setdefault((pick.choice(known), pick.choice(known)), (rank, 3 + rank))
            known.append(3 + rank)
        for _ in range(20):
            parts = [pick.randint(0, 2) for _ in range(pick.randint(1, 40))]
            assert bpe_codec.PairTree(list(parts), merges).merge_all() == plain_merging(parts, merges)


@pytest.fixture(scope="module")
def codec():
    return bpe_codec.ByteCodec(PATH)


def test_tokens_are_those_of_the_library(codec):
    library = Tokenizer.from_file(PATH)
    pick = random.Random(2)
    alphabet = "ab 's\n\t1!é日  'lvetheing<|>"
    texts = ODD + ["".join(pick.choice(alphabet) for _ in range(pick.randint(1, 80))) for _ in range(500)]
    for text in texts:
        ids = codec.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) == text
    broken = [codec.single[0xE9], codec.single[0x41]]
    assert codec.decode(broken) == library.decode(broken, skip_special_tokens=False)


def test_a_piece_of_a_million_letters(codec):
    text = "ab" * 500_000
    assert codec.decode(codec.encode(text)) == text


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe_codec.ByteCodec(str(public_tokenizers.path("word_bpe_49k.json")))


def test_token_tables(spark):
    rows = [(1, "x y", "en"), (1, "x y", "en"), (2, None, None), (None, "", "de"), (3, "word " * 60000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    library = Tokenizer.from_file(PATH)

    def expected(doc, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    out = bpe_codec.round_trips(docs, PATH)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted((expected(d, t) for d, t, _ in rows), key=str)
    both = bpe_codec.decoded(bpe_codec.encoded(docs, PATH), PATH)
    assert sorted((r.text for r in both.collect())) == sorted(t or "" for _, t, _ in rows)
    assert bpe_codec.round_trips(docs.limit(0), PATH).count() == 0
