"""Personal data, and the terms that give it away.

Patterns find e-mail and IP addresses, card and phone numbers. Terms beside them can reveal them as well: for an entity c and a term t,
the corpus gives in how many documents t stands together with c against in how many it stands anywhere. The pointwise mutual information
PMI(c; t) = log2(p(c, t) / (p(c) p(t))) is the information about c that t gives away; a term that gives away at least DISCLOSURE of all
there is, -log2 p(c), is a risk, and each of its occurrences is marked in every document that has c. Probabilities are over the different ids of the whole corpus, and a pair must be
seen in SUPPORT of them. A risky term with a more general form known to the generaliser is replaced by that form, the
others are removed (`sanitised_texts`).

Only entities of SUPPORT documents can have such terms, so the words of documents without one are not paired, nor are terms of fewer
documents or of so many that no entity beside them can be given away by them. Entities that stand in the same rows are one class, and so are
terms that do; counts are taken over pairs of classes, so a list of many entities, copied with its words, is one pair and not the product of
both. Positions come back only for terms of risky pairs. Spans of risky terms are added to those of the patterns, with the kind ``term``; parts of a pattern's span are no terms. Null texts are
empty. Rows with a null id are searched like others and reported under a null id; they count as one document, as do rows
of one id. Repeated rows give one row each. Empty tables give none. Only the two named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloft.llm.common import WORD, id_and_text, portions
from sigloft.session import stored

KINDS = ("email", "ip", "card", "phone")
SUPPORT, DISCLOSURE, SHORTEST = 3, 0.8, 3
#: Bits of the filter of candidate terms that every task gets, and how many of them a term sets.
FILTER_BITS, FILTER_HASHES = 1 << 23, 4
#: Parts of the filter that tasks unite.
FILTER_BLOCKS = 128
#: Words whose number a task remembers.
REMEMBERED = 400_000

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can start only where a run of digits does, which keeps long runs of digits cheap.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from the sign outwards, so that long runs of letters cost no more than their length."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[max(free, 0) : at]
        start = at - (len(before) - len(before.rstrip(_LOCAL)))
        m = _DOMAIN.match(text, at + 1)
        if m and start < at:
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans by kind, then by start; matches that fail their check are dropped and not tried anew."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return found


def _number(word: str) -> int:
    """A word's 64-bit hash as a signed number."""
    h = xxhash.xxh64_intdigest(word.encode())
    return h - (1 << 64) if h >> 63 else h


def entities(text: str, spans: list[tuple[str, int, int]]) -> list[int]:
    """The numbers of the different entities of a text."""
    return [_number(x) for x in dict.fromkeys(f"{kind}:{text[a:b].lower()}" for kind, a, b in spans)]


def terms_of(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int], list[int]]:
    """The numbers, starts and ends of all lower-cased words of a text outside all spans."""
    taken = sorted((a, b) for _, a, b in spans)
    numbers: dict[str, int] = {}
    terms, starts, ends = [], [], []
    at = reach = 0
    for m in WORD.finditer(text):
        s, e = m.span()
        while at < len(taken) and taken[at][0] < e:
            reach = max(reach, taken[at][1])
            at += 1
        if e - s >= SHORTEST and reach <= s:
            word = m.group().lower()
            if word not in numbers:
                numbers[word] = _number(word)
            terms.append(numbers[word])
            starts.append(s)
            ends.append(e)
    return terms, starts, ends


def _bits(terms: np.ndarray) -> np.ndarray:
    """The filter's bits of each term."""
    high, low = terms.view(np.uint64) >> np.uint64(32), terms.view(np.uint64) & np.uint64(0xFFFFFFFF)
    return np.stack([(low + np.uint64(i) * (high | np.uint64(1))) % np.uint64(FILTER_BITS) for i in range(FILTER_HASHES)]).astype(np.int64)


def term_filter(terms: DataFrame) -> np.ndarray:
    """A filter of fixed size that every term of the column ``term`` passes, as packed bits; made in the tasks, block by block."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            held[_bits(batch["term"].to_numpy(np.int64)).ravel()] = True
        blocks = np.packbits(held).reshape(FILTER_BLOCKS, -1)
        marked = np.nonzero(blocks.any(axis=1))[0]
        yield pd.DataFrame({"block": marked.astype(np.int32), "bits": [blocks[b].tobytes() for b in marked]})

    def unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, bits in zip(batch["block"].tolist(), batch["bits"]):
                held[block] = held.get(block, np.uint8(0)) | np.frombuffer(bits, np.uint8)
        yield pd.DataFrame({"block": np.array(list(held), np.int32), "bits": [x.tobytes() for x in held.values()]})

    # Each block of the filter comes to the driver once, whatever the number of terms or tasks.
    marks = terms.repartition(16, "term").mapInPandas(mark, "block int, bits binary")
    whole = np.zeros((FILTER_BLOCKS, FILTER_BITS // 8 // FILTER_BLOCKS), np.uint8)
    for r in marks.repartition(16, "block").mapInPandas(unite, "block int, bits binary").collect():
        whole[r.block] = np.frombuffer(r.bits, np.uint8)
    return whole.ravel()


def document_counts(docs: DataFrame, passing: np.ndarray) -> DataFrame:
    """``term, df``: in how many documents each term stands, exact for all terms that pass the filter.

    Rows whose id may come again, by a filter of such ids, list their terms with the id; the terms of others are summed up in the tasks.
    """
    again = term_filter(docs.groupBy("doc_id").count().filter("count > 1").select(F.xxhash64("doc_id").alias("term")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, repeated = np.unpackbits(passing).astype(bool), np.unpackbits(again).astype(bool)
        # Each word's number, 0 for words that are too short or don't pass.
        numbers: dict[str, int] = {}
        for batch in batches:
            totals: Counter[int] = Counter()
            # Two hashes name an id, whatever its type.
            ids = batch[["one", "two"]].to_numpy(np.int64)
            listed, at = repeated[_bits(ids[:, 0].copy())].all(axis=0), 0
            for part in portions(batch["text"], 1 << 20):
                words = [set(map(str.lower, set(WORD.findall(text)))) for text in part]
                every = set().union(*words)
                if len(numbers) + len(every) > REMEMBERED:
                    numbers.clear()
                new = [w for w in every if w not in numbers]
                found = np.fromiter((_number(w) if len(w) >= SHORTEST else 0 for w in new), np.int64, len(new))
                numbers.update(zip(new, np.where(held[_bits(found)].all(axis=0), found, 0).tolist()))
                for here in words:
                    terms = filter(None, map(numbers.get, here))
                    if listed[at]:
                        own = np.fromiter(terms, np.int64)
                        yield pd.DataFrame({"term": own, "one": ids[at, 0], "two": ids[at, 1], "named": True, "df": 1})
                    else:
                        totals.update(terms)
                    at += 1
            own = np.fromiter(totals, np.int64, len(totals))
            yield pd.DataFrame({"term": own, "one": 0, "two": 0, "named": False, "df": np.fromiter(totals.values(), np.int64, len(totals))})

    rows = docs.select("text", F.xxhash64("doc_id").alias("one"), F.xxhash64("doc_id", F.lit(1)).alias("two"))
    rows = rows.mapInPandas(count, "term long, one long, two long, named boolean, df long")
    rows = rows.groupBy("term", "named", "one", "two").agg(F.sum("df").alias("df"))
    return rows.groupBy("term").agg(F.sum(F.when(F.col("named"), 1).otherwise(F.col("df"))).alias("df"))


def risky_terms(docs: DataFrame, owned: DataFrame, words: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """``row, term`` of the terms that disclose too much of an entity of their row; ``owned``: ``row, entity``, ``words``: ``row, term``, each once."""
    n = float(docs.select("doc_id").distinct().count())
    ids = F.struct(F.col("row.doc_id"))
    common = words.groupBy("term").agg(F.count_distinct(ids).alias("n_here")).filter(F.col("n_here") >= support).select("term")
    common = stored(common, "terms")
    counts = document_counts(docs, term_filter(common)).join(common, "term")
    # A term of a pair with n_both <= n_entity documents passes only if its own number is at most n (n_entity / n) ** disclosure.
    entities = owned.groupBy("entity").agg(F.count_distinct(ids).alias("n_entity"))
    most = lambda c: F.lit(n * (1 + 1e-9)) * F.pow(c / n, F.lit(disclosure))
    owned = owned.join(entities, "entity")
    limits = owned.groupBy("row").agg(most(F.max("n_entity")).alias("most"))
    kept = words.join(counts, "term").join(limits, "row").filter("df <= most").select("row", "term", "df")
    kept = stored(kept, "row-terms")
    # Two hashes over the different rows of an entity or term name its class.
    mark = lambda n: F.bit_xor(F.xxhash64("row", F.lit(n)))
    of_term = stored(kept.groupBy("term", "df").agg(mark(1).alias("ta"), mark(2).alias("tb")), "term-classes")
    of_entity = owned.groupBy("entity", "n_entity").agg(mark(1).alias("ea"), mark(2).alias("eb"))
    left = owned.join(of_entity, ["entity", "n_entity"]).select("row", "ea", "eb", "n_entity").distinct()
    right = kept.join(of_term, ["term", "df"]).select("row", "ta", "tb", "df").distinct()
    pairs = stored(left.join(right, "row").filter(F.col("df") <= most(F.col("n_entity"))), "pairs")
    of = ("ea", "eb", "n_entity", "ta", "tb", "df")
    both = pairs.groupBy(*of).agg(F.count_distinct(ids).alias("n_both")).filter(F.col("n_both") >= support)
    pmi = F.log2(F.col("n_both") * F.lit(n) / (F.col("n_entity") * F.col("df")))
    risky = both.filter((pmi > 0) & (pmi >= disclosure * F.log2(F.lit(n) / F.col("n_entity"))))
    told = pairs.join(risky.select(*of), list(of), "left_semi").select("row", "ta", "tb", "df").distinct()
    return kept.join(of_term, ["term", "df"]).join(told, ["row", "ta", "tb", "df"]).select("row", "term")


def _searched(docs: DataFrame, support: int, disclosure: float) -> DataFrame:
    """``doc_id, content, base, terms`` for every row; ``docs``: doc_id, text. The id and the text's hash tie a row's spans together, as ids may repeat."""
    kind = "array<struct<kind:string,start:int,end:int>>"

    @F.pandas_udf(f"base {kind}, entities array<bigint>, words array<bigint>, starts array<int>, ends array<int>")
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            base = [base_spans(t) for t in batch]
            # As arrays: lists of numbers would take many times the memory.
            words = [tuple(map(np.array, terms_of(t, s) if s else ([], [], []), (np.int64, np.int32, np.int32))) for t, s in zip(batch, base)]
            yield pd.DataFrame({
                "base": [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in base],
                "entities": [entities(t, s) for t, s in zip(batch, base)],
                **{c: [w[i] for w in words] for i, c in enumerate(("words", "starts", "ends"))},
            })

    found = stored(docs.select("doc_id", F.xxhash64("text").alias("content"), search("text").alias("s")).select("doc_id", "content", "s.*"), "spans")
    # Structs are equal where both ids are null.
    row = F.struct("doc_id", "content").alias("row")
    owned = found.select(row, F.explode("entities").alias("entity")).distinct()
    frequent = owned.groupBy("entity").agg(F.count_distinct(F.struct(F.col("row.doc_id"))).alias("n")).filter(F.col("n") >= support).select("entity")
    owned = stored(owned.join(frequent, "entity").select("row", "entity"), "owned")
    places = found.dropDuplicates(["doc_id", "content"]).select(row, "words", "starts", "ends").join(owned.select("row").distinct(), "row")
    places = stored(places, "places")
    words = places.select("row", F.explode(F.array_distinct("words")).alias("term"))
    risky = risky_terms(docs, owned, words, support, disclosure).groupBy("row").agg(F.collect_set("term").alias("risky"))

    @F.pandas_udf(kind)
    def marked(words: pd.Series, starts: pd.Series, ends: pd.Series, risky: pd.Series) -> pd.Series:
        hits = [np.isin(w, r) for w, r in zip(words, risky)]
        return pd.Series([[{"kind": "term", "start": x, "end": y} for x, y in zip(a[h].tolist(), b[h].tolist())] for a, b, h in zip(starts, ends, hits)])

    terms = places.join(risky, "row").select("row.doc_id", "row.content", marked("words", "starts", "ends", "risky").alias("terms"))
    same = F.col("f.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("f.content") == F.col("t.content"))
    whole = found.alias("f").join(terms.alias("t"), same, "left")
    return whole.select("f.doc_id", "f.content", "f.base", F.coalesce("t.terms", F.array().cast(kind)).alias("terms"))


def searched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """``doc_id, base, terms`` for every row: the patterns' spans and the spans of risky terms, as arrays of (kind, start, end)."""
    return _searched(id_and_text(docs, id_col, text_col), support, disclosure).drop("content")


def sanitised_texts(
    docs: DataFrame, general: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE,
) -> DataFrame:
    """``doc_id, text`` for every row, sanitised; ``general``: ``term, general`` of lower-cased terms and their more general forms, the first by value."""
    docs = id_and_text(docs, id_col, text_col)
    found = _searched(docs, support, disclosure).filter("size(base) > 0").dropDuplicates(["doc_id", "content"])
    rows = docs.withColumn("content", F.xxhash64("text")).alias("d").join(
        found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.content") == F.col("f.content")), "left"
    )
    rows = stored(rows.select("d.doc_id", "d.text", "d.content", "f.base", "f.terms"), "texts")

    @F.pandas_udf("array<string>")
    def named(texts: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([sorted({t[s["start"] : s["end"]].lower() for s in x}) for t, x in zip(texts, terms)])

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, spans: pd.Series, forms: pd.Series) -> pd.Series:
        listed = lambda x: [(s["kind"], s["start"], s["end"]) for s in x]
        return pd.Series([t if s is None else sanitised(t, listed(s), {} if g is None else {x["term"]: x["general"] for x in g}) for t, s, g in zip(texts, spans, forms)])

    forms = rows.sparkSession.createDataFrame([], "term string, general string") if general is None else general
    forms = forms.filter("term IS NOT NULL AND general IS NOT NULL").groupBy("term").agg(F.min("general").alias("general"))
    words = rows.filter("size(terms) > 0").dropDuplicates(["doc_id", "content"]).select("doc_id", "content", F.explode(named("text", "terms")).alias("term"))
    known = words.join(forms, "term").groupBy("doc_id", "content").agg(F.collect_list(F.struct("term", "general")).alias("forms")).alias("k")
    whole = rows.alias("r").join(known, F.col("r.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("r.content") == F.col("k.content")), "left")
    return whole.select("r.doc_id", cleaned("r.text", F.concat("r.base", "r.terms"), "k.forms").alias("text"))


def sanitised(text: str, spans: list[tuple[str, int, int]], general: dict[str, str] | None = None) -> str:
    """The text with its entities replaced by their kind, and its risky terms by a more general term or by nothing."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], (general or {}).get(text[a:b].lower(), "") if kind == "term" else f"[{kind}]"]
            at = b
        elif b > at:
            at = b
    return "".join(out) + text[at:]
