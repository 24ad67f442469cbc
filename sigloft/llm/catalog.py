"""The registered queries of this package, over the whole given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloft.llm import (
    bpe_codec, conversations, decontaminate, doc_fingerprints, fuzzy_passages, quality, sanitise, secret_scans, sentencepieces, simhash_dedup,
    spelling_variants, token_counts, warc,
)
from sigloft.llm.common import table
from sigloft.session import shared_folder, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op7_simhash_near_dedup")
def near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op8_sentencepiece")
def sentencepiece_round_trips(spark: SparkSession, sf: str) -> DataFrame:
    return sentencepieces.round_trips(table(spark, sf, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op9_token_counts")
def counted_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"))


def _secret_sql() -> str:
    kinds = "\nUNION ALL ".join(
        f"SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(text, '{p}', 0) AS whole, "
        f"regexp_extract_all(text, '{p}', {r.group}) AS part, string_split_regex(text, '{p}') AS gaps FROM texts"
        for i, r in enumerate(secret_scans.RULES)
        for p in [r.pattern.replace("'", "''").replace('\\"', '"')]
    )
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    cut AS ({kinds}),
    matches AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM cut),
    spans AS (
        SELECT doc_id, rank, kind, length(whole[i]) AS size,
            list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS start
        FROM matches WHERE length(part[i]) >= least
    ),
    found AS (
        SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
            count(*) FILTER (kind = 'hex') AS n_hex,
            string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, rank) AS spans
        FROM spans GROUP BY doc_id
    )
    SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM texts t LEFT JOIN found f ON t.doc_id = f.doc_id
    """


@query("op4_secret_scans", _secret_sql())
def secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secret_scans.findings(table(spark, sf, "documents"), shared_folder(spark, "blob-ledger"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, r.kind))).cast("long").alias(f"n_{r.kind}") for r in secret_scans.RULES]
    listed = secret_scans.listed(F.col("spans"))
    return found.select("doc_id", *counts, F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


_WARC_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
l AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= {warc.LEAST} GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN p.page_id < l.last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN p.page_id < l.last THEN l.last END AS refers_to
FROM p LEFT JOIN l ON p.payload_digest = l.payload_digest AND p.payload_bytes >= {warc.LEAST}
"""


@query("op10_warc", _WARC_SQL)
def archived_pages(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    files = warc.write_archive(table(spark, sf, "pages"), folder)
    return warc.read_archive(files, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_doc_fingerprints")
def fingerprinted(spark: SparkSession, sf: str) -> DataFrame:
    done = stored(doc_fingerprints.compared_with_edits(table(spark, sf, "documents")), "fingerprints")
    near = doc_fingerprints.near_counts(done)
    return done.join(near, "fingerprint", "left").select(*done.columns, F.coalesce("n_near", F.lit(0)).alias("n_near"))


@query("op1_quality_classifier")
def quality_scores(spark: SparkSession, sf: str) -> DataFrame:
    return quality.scored(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op6_pii")
def personal_data(spark: SparkSession, sf: str) -> DataFrame:
    found = sanitise.searched(table(spark, sf, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in sanitise.KINDS]

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed(F.concat("base", "terms")).alias("spans"))


@query("op2_benchmark_decontamination")
def benchmark_matches(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op5_fuzzy_passages")
def repeated_passages(spark: SparkSession, sf: str) -> DataFrame:
    return fuzzy_passages.passages(table(spark, sf, "documents"))


_CRC_STEP = "xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])"
#: SQL has no CRC-32: the table of its polynomial and one step for each byte; letters up to U+00FF have one or two bytes.
_VARIANTS_SQL = f"""
WITH RECURSIVE crc AS (
    SELECT list(list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS t
    FROM range(256) r(i)
),
texts AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
    FROM texts WHERE length(run) >= 6 GROUP BY ALL
),
hashed AS (
    SELECT run, times, xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
        lambda s: CASE WHEN unicode(s) < 128 THEN [unicode(s)::UBIGINT] ELSE [(192 | (unicode(s) >> 6))::UBIGINT, (128 | (unicode(s) & 63))::UBIGINT] END))),
        lambda c, b: {_CRC_STEP}), 4294967295::UBIGINT) AS h
    FROM runs, crc
),
words AS (
    SELECT word, sum(times)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 199 = 0 THEN run[1:(h % length(run))::BIGINT] || run[(h % length(run))::BIGINT + 2:] ELSE run END AS word, times FROM hashed)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
),
cut AS (SELECT word, n, i, word[1:i - 1] AS front, word[i + 1:] AS back FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
    SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.front = b.front AND a.back = b.back AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON b.word = a.front || a.back
    UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON b.word = a.front || a.back
),
near AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS other FROM pairs GROUP BY word),
formed AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n
    FROM words w LEFT JOIN near USING (word)),
walk AS (
    SELECT word, coalesce(form, word) AS root FROM formed
    UNION SELECT w.word, f.form FROM walk w JOIN formed f ON f.word = w.root WHERE f.form IS NOT NULL
)
SELECT f.word, form, w.root, n, n_near, form_n FROM formed f
JOIN (SELECT word, root FROM walk WHERE root NOT IN (SELECT word FROM formed WHERE form IS NOT NULL)) w ON w.word = f.word
"""


@query("op11_spelling_variants", _VARIANTS_SQL)
def grouped_variants(spark: SparkSession, sf: str) -> DataFrame:
    words = spelling_variants.counted(spelling_variants.damaged_words(table(spark, sf, "documents"), 199, 6), 6, 5)
    return spelling_variants.variant_groups(words, 5, 6)


@query("op12_bpe")
def bpe_round_trips(spark: SparkSession, sf: str) -> DataFrame:
    return bpe_codec.round_trips(table(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op13_conversation_repair")
def repaired_conversations(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    return conversations.structure_repairs(conversations.damaged(rows), rows)
