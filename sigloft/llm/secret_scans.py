"""Secret scans with an incremental ledger of blobs.

Every version of every file is addressed by its content: the SHA-256 of its text names a blob. The ledger, a table in a shared folder,
holds the spans found in each blob under each version of the rules. A scan takes the blobs that the ledger doesn't hold for the present
rules, each once however many paths and versions have it, and appends what it finds; findings are joined back to all paths. Every
scan is written as a folder of its own, so one that breaks off leaves nothing that a reader takes up.

All work is done by DataFrame functions. Positions come from cutting a text at the matches: the lengths of the stretches between and of
the matches add up to them. Equal texts meet in one row before the shuffle, so a large group of copies does not gather in a task.

Null texts are empty, and no text without a match has a span. Rows with a null id are scanned and reported under a null id; repeated rows
give one row each; empty tables give none. Only the named columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloft.llm.common import id_and_text


@dataclass(frozen=True)
class Rule:
    """One kind of secret: a pattern, the group whose length counts, and its least length."""

    kind: str
    pattern: str
    group: int
    least: int


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
RULES = (
    Rule("assign", rf"({KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
)
LEDGER = "blob binary, rules string, spans array<struct<start:int,rank:int,kind:string,end:int>>"


def version_of(rules: Sequence[Rule]) -> str:
    """Names a set of rules; any change of a rule is another version."""
    return uuid.uuid5(uuid.NAMESPACE_OID, repr(tuple(rules))).hex


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """The spans of one rule in order: leftmost matches that don't overlap, without those that are too short."""
    pattern, kind = F.lit(rule.pattern), F.lit(rule.kind)
    pieces = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("part"),
    )
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(done: Column, piece: Column) -> Column:
        begin = done["at"] + piece["gap"]
        end = begin + F.coalesce(piece["size"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), kind.alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(piece["part"] >= rule.least, F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))

    least = rule.pattern if rule.group else f"{rule.pattern.removesuffix('+')}{{{rule.least - len(rule.pattern.partition('[')[0])},}}"
    return F.when(text.rlike(least), F.aggregate(pieces, start, step)["spans"]).otherwise(none)


def spans_of(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """All spans of a text by start, then by the rules' order: ``start, rank, kind, end``, in code points, end exclusive."""
    return F.array_sort(F.concat(*[_spans(text, rule, i) for i, rule in enumerate(rules)]))


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """What the ledger holds so far; a folder without a scan is an empty ledger."""
    try:
        return spark.read.schema(LEDGER).option("recursiveFileLookup", True).parquet(folder)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LEDGER)


def scan(versions: DataFrame, folder: str, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """Scans the blobs of ``versions`` that the ledger lacks under these rules and appends them; the ledger's rows for the rules."""
    spark, name = versions.sparkSession, version_of(rules)
    texts = id_and_text(versions, text_col, text_col).select(blob_of(F.col("text")).alias("blob"), "text").dropDuplicates(["blob"])
    seen = ledger(spark, folder).filter(F.col("rules") == name).select("blob")
    unseen = texts.join(seen, "blob", "left_anti")
    unseen.select("blob", F.lit(name).alias("rules"), spans_of(F.col("text"), rules).alias("spans")).write.parquet(f"{folder}/scan-{uuid.uuid4().hex}")
    return ledger(spark, folder).filter(F.col("rules") == name).select("blob", "spans")


def findings(versions: DataFrame, folder: str, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, blob, spans`` for every row of ``versions``, after a scan of what is new in it."""
    held = scan(versions, folder, rules, text_col)
    paths = id_and_text(versions, id_col, text_col).select("doc_id", blob_of(F.col("text")).alias("blob"))
    return paths.join(held.filter(F.size("spans") > 0), "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array()).alias("spans"))


def redacted(versions: DataFrame, folder: str, rules: Sequence[Rule] = RULES, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``versions`` with every span of its texts replaced by ``mark``; spans that overlap are replaced as one. Null texts stay null."""
    held = scan(versions, folder, rules, text_col).filter(F.size("spans") > 0)
    columns, text = versions.columns, F.col(text_col)
    # One text per copy of a blob is cut, so the joined side has only the blobs with a finding.
    named = versions.withColumn("_blob", blob_of(F.coalesce(text, F.lit("")))).join(held.select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans")), "_blob", "left")

    def step(done: Column, span: Column) -> Column:
        apart = span["start"] >= done["at"]
        kept = F.substring(text, done["at"] + 1, span["start"] - done["at"])
        out = F.when(apart, F.concat(done["out"], kept, F.lit(mark))).otherwise(done["out"])
        return F.struct(out.alias("out"), F.greatest(done["at"], span["end"]).alias("at"))

    cut = F.aggregate("_spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
    whole = F.concat(cut["out"], F.substring(text, cut["at"] + 1, F.length(text)))
    return named.withColumn("_text", F.when(F.col("_spans").isNull(), text).otherwise(whole)).select(*[F.col("_text").alias(c) if c == text_col else F.col(c) for c in columns])


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
