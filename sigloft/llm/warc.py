"""WARC archives with records compressed one by one under a shared Zstandard dictionary.

A dictionary is trained on archived payloads and stands, in a skippable frame, at the head of each file, so that a file can be read on its
own; behind it each record is a Zstandard frame. Payloads of at least ``least`` bytes are stored once: of equal ones the record with the
largest page id is the response, the others are revisits of it without a payload. Files turn over at a fixed size. Tasks write to names of
their own and only files of tasks that ended well are in the archive's list, so a lost executor leaves no half file in it.

The dictionary is fitted on a bounded sample: at most SAMPLES different payloads, the first by hash, of at most SAMPLE_CHARS characters each.
Null html is an empty payload; a null url is left out of the record. Records with a null page id are responses, and the response of others
only if no equal payload has an id. Repeated rows of the largest id are responses all. An empty table gives an archive without files.
Only the three named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloft.llm.common import below, whole_text
from sigloft.session import stored

#: Fixed values of the format: the skippable frame that holds a dictionary, and the profile of a revisit.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST = 1000
SAMPLES, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 16_384, 65_536
FILE_BYTES = 64 << 20
#: Bytes of an archive that one task reads back, at the least one file.
TASK_BYTES = 128 << 20
LEVEL = 3
DATE = "2020-01-01T00:00:00Z"
FILES = "file string, records long, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def records_of(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``page_id, url, html, n, digest, owner``: html is null for revisits, owner the page id of their response."""
    html = whole_text("html")
    rows = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("n"), F.sha1(html).alias("digest"))
    # Only digests that stand several times are met, so that payloads stay where they are as long as these are few.
    large = rows.filter(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("times"))
    owners = large.filter("times > 1").select("digest", "last")
    owner = F.when((F.col("n") >= least) & (F.col("page_id") < F.col("last")), F.col("last"))
    met = rows.join(owners, "digest", "left").withColumn("owner", owner).drop("last")
    return met.select("page_id", "url", F.when(F.col("owner").isNull(), F.col("html")).alias("html"), "n", "digest", "owner")


def dictionary(pages: DataFrame) -> bytes:
    """A dictionary over a bounded sample of the payloads: trained on them, or their own bytes where they are too few to train on.

    Each payload gives SAMPLE_CHARS characters from a place that its hash chooses. A common record's head ends it in any case.
    """
    h = F.xxhash64("html")
    place = F.pmod(h, F.greatest(F.length("html") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    texts = pages.filter("html <> ''").select(F.substring("html", place, SAMPLE_CHARS).alias("html"), h.alias("h"))
    # About twice the sample of the different payloads passes by its hash, so that few rows meet where the first are chosen.
    different = texts.agg(F.count_distinct("h")).first()[0]
    some = texts.filter(below(F.col("h"), 2 * SAMPLES, different)).dropDuplicates(["h"])
    payloads = [r.html.encode() for r in some.orderBy("h").limit(SAMPLES).collect()]
    for size in (DICTIONARY_BYTES, DICTIONARY_BYTES // 8, DICTIONARY_BYTES // 64):
        try:
            return zstandard.train_dictionary(size, payloads, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            continue
    return b"".join(payloads)[:DICTIONARY_BYTES] + record(0, "http://", "response", b"", 0, "0" * 40, None)


def record(page_id: int | None, url: str | None, kind: str, payload: bytes, n: int, digest: str, owner: int | None) -> bytes:
    """One record's bytes, before compression."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode() + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{owner}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archive(pages: DataFrame, folder: str, least: int = LEAST, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes one record for each page below ``folder``, which every executor must reach; the list of files as ``file, records, bytes``."""
    learned = dictionary(pages)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(learned))
        done, out, name, n, size = [], None, "", 0, 0
        for batch in batches:
            for page_id, url, html, length, digest, owner in zip(*(batch[c] for c in ("page_id", "url", "html", "n", "digest", "owner"))):
                if out is None:
                    name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.zst"
                    out, n, size = store.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(learned)) + learned)
                page_id, owner = (None if pd.isna(x) else int(x) for x in (page_id, owner))
                raw = record(page_id, url, "response" if owner is None else "revisit", html.encode() if owner is None else b"", length, digest, owner)
                frame = compressor.compress(raw)
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= file_bytes:
                    out.close()
                    done.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n, size))
        yield pd.DataFrame(done, columns=["file", "records", "bytes"])

    return stored(records_of(pages, least).mapInPandas(write, FILES), "warc-files")


def parse(stream) -> Iterator[dict]:
    """The records of an opened archive file: their header fields, ``kind``, and the ``block`` behind the headers."""
    head = stream.read(8)
    learned, rest = b"", head
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_MAGIC:
        learned, rest = stream.read(struct.unpack("<II", head)[1]), b""
    frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(learned) if learned else None)
    kept, ended = b"", False
    with frames.stream_reader(_Joined(rest, stream), read_across_frames=True) as text:
        while True:
            while (cut := kept.find(b"\r\n\r\n")) < 0 and not ended:
                more = text.read(1 << 16)
                ended = not more
                kept += more
            if cut < 0:
                return
            lines = kept[:cut].decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            need = cut + 4 + int(fields["Content-Length"]) + 4
            parts, have = [kept], len(kept)
            while have < need and (more := text.read(max(1 << 16, need - have))):
                parts.append(more)
                have += len(more)
            kept = b"".join(parts)
            if have < need:
                raise EOFError("an archive file ends within a record")
            yield fields | {"block": kept[cut + 4 : need - 4]}
            kept = kept[need:]


class _Joined:
    """A stream whose first bytes have been read already."""

    def __init__(self, first: bytes, stream):
        self.first, self.stream = first, stream

    def read(self, n: int = -1) -> bytes:
        if self.first:
            out, self.first = self.first, b""
            return out
        return self.stream.read(n)


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read_archive(files: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the listed files as RECORDS, and with their payload (null for revisits) if asked for.

    Digests of responses are those of the payload as read; one that differs from the record's header raises.
    """
    schema = RECORDS + (", payload binary" if with_payload else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch["file"]:
                rows: list[tuple] = []
                size = 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for r in parse(stream):
                        head, _, payload = r["block"].partition(b"\r\n\r\n")
                        digest = base64.b32decode(r["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        revisit = r["WARC-Type"] == "revisit"
                        if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError("a payload differs from its digest")
                        n = int(head.rpartition(b"Content-Length: ")[2]) if revisit else len(payload)
                        row = (_page(r["WARC-Record-ID"]), r.get("WARC-Target-URI"), n, digest, r["WARC-Type"], _page(r["WARC-Refers-To"]) if revisit else None)
                        rows.append((*row, None if revisit else payload) if with_payload else row)
                        size += len(payload) if with_payload else 0
                        if len(rows) >= 5000 or size >= 32 << 20:
                            yield _frame(rows, names)
                            rows, size = [], 0
                yield _frame(rows, names)

    # The names are a few bytes each: how many tasks there are has to follow from what is behind them.
    listed = files.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    tasks = max(-(-(listed["bytes"] or 0) // TASK_BYTES), min(listed["n"], files.sparkSession.sparkContext.defaultParallelism), 1)
    return files.select("file").repartition(int(tasks)).mapInPandas(read, schema)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})
