"""WARC archives: writing with revisits, and reading with boundary-chain verification.

Archives are gzipped WARC 1.1 files of bounded size in the shared folder; offsets
are those of the unpacked bytes.
A reader can't trust the magic string, since payloads may hold it.  So tasks only
emit candidates: every place where the magic stands, with the offset of its
successor by its own Content-Length.  A candidate is a record if and only if the
chain of successors from the file's start reaches it; pointer jumping finds that
in as many joins as the logarithm of the chain's length in blocks.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialise

MAGIC = b"WARC/1.1\r\n"
#: Payloads of at least so many bytes are stored once; later copies revisit.
MIN_REVISIT_BYTES = 0
#: Bytes of a block of an archive; within a block chains are followed at once.
BLOCK = 1 << 20
#: Payload bytes of an archive file, about, and records of one at most; a file is read by one task.
FILE_BYTES, FILE_ROWS = 16 << 20, 2_000
#: Rows of candidates that a task hands on at once.
ROWS_AT_ONCE = 256
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hexadecimal digits: 5 digits are 4 letters."""
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _B32)


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, files: int = 1) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to of each page, dealt at random over ``files`` partitions.

    Revisits are found among digests; payloads are shuffled once, by page, and
    meet them there.  A payload that a large share of all pages has is looked up
    where the digests are (``join_hot``), so it is never dealt to one task.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_of_hex(F.sha1("payload"))).withColumn("_place", F.concat_ws(":", F.col("page_id").cast("string"), "payload_digest"))
    light = rows.filter(F.col("payload_bytes") >= min_bytes).select("page_id", "payload_digest", "_place")
    copies = light.groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    again = join_hot(light, materialise(copies, "copies"), ["payload_digest"], "_n").filter(F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")))
    again = again.select("_place", "_first").distinct()
    met = rows.repartition(files, "_place").join(again.repartition(files, "_place").hint("merge"), "_place", "left")
    return met.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(F.col("_first").isNotNull(), "revisit").otherwise("response").alias("record_type"), F.col("_first").alias("refers_to"))


def record_text() -> Column:
    """A WARC record without its last line feed, which the text writer adds."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    return F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        line("WARC-Refers-To", F.when(revisit, urn(F.col("refers_to")))),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
        F.lit("\r\n\r"),
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES, file_rows: int = FILE_ROWS) -> str:
    """Write one record for each page to archive files under ``path``.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with
    the smallest page_id holds the payload (response), the others name it
    (revisit); smaller payloads are all held.  Null html is an empty payload, a
    null url has no target line, rows with a null page_id are written under the
    name "none" (and revisit a copy that has a page_id).  Rows repeated with the
    same page_id are all responses.  Further columns are ignored.

    Pages are dealt at random over as many files as ``file_bytes`` asks for all
    payloads and urls together, so a file has about that size and at most
    ``file_rows`` records; only a page that is larger than that makes a larger one.
    """
    size = F.octet_length(F.coalesce(F.col("html").cast("string"), F.lit(""))) + F.octet_length(F.coalesce(F.col("url").cast("string"), F.lit("")))
    total, n = pages.agg(F.sum(size.cast("long")), F.count("*")).first()
    files = max(1, -(-int(total or 0) // file_bytes), -(-2 * n // file_rows))
    out = plan_records(pages, min_bytes, files).select(record_text().alias("value")).write
    out.option("maxRecordsPerFile", file_rows).option("compression", "gzip").text(path)
    return path


_HEADER = re.compile(rb"([A-Za-z-]+): ([^\r\n]*)\r\n")
_LENGTH, _DIGITS = b"\r\nContent-Length: ", re.compile(rb"([0-9]{1,18})\r\n")
CANDIDATE = "file string, block long, start long, next long, exit long, entry boolean, size long, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def _urn(value: bytes | None) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?\d+)>", value or b"")
    return int(found[1]) if found else None


def _candidates(content: bytes) -> list[dict]:
    """Each place of the magic, with its successor by its own length; next -1: no record.

    A header may have any length.  Places before one header end share it and the
    last Content-Length line before it, so neither is searched twice.  The file's
    start is always a place.
    """
    out, at, head, stated = [], content.find(MAGIC), -1, None
    if content and at != 0:
        out.append({"start": 0, "next": -1, "fields": {}, "from": 0, "to": 0})
    while at >= 0:
        row = {"start": at, "next": -1, "fields": {}, "from": 0, "to": 0}
        if head < at < len(content):
            head = content.find(b"\r\n\r\n", at)
            head = len(content) if head < 0 else head
            line = content.rfind(_LENGTH, at, head + 2)
            stated = _DIGITS.match(content, line + len(_LENGTH)) if line >= 0 else None
        if stated and stated.start() - len(_LENGTH) >= at and content[(end := head + 4 + int(stated[1])) : end + 4] == b"\r\n\r\n":
            row |= {"next": end + 4, "fields": dict(_HEADER.findall(content, at + len(MAGIC), head + 2)), "from": head + 4, "to": end}
        out.append(row)
        at = content.find(MAGIC, at + 1)
    return out


def _scan(keep_payload: bool):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                content = zlib.decompress(content, wbits=31) if content[:2] == b"\x1f\x8b" else content
                found, leave = _candidates(content), {}
                for c in reversed(found):  # the first successor outside the block
                    near = c["next"] >= 0 and c["next"] // BLOCK == c["start"] // BLOCK
                    leave[c["start"]] = c["exit"] = leave.get(c["next"], -1) if near and c["next"] < len(content) else c["next"]
                entries = {0, *leave.values()}  # only there can the chain come into a block
                for k in range(0, len(found), ROWS_AT_ONCE):
                    rows = [_row(file, content, c, c["start"] in entries, keep_payload) for c in found[k : k + ROWS_AT_ONCE]]
                    yield pd.DataFrame(rows, columns=[x.split()[0] for x in CANDIDATE.split(", ")]).astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

    return scan


def _row(file: str, content: bytes, c: dict, entry: bool, keep_payload: bool) -> tuple:
    """A candidate as a row; its payload is cut out of the file here and nowhere kept."""
    f, body = c["fields"], content[c["from"] : c["to"]]
    full, stated = f.get(b"WARC-Type") == b"response", f.get(b"WARC-Payload-Length", b"")
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode() if full else f.get(b"WARC-Payload-Digest", b"").decode("latin-1").removeprefix("sha1:")
    url = f[b"WARC-Target-URI"].decode("utf-8", "replace") if b"WARC-Target-URI" in f else None
    length = len(body) if full else int(stated) if stated.isdigit() else None
    return (file, c["start"] // BLOCK, c["start"], c["next"], c["exit"], entry, len(content), f.get(b"WARC-Type", b"").decode("latin-1"), _urn(f.get(b"WARC-Record-ID")), url, digest, length, _urn(f.get(b"WARC-Refers-To")), body if keep_payload else None)


def block_entries(candidates: DataFrame) -> DataFrame:
    """Places where the chain from a file's start enters its blocks.

    Pointer jumping over block exits: each round marks where the marked places
    jump to and doubles the jumps, so it ends after the logarithm of the number
    of blocks in the longest file.  Only places that a chain may enter a block at
    take part, a few for each block, and all joins are merge joins.
    """
    jumps = candidates.filter("next >= 0 and entry").select("file", "start", F.col("exit").alias("to"))
    marked = candidates.select("file").distinct().withColumn("start", F.lit(0).cast("long"))
    while True:
        ahead = marked.join(jumps.hint("merge"), ["file", "start"]).select("file", F.col("to").alias("start"))
        grown = materialise(marked.union(ahead).filter("start >= 0").distinct(), "entries")
        jumps = materialise(jumps.alias("a").join(jumps.alias("b").hint("merge"), (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.start"))).select("a.file", "a.start", F.col("b.to").alias("to")), "jumps")
        marked = grown
        if jumps.isEmpty():
            break
    return marked


def read_archives(spark, path: str, keep_payload: bool = True, whole: bool = True) -> DataFrame:
    """Verified records of all archives under ``path``.

    One row for each record: file, start, record_type, page_id, url,
    payload_digest, payload_bytes, refers_to and, if asked for, payload.  Bytes
    that look like a record inside a payload are not returned.  A file whose chain
    of records does not end at its size (cut off or damaged) is an error; without
    ``whole`` it yields the records before that place.  No files, no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    scanned = materialise(files.mapInPandas(_scan(keep_payload), CANDIDATE), "candidates")
    light = scanned.select("file", "block", "start", "next", "exit", "entry")
    marked = block_entries(light)
    if whole:
        ends = marked.select("file", F.col("start").alias("size"))
        broken = scanned.select("file", "size").distinct().join(ends.hint("merge"), ["file", "size"], "left_anti").select("file").take(5)
        if broken:
            raise ValueError(f"the chain of records does not end at the file's size: {', '.join(x.file for x in broken)}")
    entries = marked.withColumn("block", F.floor(F.col("start") / BLOCK).cast("long"))
    blocks = light.filter("next >= 0").groupBy("file", "block").agg(F.collect_list("start").alias("starts"), F.collect_list("next").alias("nexts"))
    entered = entries.groupBy("file", "block").agg(F.collect_list("start").alias("entries"))
    real = blocks.join(entered.hint("merge"), ["file", "block"]).select("file", "entries", "starts", "nexts").mapInPandas(_block_walk, "file string, start long")
    # one row for each record on either side: never a side to broadcast, however well it is packed
    return scanned.join(real.hint("merge"), ["file", "start"]).drop("block", "next", "exit", "entry", "size")


def _block_walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Follow the chain from a block's entry through the block."""
    for batch in batches:
        for file, entries, starts, nexts in zip(batch["file"], batch["entries"], batch["starts"], batch["nexts"], strict=True):
            follow, out = dict(zip(starts, nexts, strict=True)), []
            at = min(entries)
            while at in follow:
                out.append(at)
                at = follow[at]
            if out:
                yield pd.DataFrame({"file": [file] * len(out), "start": out})


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS x FROM p),
d AS (
  SELECT page_id, n, list_aggregate(list_transform(range(0, 32), lambda i:
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || x[(i // 4) * 5 + 1:(i // 4) * 5 + 5])::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1]), 'string_agg', '') AS digest
  FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS lead FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> lead THEN lead END AS refers_to
FROM f
"""
