"""WARC archives: written by Spark's text writer, indexed first, read back by coalesced byte ranges."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraft.llm.common import map_batches
from lexigraft.session import materialize, scratch_path

#: Ends every record; the text writer puts it after each row. Fixed value.
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are always stored.
MIN_REVISIT = 1000
#: Columns of the index.
INDEX = "file string, offset bigint, length bigint, page_id bigint, url string, digest string, record_type string"
INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
#: Ranges closer than this are read as one, up to this many bytes.
MAX_GAP, MAX_RANGE = 64 << 10, 4 << 20
#: Rows of the index that a task holds at a time.
INDEX_ROWS = 10_000
DATE = "%Y-%m-%dT%H:%M:%SZ"


def _lines(*lines: Column | str) -> Column:
    parts = []
    for line in lines:
        parts += [F.lit(line) if isinstance(line, str) else line, F.lit("\r\n")]
    return F.concat(*parts)


def with_revisits(pages: DataFrame) -> DataFrame:
    """Adds ``payload_bytes, payload_digest, refers_to`` to ``(page_id, url, html)``.

    Of equal payloads of at least ``MIN_REVISIT`` bytes the one with the largest id is stored, the others refer
    to it. Only digests and ids are grouped, without the texts; the revisits found are written, so that the
    planner knows their size when it joins them to the pages.
    """
    payload = F.coalesce("html", F.lit(""))
    sized = pages.select(
        "page_id",
        "url",
        payload.alias("html"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(F.encode(payload, "UTF-8")).alias("payload_digest"),
    )
    large = materialize(
        sized.where(F.col("payload_bytes") >= MIN_REVISIT).select("page_id", "payload_digest"), "payloads"
    )
    groups = large.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    groups = materialize(groups.where("n > 1").drop("n"), "payload-groups")
    revisits = large.join(groups, "payload_digest").where(F.col("page_id") != F.col("refers_to")).distinct()
    revisits = materialize(revisits, "revisits")
    return sized.join(revisits, ["page_id", "payload_digest"], "left")


def records(pages: DataFrame, date: str) -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, refers_to, record)``: the record's text without its end."""
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", date):
        raise ValueError(f"not a UTC time to the second: {date!r}")
    is_revisit = F.col("refers_to").isNotNull()
    http = _lines(
        "HTTP/1.1 200 OK",
        "Content-Type: text/html; charset=utf-8",
        F.concat(F.lit("Content-Length: "), F.col("payload_bytes").cast("string")),
        "",
    )
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("html")))
    # A line end inside a URL would end the header line.
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")

    def identity(column: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("null")), F.lit(">"))

    head = F.concat(
        _lines(
            "WARC/1.1",
            F.concat(F.lit("WARC-Type: "), F.when(is_revisit, "revisit").otherwise("response")),
            F.concat(F.lit("WARC-Record-ID: "), identity("page_id")),
            f"WARC-Date: {date}",
            F.concat(F.lit("WARC-Target-URI: "), url),
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        ),
        F.when(
            is_revisit,
            _lines(
                F.concat(F.lit("WARC-Refers-To: "), identity("refers_to")),
                F.lit(f"WARC-Profile: {REVISIT_PROFILE}"),
            ),
        ).otherwise(""),
        _lines(
            "Content-Type: application/http; msgtype=response",
            F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
            "",
        ),
    )
    return pages.withColumn("block", block).select(
        "page_id", "url", "payload_bytes", "payload_digest", "refers_to", F.concat(head, "block").alias("record")
    )


def write_archives(pages: DataFrame, folder: str, date: str | None = None) -> None:
    """Writes a WARC record for every row of ``(page_id, url, html)`` into archives below ``folder``.

    Each task writes one archive with Spark's text writer, the record end as line separator; so it works on
    every store, and a retried task leaves no half archive. Null html is an empty payload, a null url an empty
    URI, a null id "null"; repeated rows give a record each; other columns are ignored; without rows there are no records.
    All records bear one ``date`` (UTC, as 2024-05-06T07:08:09Z; by default the time of the call), so a retried task writes the same bytes.
    """
    date = date or datetime.now(timezone.utc).strftime(DATE)
    made = records(with_revisits(pages.select("page_id", "url", "html")), date)
    made.select(F.col("record").alias("value")).write.option("lineSep", RECORD_END).text(folder)


def _open(file: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(file if "://" in file else file.replace("file:/", "file:///", 1))
    return store.open_input_file(path)


def index_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The index of all archives: ``(file, offset, length, page_id, url, digest, record_type)``, a row per record.

    An archive is walked once, from header to header, in blocks of bounded size.
    """
    # Only names and lengths are read here, no contents.
    files = spark.read.format("binaryFile").load(folder).select(F.col("path").alias("file"), F.col("length").alias("size"))
    files = files.where("size > 0")

    def make():
        def walk(file: str, size: int) -> Iterator[dict]:
            with _open(file) as source:
                at, data, start = 0, b"", 0
                while at < size:
                    end = data.find(RECORD_END.encode(), at - start)
                    if end < 0:
                        # The header goes on behind the block; an entry follows in any case.
                        wanted = max(MAX_RANGE, 2 * len(data) if start == at else 0)
                        data, start = source.read_at(min(wanted, size - at), at), at
                        continue
                    named = parse_head(data[at - start : end])
                    length = end - (at - start) + len(RECORD_END) + int(named["Content-Length"])
                    yield {
                        "file": file,
                        "offset": at,
                        "length": length,
                        "page_id": _number(named, "WARC-Record-ID"),
                        "url": named["WARC-Target-URI"],
                        "digest": named["WARC-Payload-Digest"],
                        "record_type": named["WARC-Type"],
                    }
                    at += length + len(RECORD_END)
                    if at > start + len(data):
                        data, start = b"", at

        def work(batch: pa.RecordBatch):
            for file, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for rows in batched(walk(file, size), INDEX_ROWS):
                    yield {n: [r[n] for r in rows] for n in INDEX_NAMES}

        return work

    tasks = spark.sparkContext.defaultParallelism
    return map_batches(files.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file"), make, INDEX)


def coalesce_ranges(rows: list[tuple[int, int]], gap: int = MAX_GAP, most: int = MAX_RANGE) -> Iterator[tuple[int, int, list]]:
    """Joins sorted (offset, length) ranges to reads of at most about ``most`` bytes: (start, end, ranges in it)."""
    start = end = None
    inside: list = []
    for offset, length in rows:
        if inside and (offset - end > gap or offset + length - start > most):
            yield start, end, inside
            inside = []
        if not inside:
            start, end = offset, offset
        inside.append((offset, length))
        end = max(end, offset + length)
    if inside:
        yield start, end, inside


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record here: {lines[0][:40]!r}")
    return dict(line.split(": ", 1) for line in lines[1:])


def _number(named: dict[str, str], name: str) -> int | None:
    text = named.get(name, "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def parse_record(data: bytes) -> dict:
    """Headers and payload of one record; a revisit's payload length is that of its HTTP header."""
    head, _, block = data.partition(b"\r\n\r\n")
    named = parse_head(head)
    if len(block) != int(named["Content-Length"]):
        raise ValueError(f"{named['WARC-Record-ID']}: {len(block)} bytes, {named['Content-Length']} said")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {
        "page_id": _number(named, "WARC-Record-ID"),
        "record_type": named["WARC-Type"],
        "refers_to": _number(named, "WARC-Refers-To"),
        "date": named["WARC-Date"],
        "payload_digest": named["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload_bytes": size,
        "payload": payload if named["WARC-Type"] == "response" else None,
    }


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Reads the records that ``index`` selects (``file, offset, length``) back from the archives.

    The index is dealt by file and slice of the file and sorted by offset; each task reads few large ranges
    instead of one range per record. A stored payload must have the digest that its record states.
    Returns ``(page_id, record_type, refers_to, date, payload_digest, payload_bytes, payload BINARY)``; without
    ``payloads`` they are read and compared with their digests, but do not leave the task.
    """
    # Neighbours in a file go to the same task, a large file to several.
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset")
    schema = (
        "page_id bigint, record_type string, refers_to bigint, date string, payload_digest string, payload_bytes bigint"
    ) + (", payload binary" if payloads else "")

    def make():
        import hashlib

        names = [x.split()[0] for x in schema.split(", ")]

        def work(batch: pa.RecordBatch):
            files = batch.column(0).to_pylist()
            rows = list(zip(files, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for file in sorted(set(files)):
                with _open(file) as source:
                    for start, end, inside in coalesce_ranges(sorted(r[1:] for r in rows if r[0] == file)):
                        data = source.read_at(end - start, start)
                        out: dict = {n: [] for n in names}
                        for offset, length in inside:
                            record = parse_record(data[offset - start : offset - start + length])
                            payload = record["payload"]
                            if payload is not None and hashlib.sha1(payload).hexdigest() != record["payload_digest"]:
                                raise ValueError(f"{file} at {offset}: the payload has another digest")
                            for n in names:
                                out[n].append(record[n])
                        yield out

        return work

    return map_batches(dealt.sortWithinPartitions("file", "offset"), make, schema)


def archive_pages(pages: DataFrame, date: str | None = None) -> DataFrame:
    """Writes the pages to archives in a new shared folder and returns the written index."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write_archives(pages, folder, date)
    return materialize(index_archives(spark, folder), "warc-index")
