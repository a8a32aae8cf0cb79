"""WARC archives with an index of byte ranges, read back by coalesced ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm.storage import materialize, new_path

ROLL_BYTES, RANGE_BYTES, GAP_BYTES, SPLIT_BYTES = 1 << 28, 1 << 23, 1 << 16, 1 << 24
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, digest string, kind string, file string, offset long, length long"


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file://{uri}")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def page_of(urn: str) -> int | None:
    found = urn.split(":")[2]
    return int(found) if found else None


def member(head: list[str], block: bytes) -> bytes:
    """A record as a gzip member of its own."""
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def opening(name: str, date: str) -> bytes:
    """The record that says what a file is."""
    return member(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:file:{name}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """The record of a page. A revisit has no payload, and says how long it was."""
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {PROFILE}"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    return member([*head, "Content-Type: application/http; msgtype=response"], block)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, directory: str, least: int = 0, date: str | None = None) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) and returns the stored index: url, digest, file, offset, length.

    Of rows whose payloads have at least `least` bytes and are equal, the one with the largest page_id is a response and the
    others are revisits of it. The winner is found by a partial maximum per digest; only winners' payloads are shuffled, keyed
    by digest and id together, so a payload that many pages share stays even. A task writes files of its own with fresh names
    and returns their index, so a task that runs again leaves an unused file at most. Null html is empty; a null url is left
    out of the record; rows repeated with their id are responses if they are the largest; null ids are smallest. An empty table
    gives an empty index and no files; other columns are ignored. date, the records' time, is now unless given.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html").cast("long"))
    small = rows.filter(F.col("size") < least)
    equal = rows.filter(F.col("size") >= least) if least else rows
    winners = equal.groupBy("sha").agg(F.max("page_id").alias("winner"))
    joined = equal.select("page_id", "url", "sha", "size").join(winners, "sha")
    revisits = joined.filter(~F.col("page_id").eqNullSafe(F.col("winner"))).select("page_id", "url", F.lit(None).cast("string").alias("html"), "sha", "size", F.col("winner").alias("refers_to"))
    best = winners.withColumnRenamed("sha", "w_sha")
    responses = equal.join(best, (F.col("sha") == F.col("w_sha")) & F.coalesce(F.col("page_id"), F.lit(-(1 << 62))).eqNullSafe(F.coalesce(F.col("winner"), F.lit(-(1 << 62)))), "left_semi")
    response_rows = (responses.unionByName(small) if least else responses).select("page_id", "url", "html", "sha", "size", F.lit(None).cast("long").alias("refers_to"))
    todo = response_rows.withColumn("revisit", F.lit(False)).unionByName(revisits.withColumn("revisit", F.lit(True)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(directory)
        out, name, at = None, "", 0
        for batch in batches:
            index = []
            for page_id, url, html, sha, size, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store.create_dir(base, recursive=True)
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    at = out.write(opening(name, date))
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                own = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, size, refers_to, revisit, date)
                out.write(own)
                index.append((page_id, url, digest, "revisit" if revisit else "response", name, at, len(own)))
                at += len(own)
                if at >= ROLL_BYTES:
                    out.close()
                    out = None
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in index], t) for i, t in enumerate(types)], names=[f.split()[0] for f in INDEX.split(", ")])
        if out is not None:
            out.close()

    return materialize(todo.mapInArrow(write, INDEX), "warc-index")


def ranges(index: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Runs of records sorted by offset that one read of at most about RANGE_BYTES takes."""
    index = index.sort_values("offset", kind="stable")
    start, first, end = 0, None, 0
    for i, (offset, length) in enumerate(zip(index["offset"], index["length"], strict=True)):
        if first is None or offset > end + GAP_BYTES or offset + length - first > RANGE_BYTES:
            if i > start:
                yield index.iloc[start:i]
            start, first = i, offset
        end = max(end if i > start else 0, offset + length)
    if start < len(index):
        yield index.iloc[start:]


def read_records(index: DataFrame, directory: str, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type and refers_to (with payloads, payload too) of the records in a
    (selected) index.

    Only the byte ranges of these records are read, neighbours in one read. A task takes a part of a file of SPLIT_BYTES at
    most. The digest of a response is computed from the payload that was read. A record that is in the index twice is read
    twice; an empty index gives no rows; columns of the index that write_archives does not make are ignored.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def read(group: pd.DataFrame) -> pd.DataFrame:
        store, base = filesystem(directory)
        out = []
        with store.open_input_file(f"{base}/{group['file'].iloc[0]}") as source:
            for run in ranges(group):
                first = int(run["offset"].iloc[0])
                size = int((run["offset"] + run["length"]).max()) - first
                source.seek(first)
                data = source.read(size)
                for url, offset, length in zip(run["url"], run["offset"], run["length"], strict=True):
                    headers, payload = parse(data[offset - first : offset - first + length])
                    kind = headers["WARC-Type"]
                    if kind == "response":
                        found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    else:
                        found = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    out.append((page_of(headers["WARC-Record-ID"][1:-1]), url, *found, kind, page_of(headers["WARC-Refers-To"][1:-1]) if kind == "revisit" else None, payload)[: len(names)])
        frame = pd.DataFrame(out, columns=names)
        return frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    own = index.select("url", "file", "offset", "length", F.floor(F.col("offset") / SPLIT_BYTES).alias("part"))
    return own.groupBy("file", "part").applyInPandas(read, schema)


def archive_directory(spark) -> str:
    return new_path(spark, "warc")
