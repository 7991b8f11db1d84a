"""WARC 1.1 archives: a writer, and a sequential reader.

Each record is one gzip member. The reader inflates a file piece by piece with
zlib, starts a new inflater where a member ends, takes Content-Length bytes as the
block whatever they hold, and checks block and payload digests; it never holds more
than one record. Files are reached by pyarrow's file systems (``file:``, ``hdfs:``,
``s3:``, ``gs:``) or, for folders that only Spark can read, as ``binaryFile``.

A payload of at least ``least`` bytes that several pages share is stored once, with
the largest page_id; the others are revisit records. A null payload counts as empty,
a null url leaves out the target URI, a null page_id ranks below all others and is
given back as null. Rows that repeat the largest page_id are responses all of them.
An empty table gives no records. Only the three named columns are read. A payload of any size is one record, so
writer and reader hold one whole at a time.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

PIECE, FORMAT, PROFILE = 1 << 20, b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = re.compile("sha1:[A-Z2-7]{32}")
WRITTEN = "path string, records bigint, bytes bigint"
RECORD = "path string, place bigint, record_id string, record_type string, target_uri string, refers_to string, content_length bigint, payload_bytes bigint, payload_digest string, payload binary, problem string"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(record_id: str, url: str | None, payload: bytes, refers_to: str | None = None, date: str = "2020-01-01T00:00:00Z", level: int = 4) -> bytes:
    """One gzip member: a response with its payload, or a revisit that keeps length and digest of it."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest = _sha1(payload)
    if refers_to is None:
        block += payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    head += [("WARC-Target-URI", quote(url or "", safe="!#$%&'()*+,/:;=?@[]~"))] * (url is not None)
    head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")] * (refers_to is not None)
    head += [("WARC-Payload-Digest", digest), ("WARC-Block-Digest", _sha1(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(FORMAT + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def members(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The inflated gzip members of a file that comes in pieces."""
    z, out = None, []
    for piece in pieces:
        while piece:
            z = z or zlib.decompressobj(31)
            out.append(z.decompress(piece))
            piece = z.unused_data
            if z.eof:
                yield b"".join(out)
                z, out = None, []
    if z is not None:
        raise EOFError("the file ends inside a gzip member")


def records(pieces: Iterable[bytes]) -> Iterator[dict]:
    """Record by record: headers, block, and ``problem``, which names what doesn't hold."""
    for data in members(pieces):
        end = data.find(b"\r\n\r\n")
        lines = data[: max(end, 0)].decode("utf-8", "replace").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(head["content-length"]) if re.fullmatch("[0-9]{1,18}", head.get("content-length", "")) else -1
        block = data[end + 4 : end + 4 + max(length, 0)]
        problem = None
        if end < 0 or not lines[0].startswith("WARC/") or length < 0:
            problem = "header"
        elif len(block) != length or data[end + 4 + length :] != b"\r\n\r\n":
            problem = "length"
        elif "warc-block-digest" in head and head["warc-block-digest"] != _sha1(block):
            problem = "block digest"
        split = block.find(b"\r\n\r\n")
        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block[: max(split, 0)].decode("utf-8", "replace").split("\r\n")[1:])}
        payload = block[split + 4 :] if split >= 0 else b""
        if problem is None and head.get("warc-type") == "response" and "warc-payload-digest" in head and head["warc-payload-digest"] != _sha1(payload):
            problem = "payload digest"
        yield {"head": head, "http": http, "length": length, "payload": payload, "problem": problem}


def _row(path: str, place: int, r: dict, payloads: bool) -> tuple:
    head, known = r["head"], r["head"].get("warc-payload-digest", "")
    digest = base64.b32decode(known[5:]).hex() if _BASE32.fullmatch(known) else hashlib.sha1(r["payload"]).hexdigest()
    said = r["http"].get("content-length", "")
    size = int(said) if said.isascii() and said.isdigit() and len(said) < 19 else len(r["payload"])
    return (path, place, head.get("warc-record-id", "").strip("<>"), head.get("warc-type"), head.get("warc-target-uri"), head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None, r["length"], size, digest, r["payload"] if payloads else None, r["problem"])


def _frames(rows: Iterator[tuple], most: int = 8 << 20) -> Iterator[pd.DataFrame]:
    names, held, size = [x.split()[0] for x in RECORD.split(", ")], [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row[9] or b"")
        if size >= most:
            yield pd.DataFrame(held, columns=names)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=names)


def plan(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000) -> DataFrame:
    """page_id, url, payload in UTF-8, refers_to: for a revisit, the page_id of its response."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"))
    # only what is repeated is looked up: its table is short, and an exchange that a hot payload makes uneven is split by AQE
    large = rows.select("page_id", F.sha2("payload", 256).alias("same"), F.length("payload").alias("n")).filter(F.col("n") >= least)
    first = large.groupBy("same").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("same", "first")
    own = F.concat(F.lit("small page "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    rows = rows.withColumn("same", F.when(F.length("payload") >= least, F.sha2("payload", 256)).otherwise(own))
    return rows.join(first, "same", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write(rows: DataFrame, folder: str, roll: int = 64 << 20) -> DataFrame:
    """Write what plan() gives to archives of about ``roll`` bytes below folder; one row per file.

    A file gets its name when it is complete, and the name holds the task's attempt:
    what a lost attempt has left is in no row of the result and is never read.
    """
    rows = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.col("refers_to").cast("string").alias("refers_to"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        system, top = fs.FileSystem.from_uri(folder)
        done, out, count, size, part = [], None, 0, 0, f"{task.partitionId():06d}-{task.taskAttemptId()}"

        def close():
            nonlocal out
            out.close()
            final = f"{top}/{part}-{len(done):05d}.warc.gz"
            system.move(temporary, final)
            done.append((posixpath.join(folder, posixpath.basename(final)), count, size))
            out = None

        for b in batches:
            for page, url, payload, refers in zip(b["page_id"], b["url"], b["payload"], b["refers_to"], strict=True):
                if out is None:
                    system.create_dir(top, recursive=True)
                    temporary, count, size = f"{top}/.{part}-{len(done):05d}", 0, 0
                    out = system.open_output_stream(temporary)
                data = record(f"urn:page:{'null' if page is None else page}", url, payload, None if refers is None else f"urn:page:{refers}")
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= roll:
                    close()
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return rows.mapInPandas(run, WRITTEN)


def read(files: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives in column ``path``, each file read in pieces by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        def rows():
            for b in batches:
                for path in b["path"]:
                    system, at = fs.FileSystem.from_uri(path)
                    with system.open_input_stream(at, compression=None) as f:
                        for place, r in enumerate(records(iter(lambda: f.read(PIECE), b""))):  # noqa: B023
                            yield _row(path, place, r, payloads)

        yield from _frames(rows())

    return files.select("path").mapInPandas(run, RECORD)


def read_binary(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The same by Spark's own reader, for folders that Python can't open; files of up to 2 GB."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for b in batches:
                for name, data in zip(b["path"], b["content"], strict=True):
                    for place, r in enumerate(records(data[i : i + PIECE] for i in range(0, len(data), PIECE))):
                        yield _row(name, place, r, payloads)

        yield from _frames(rows())

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, RECORD)


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000, payloads: bool = False) -> DataFrame:
    """Write pages to archives in the shared folder and read them back; raises on a record that doesn't hold."""
    work = Workspace(pages.sparkSession, "warc")
    files = work.keep(write(plan(pages, page_id, url, payload, least), work.at("archives")), "files")
    back = read(files.repartition(max(1, min(files.count(), 10_000)), "path"), payloads)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("bigint")
    sound = F.when(F.col("problem").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("bad WARC record, "), F.col("problem"))))
    return back.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", sound.alias("record_type"), number(F.col("refers_to")).alias("refers_to"), "target_uri", *(["payload"] if payloads else []), "path", "place")
