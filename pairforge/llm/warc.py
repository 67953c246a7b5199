"""WARC archives: write, index, and read records back by byte ranges.

Each task writes its records, one gzip member each, to files of its own in the shared folder and
returns an index row for every record: file, offset, length, URL and digest. The index is kept as a
table; reading starts from it: the selected rows are range-partitioned by file and offset, neighbouring
ranges are coalesced into one read, and the records are cut out of it.

Of records with the same payload digest the one with the smallest key is written as a response, the
others as revisits that refer to it. Null payloads count as empty, and empty payloads are equal to
each other; null URLs are written as an empty target; rows with a repeated key share a record id and
at most one of them is a response; rows with a null key are never a response if another row has the
payload. File names are new in each attempt of a task and only those of the attempt that counted are
in the index, so a lost executor leaves at most files that nobody reads.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import shared_path

FILE_BYTES = 1 << 30
GAP_BYTES = 1 << 16
READ_BYTES = 8 << 20
TASK_BYTES = 32 << 20  # compressed records that one task reads
_DATE = b"1970-01-01T00:00:00Z"  # the tables hold no time of capture
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key, url: str, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One record. A revisit has no payload; it names the length and digest of the one it stands for."""
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit")]
    head += [b"WARC-Record-ID: <urn:page:%s>" % str(key).encode(), b"WARC-Date: " + _DATE]
    head += [b"WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A").encode()]
    head += [b"WARC-Payload-Digest: sha1:" + digest.encode()]
    if refers_to is not None:
        head += [b"WARC-Profile: " + _PROFILE, b"WARC-Refers-To: <urn:page:%s>" % str(refers_to).encode()]
        head += [b"X-Payload-Length: %d" % len(payload)]
        payload = b""
    head += [b"Content-Length: %d" % len(payload)]
    return b"\r\n".join(head) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, in lower case, and payload of one record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}
    size = int(headers["content-length"])
    if len(rest) != size + 4:
        raise ValueError(f"a record of {len(rest) - 4} bytes says {size}")
    return headers, rest[:size]


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def with_types(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(id, url, payload, digest, first): ``first`` is the key of the response of this payload."""
    digested = pages.select(
        F.col(key).alias("id"),
        F.coalesce(F.col(url), F.lit("")).alias("url"),
        F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    # Only digests seen twice meet the pages again by key; the rest are responses as they are.
    firsts = digested.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return digested.join(firsts.drop("n"), "digest", "left")


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write records (id, url, payload, first) to WARC files in ``folder``; the rows of the index.

    ``first`` null or equal to ``id`` makes a response. The result is not stored: see ``archive``.
    """
    kind = dict(records.dtypes)["id"]

    def run(batches):
        filesystem, base = _place(folder)
        filesystem.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for key, url, payload, first in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "first")), strict=True):
                if out is None or at > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = filesystem.open_output_stream(f"{base}/{name}", compression=None)
                digest = digest_of(payload)
                refers_to = None if first is None or first == key else first
                member = gzip.compress(record(key, url, payload, digest, refers_to), 1, mtime=0)
                out.write(member)
                rows.append((name, at, len(member), url, digest, key))
                at += len(member)
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            names = ["file", "offset", "length", "url", "digest", "id"]
            table = dict(zip(names, map(list, columns), strict=True))
            table["id"] = pa.array(table["id"], batch.schema.field("id").type)
            table["offset"], table["length"] = pa.array(table["offset"], pa.int64()), pa.array(table["length"], pa.int64())
            yield pa.RecordBatch.from_pydict(table)
        if out is not None:
            out.close()

    schema = f"file string, offset bigint, length bigint, url string, digest string, id {kind}"
    return records.select("id", "url", "payload", "first").mapInArrow(run, schema)


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", folder: str | None = None) -> tuple[str, DataFrame]:
    """Write all pages and their index; the folder and the stored index."""
    folder = folder or shared_path(pages.sparkSession, "warc")
    write(with_types(pages, key, url, payload), f"{folder}/records").write.parquet(f"{folder}/index")
    return folder, pages.sparkSession.read.parquet(f"{folder}/index")


def coalesced(rows: list[tuple[str, int, int]]) -> list[tuple[str, int, int, list[tuple[int, int]]]]:
    """Rows (file, offset, length) in order to reads (file, begin, end, members): near ranges are read as one."""
    reads: list = []
    for file, offset, length in rows:
        last = reads[-1] if reads else None
        if last and last[0] == file and 0 <= offset - last[2] <= GAP_BYTES and offset + length - last[1] <= READ_BYTES:
            last[2] = offset + length
            last[3].append((offset, length))
        else:
            reads.append([file, offset, offset + length, [(offset, length)]])
    return [tuple(r) for r in reads]


def read(folder: str, selected: DataFrame) -> DataFrame:
    """The records that rows of the index select: record_id, url, record_type, refers_to, payload_digest, payload_bytes, payload.

    Sums up the bytes to read when called, so that every task gets about :data:`TASK_BYTES` of them.
    """

    def run(batches):
        filesystem, base = _place(f"{folder}/records")
        name, source = "", None
        for batch in batches:
            rows = list(zip(batch["file"], batch["offset"], batch["length"], strict=True))
            found = []
            for file, begin, end, members in coalesced(rows):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, filesystem.open_input_file(f"{base}/{file}")
                block = source.read_at(end - begin, begin)
                for offset, length in members:
                    headers, payload = parsed(gzip.decompress(block[offset - begin : offset - begin + length]))
                    revisit = headers["warc-type"] == "revisit"
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    if not revisit and digest != digest_of(payload):
                        raise ValueError(f"{file} at {offset}: the payload does not have its digest")
                    found.append(
                        {
                            "record_id": headers["warc-record-id"],
                            "url": headers["warc-target-uri"],
                            "record_type": headers["warc-type"],
                            "refers_to": headers.get("warc-refers-to"),
                            "payload_digest": digest,
                            "payload_bytes": int(headers["x-payload-length"]) if revisit else len(payload),
                            "payload": None if revisit else payload,
                        }
                    )
            if found:
                yield pd.DataFrame(found)
        if source is not None:
            source.close()

    schema = "record_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"
    # Ranges follow the bytes to read: the index itself is small, and by its own size it would be one task's.
    total = selected.agg(F.sum("length")).first()[0] or 0
    ranges = max(1, -(-total // TASK_BYTES))
    places = selected.select("file", "offset", "length").repartitionByRange(ranges, "file", "offset")
    ordered = places.sortWithinPartitions("file", "offset")
    return ordered.mapInPandas(run, schema)


def page_of(record_id: Column, kind: str = "bigint") -> Column:
    """The key inside a record id."""
    return F.regexp_extract(record_id, "^<urn:page:(.*)>$", 1).try_cast(kind)
