"""WARC archives: writing with an index, and reading selected records by it.

Writing keeps one response for each payload and makes the others revisits of it.
Each task streams its rows into archive files of its own, one compressed member
per record, and returns an index line per record: file, offset, length, URL and
digest. The index is written by Spark, so only the lines of tasks that succeeded
are in it; a file left over from a lost attempt is never referred to.

Reading starts from index lines: they are range-sorted by file and offset, and
neighbouring ranges become one read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegrist.session import cut_lineage, new_dir

#: A new archive file is begun beyond so many bytes.
FILE_BYTES = 256 << 20
#: Neighbouring ranges are read at once if the gap is at most so many bytes, up
#: to so many bytes in one read.
GAP_BYTES, READ_BYTES = 64 << 10, 4 << 20
DATE = "2000-01-01T00:00:00Z"

INDEX = "file string, offset bigint, length bigint, url string, digest string, id bigint, type string"


def base32(sha1_hex: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: 32 digits of five bits each."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    fives = [F.conv(F.substring(sha1_hex, 5 * k + 1, 5), 16, 10).cast("int") for k in range(8)]
    return F.concat(*[
        F.substring(alphabet, F.shiftright(v, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1))
        for v in fives for j in range(4)
    ])


def typed(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Rows to write: ``id``, ``url``, ``payload`` (null for revisits), ``digest``,
    ``refers_to`` (null for responses).

    Null html is an empty payload. Of records with equal payloads of at least
    ``min_bytes`` the one with the largest id is the response. A row without an
    id cannot be referred to and is a response only where no other one is; of
    rows that repeat an id all are responses.
    """
    rows = pages.select(
        F.col(key).cast("bigint").alias("id"), F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", base32(F.sha1("payload")))
    same = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(
        F.max("id").alias("response")
    )
    joined = rows.join(same, "digest", "left")
    revisits = (F.octet_length("payload") >= min_bytes) & ~F.col("response").eqNullSafe(F.col("id"))
    return joined.select(
        "id", "url", F.when(~revisits, F.col("payload")).alias("payload"), "digest",
        F.when(revisits, F.col("response")).alias("refers_to"),
    )


def write(rows: DataFrame, directory: str) -> DataFrame:
    """Write ``rows`` (as made by ``typed``) under ``directory``; the index."""
    directory = directory.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _Archives(directory) as archives:
            for batch in batches:
                yield pa.RecordBatch.from_pylist(
                    [archives.add(**row) for row in _rows(batch)], schema=_schema()
                )

    return cut_lineage(rows.select("id", "url", "payload", "digest", "refers_to").mapInArrow(run, INDEX))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def _schema() -> pa.Schema:
    text, number = pa.string(), pa.int64()
    return pa.schema([
        ("file", text), ("offset", number), ("length", number), ("url", text), ("digest", text),
        ("id", number), ("type", text),
    ])


class _Archives:
    """The archive files of one task attempt."""

    def __init__(self, directory: str):
        self.directory, self.out, self.at, self.file = directory, None, 0, ""

    def __enter__(self) -> _Archives:
        return self

    def __exit__(self, *_) -> None:
        if self.out:
            self.out.close()

    def add(self, id, url, payload, digest, refers_to) -> dict:
        if self.out is None or self.at >= FILE_BYTES:
            self.__exit__()
            self.file, self.at = f"{self.directory}/{uuid.uuid4().hex}.warc.gz", 0
            fs, name = pyarrow.fs.FileSystem.from_uri(self.file)
            fs.create_dir(name.rpartition("/")[0], recursive=True)
            self.out = fs.open_output_stream(name, compression=None)
        kind = "response" if payload is not None else "revisit"
        member = _member(record(kind, id, url, payload, digest, refers_to))
        self.out.write(member)
        line = dict(file=self.file, offset=self.at, length=len(member), url=url, digest=digest, id=id, type=kind)
        self.at += len(member)
        return line


def _member(raw: bytes) -> bytes:
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def record(kind: str, id: int | None, url: str | None, payload: bytes | None, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record. A response holds an HTTP message, a revisit no block."""
    block = b""
    if kind == "response":
        block = (
            b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            b"Content-Length: %d\r\n\r\n" % len(payload)
        ) + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{id} {url} {digest}")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        # Blanks and control characters would break the header line.
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if id is not None:
        head.append(f"X-Page-ID: {id}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    else:
        head.append("Content-Type: application/http; msgtype=response")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes | None]:
    """Header fields (names in lower case) and the payload of a response."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {n.lower(): v.strip() for n, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record has another length than its header says")
    if fields["warc-type"] != "response":
        return fields, None
    return fields, rest[:size].partition(b"\r\n\r\n")[2]


READ = (
    "id bigint, url string, type string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, payload binary"
)


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the selected ``index`` lines, read from their files:
    ``id``, ``url`` as in the index, ``type``, ``refers_to``, and of responses
    length, digest (computed anew and compared) and, if asked for, the payload."""
    spans = index.select("file", "offset", "length", "url")
    ordered = spans.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.to_pylist()
            for group in coalesced(lines):
                yield pa.RecordBatch.from_pylist(list(_fetched(group, payloads)), schema=_read_schema())

    return ordered.mapInArrow(run, READ)


def coalesced(lines: list[dict]) -> Iterator[list[dict]]:
    """Sorted index lines in groups to be read at once."""
    group: list[dict] = []
    for x in lines:
        if group:
            last = group[-1]
            end = last["offset"] + last["length"]
            near = x["file"] == last["file"] and x["offset"] - end <= GAP_BYTES
            if not near or x["offset"] + x["length"] - group[0]["offset"] > READ_BYTES:
                yield group
                group = []
        group.append(x)
    if group:
        yield group


def _read_schema() -> pa.Schema:
    text, number = pa.string(), pa.int64()
    return pa.schema([
        ("id", number), ("url", text), ("type", text), ("refers_to", number), ("payload_bytes", number),
        ("payload_digest", text), ("payload", pa.binary()),
    ])


def _fetched(group: list[dict], payloads: bool) -> Iterator[dict]:
    begin = group[0]["offset"]
    end = max(x["offset"] + x["length"] for x in group)
    fs, name = pyarrow.fs.FileSystem.from_uri(group[0]["file"])
    with fs.open_input_file(name) as f:
        f.seek(begin)
        block = f.read(end - begin)
    for x in group:
        at = x["offset"] - begin
        fields, payload = parsed(zlib.decompress(block[at : at + x["length"]], 31))
        out = {
            "id": _number(fields.get("x-page-id")), "url": x["url"], "type": fields["warc-type"],
            "refers_to": _number(fields.get("x-refers-to-page-id")),
            "payload_bytes": None, "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
            "payload": payload if payloads else None,
        }
        if payload is not None:
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if digest != out["payload_digest"]:
                raise ValueError(f"payload of {x['file']} at {x['offset']} does not have its digest")
            out["payload_bytes"] = len(payload)
        yield out


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def archived(pages: DataFrame, directory: str | None = None, **columns: str) -> DataFrame:
    """Write all ``pages`` to archives and read all of them back: a row per page
    with ``id``, ``url``, ``type``, ``refers_to``, ``payload_bytes`` and
    ``payload_digest``; those of a revisit are its response's. Empty tables give
    no archive and no rows."""
    spark: SparkSession = pages.sparkSession
    index = write(typed(pages, **columns), directory or new_dir(spark, "warc"))
    back = cut_lineage(read(index, payloads=False).drop("payload"))
    sizes = back.filter("type = 'response'").groupBy(F.col("payload_digest").alias("__digest")).agg(
        F.max("payload_bytes").alias("__bytes")
    )
    joined = back.join(sizes, F.col("payload_digest") == F.col("__digest"), "left")
    return joined.select(
        "id", "url", "type", "refers_to",
        F.coalesce("payload_bytes", "__bytes").alias("payload_bytes"), "payload_digest",
    )
