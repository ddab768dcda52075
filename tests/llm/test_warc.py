import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tablegrist.llm import warc as A
from tablegrist.session import new_dir

SCHEMA = "page_id long, url string, html string, digest int"
ROWS = [
    (1, "http://a/\r\nX-Page-ID: 9", "same", 0), (4, "http://b/", "same", 0), (2, None, "same", 0), (3, "http://é/ x", None, 0),
    (5, "http://c/", "", 0), (6, "http://d/", "line\r\n\r\nbreaks ü", 0), (None, "http://e/", "alone", 0), (7, "u", "big " * 400_000, 0),
    (8, "v", "again", 0), (8, "v", "again", 0),
]


def expected(rows):
    best = {}
    for i, _, h, _ in rows:
        if i is not None:
            best[h or ""] = max(i, best.get(h or "", i))
    out = []
    for i, _, h, _ in rows:
        raw, k = (h or "").encode(), best.get(h or "")
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((i, len(raw), digest, "response" if i == k else "revisit", None if i == k else k))
    return sorted(out, key=str)


def test_round_trip(spark):
    out = A.archived(spark.createDataFrame(ROWS, SCHEMA).repartition(3))
    got = sorted(((r.id, r.payload_bytes, r.payload_digest, r.type, r.refers_to) for r in out.collect()), key=str)
    assert got == expected(ROWS)


def test_payloads_of_selected_records(spark):
    index = A.write(A.typed(spark.createDataFrame(ROWS, SCHEMA)), new_dir(spark, "warc"))
    out = A.read(index.filter("id in (4, 6) and type = 'response'")).collect()
    assert {r.id: bytes(r.payload).decode() for r in out} == {4: "same", 6: "line\r\n\r\nbreaks ü"}
    assert {r.url for r in out} == {"http://b/", "http://d/"}


def test_files_are_plain_archives(spark):
    index = A.write(A.typed(spark.createDataFrame(ROWS, SCHEMA).coalesce(1)), new_dir(spark, "warc")).collect()
    path = index[0].file
    raw = gzip.decompress(open(path.removeprefix("file://"), "rb").read())
    assert raw.count(b"WARC/1.1\r\n") == len([x for x in index if x.file == path]) == len(ROWS)
    # A line break in a URL does not reach the header.
    assert b"\r\nX-Page-ID: 9" not in raw
    ends = sorted((x.offset, x.offset + x.length) for x in index)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_small_payloads_need_not_be_compared(spark):
    rows = A.typed(spark.createDataFrame(ROWS, SCHEMA), min_bytes=5)
    kinds = {r.id: r.refers_to for r in rows.collect()}
    assert kinds[1] is None and kinds[2] is None


def test_ranges_are_coalesced(monkeypatch):
    line = lambda f, o, n: {"file": f, "offset": o, "length": n}
    lines = [line("a", 0, 10), line("a", 10, 5), line("a", 10**6, 3), line("b", 0, 4), line("b", 4, 2)]
    assert [len(g) for g in A.coalesced(lines)] == [2, 1, 2]
    monkeypatch.setattr(A, "READ_BYTES", 12)
    assert [len(g) for g in A.coalesced(lines)] == [1, 1, 1, 2]


def test_damage_is_noticed():
    raw = A.record("response", 1, "u", b"text", "D" * 32, None)
    assert A.parsed(raw)[1] == b"text"
    for broken in (raw[:-1], raw[1:], raw.replace(b"Content-Length: 4", b"Content-Length: 9")):
        if broken != raw:
            with pytest.raises(ValueError):
                A.parsed(broken.replace(b"text", b"tex") if broken.startswith(b"WARC") and len(broken) == len(raw) else broken)


def test_base32_and_empty_tables(spark):
    hexes = [hashlib.sha1(bytes([i])).hexdigest() for i in range(50)]
    df = spark.createDataFrame([(h,) for h in hexes], "h string")
    got = [r.b for r in df.select(A.base32(F.col("h")).alias("b")).collect()]
    assert got == [base64.b32encode(bytes.fromhex(h)).decode() for h in hexes]
    assert A.archived(spark.createDataFrame([], SCHEMA)).collect() == []
