import io
import random

import pytest

from lexisweave.llm import warc as W

BIG = "".join(random.Random(1).choices("abcdé<>\r\n ", k=150000))
ROWS = [
    (1, "http://a/", "x"), (2, None, "x"), (3, "http://b/ c\r\nX: y", None), (4, "u", ""), (5, "u", BIG), (6, "u", BIG + "!"), (7, "u", BIG), (None, "u", "x"), (None, "u", "only null"),
    (8, "u", "\r\n0\r\n\r\nWARC/1.1\r\n"), (9, "u", "é\x00"), (5, "u", BIG), (7, "u", BIG), (10, "u", "y" * W.SEGMENT_BYTES),
]


def want(rows, least=0):
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = last.get(h or "") if len(data) >= least else None
        to = None if to == i else to
        out.append((i, len(data), W.digest(data), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


@pytest.mark.parametrize(("least", "segment"), [(0, W.SEGMENT_BYTES), (2, 1000), (10**9, W.SEGMENT_BYTES)])
def test_round_trip(spark, least, segment):
    pages = spark.createDataFrame([(i, u, h, "s", 1) for i, u, h in ROWS], "page_id long, url string, html string, sha string, n int")
    read = W.read_warc(W.write_warc(pages, min_revisit_bytes=least, segment_bytes=segment))
    got = sorted(map(tuple, W.resolve_revisits(read).collect()), key=str)
    assert got == want(ROWS, least)
    rows = read.collect()
    assert {r.status for r in rows} == {"ok"}
    payloads = sorted(r.payload.decode() for r in rows if r.type == "response")
    assert payloads == sorted(h or "" for i, _, h in ROWS if is_response(i, h, least))


def is_response(i, h, least):
    ids = [j for j, _, g in ROWS if (g or "") == (h or "") and j is not None]
    return len((h or "").encode()) < least or not ids or i == max(ids)


def test_empty(spark):
    manifest = W.write_warc(spark.createDataFrame([], "page_id long, url string, html string"))
    assert W.resolve_revisits(W.read_warc(manifest)).count() == 0


def test_segments_across_files(spark, tmp_path):
    parts = list(W.page_records(1, "u", BIG.encode(), None, "c", 20000))
    other = list(W.page_records(2, "u", BIG.encode(), None, "d", 20000))
    random.Random(2).shuffle(parts)
    files = {"a": parts[:3], "b": parts[3:] + other[:2], "c": other[3:] + list(W.page_records(3, None, b"short", None, "e"))}
    for name, data in files.items():
        (tmp_path / name).write_bytes(b"".join(data))
    manifest = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in files], "uri string")
    got = {r.name: r for r in W.read_warc(manifest).collect()}
    assert got[W._page_name(1)].payload.decode() == BIG and got[W._page_name(1)].payload_digest == W.digest(BIG.encode())
    assert got[W._page_name(2)].status == "segments are missing or repeated" and got[W._page_name(2)].payload is None
    assert got[W._page_name(3)].payload == b"short"


def test_faults_are_told():
    rows = [W._pieces(*r, True) for r in W.records(io.BytesIO(b"".join(W.page_records(1, "u", BIG.encode(), None, "c", 20000))))]
    assert W.reassemble(rows)["status"] == "ok"
    assert W.reassemble(rows[:-1])["status"] == "segments are missing or repeated"
    assert W.reassemble([*rows, rows[1]])["status"] == "segments are missing or repeated"
    assert W.reassemble([rows[0] | {"block": rows[0]["block"] + b"x"}, *rows[1:]])["status"] == "total length differs"
    broken = rows[1]["block"].replace(b"a", b"b")
    assert W.reassemble([rows[0], rows[1] | {"block": broken}, *rows[2:]])["status"] == "payload digest differs"


def test_transfer_coding():
    for size in (0, 1, 7, 8192, 8193, 30000):
        data = b"\r\n" * size
        assert W.unchunked(W.chunked(data)) == data
    assert W.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    assert W.http_payload(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nplain") == b"plain"
    for bad in (b"", b"5\r\nab\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            W.unchunked(bad)
