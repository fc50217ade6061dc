"""WARC archives: a segmenting writer with revisits, and a reader that reassembles continuation records."""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import binary_column, file_system, materialize, shared_dir

#: Bytes of a record's block before it is cut into segments, bytes of an HTTP chunk, and the compression level of a record.
SEGMENT_BYTES, CHUNK_BYTES, LEVEL = 32 << 10, 8 << 10, 1
#: Bytes of an archive that are given to the decompressor at a time.
STEP_BYTES = 4 << 10
DATE = "2000-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(data: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP chunked transfer coding of data."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for at in range(0, len(data), size) if (c := data[at : at + size])]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes:
    """The data of a body in chunked transfer coding; chunk extensions and trailers are dropped. ValueError if it isn't whole."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        head = data[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", head):
            raise ValueError("no chunk size")
        size = int(head, 16)
        if not size:
            return b"".join(out)
        at = end + 2
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk ends early")
        out.append(data[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP response block, transfer coding undone."""
    head, _, body = block.partition(b"\r\n\r\n")
    is_chunked = re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked[ \t]*\r?$", head)
    return unchunked(body) if is_chunked else body


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))])
    raw = b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(LEVEL, wbits=31)
    return z.compress(raw) + z.flush()


def _page_name(page_id: int | None) -> str:
    return f"<urn:lexisweave:page:{'' if page_id is None else page_id}>"


def page_records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, copy: str, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """Compressed records of one page: a response, in segments where its block is long, or a revisit without payload."""
    name = _page_name(page_id)
    target = [("WARC-Target-URI", re.sub(r"\s", "%20", url))] if url else []
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    common = [("WARC-Record-ID", name), ("X-Copy", copy), ("WARC-Date", DATE), *target, ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield _record([("WARC-Type", "revisit"), *common, ("WARC-Refers-To", _page_name(refers_to)), profile], http)
        return
    block = http + chunked(payload)
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), *common], block)
        return
    pieces = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    yield _record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", "1")], pieces[0])
    for n, piece in enumerate(pieces[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(pieces) else []
        part = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{copy}:{n}>"), ("X-Copy", copy), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(n))]
        yield _record([*part, *last], piece)


def records(stream, read_bytes: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a .warc.gz stream with one gzip member a record; field names in lower case."""
    z, buffer, raw = zlib.decompressobj(wbits=31), memoryview(b""), []
    while True:
        if not buffer:
            buffer = memoryview(stream.read(read_bytes))
            if not buffer:
                if raw:
                    raise ValueError("archive ends within a record")
                return
        part = buffer[:STEP_BYTES]  # what follows a record in its part is copied
        raw.append(z.decompress(part))
        buffer = buffer[len(part) - len(z.unused_data) :]
        if z.eof:
            z = zlib.decompressobj(wbits=31)
            head, _, rest = b"".join(raw).partition(b"\r\n\r\n")
            raw = []
            lines = head.decode("utf-8", "replace").split("\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            length = int(fields["content-length"])
            if not lines[0].startswith("WARC/") or len(rest) < length:
                raise ValueError("not a whole WARC record")
            yield fields, rest[:length]


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write a record for each row into .warc.gz files of the folder; returns their manifest (uri, records).

    The payload is the text in UTF-8 (null: empty). Of rows with equal payloads of min_revisit_bytes or more, those with the
    largest id are response records and the others revisit that id (a null id is below all others; a group with
    null ids only is all responses); rows with smaller payloads are all responses. Repeated rows are written
    as often as they occur. Other columns are ignored, and an empty table gives no records.

    Equal payloads are found through a count by SHA-1, summed before its shuffle, and only repeated ones are joined
    back: broadcast while small, else an equi-join with one row per digest whose hot keys adaptive execution splits.
    A task streams one file under a name of its own; the manifest names the files of the attempts that succeeded.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    text = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), text.alias("payload"), F.sha1(text).alias("sha"), F.octet_length(text).alias("bytes"))
    counted = rows.select("id", "sha", "bytes").where(F.col("bytes") >= min_revisit_bytes).groupBy("sha").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    groups = materialize(counted.where("n > 1 and last is not null").select("sha", "last"), "warc-groups")
    refers = F.when((F.col("bytes") >= min_revisit_bytes) & ~F.col("id").eqNullSafe(F.col("last")), F.col("last"))
    joined = rows.join(groups, "sha", "left").select("id", "url", "payload", refers.alias("refers"))

    def run(batches):
        import pyarrow as pa

        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        system, path = file_system(name)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        n = 0
        with system.open_output_stream(path, compression=None) as out:
            info = "".join(f"{k}: {v}\r\n" for k, v in (("software", "lexisweave"), ("format", "WARC File Format 1.1"))).encode()
            out.write(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], info))
            for batch in itertools.chain([first], batches):
                for page_id, url, payload, refers_to in zip(batch.column("id").to_pylist(), batch.column("url").to_pylist(), binary_column(batch, "payload"), batch.column("refers").to_pylist(), strict=True):
                    for record in page_records(page_id, url, payload.as_py(), refers_to, f"{path[-40:-8]}-{n}", segment_bytes):
                        out.write(record)
                    n += 1
        yield pa.RecordBatch.from_pydict({"uri": [name], "records": [n]})

    return materialize(joined.mapInArrow(run, "uri string, records long"), "warc-manifest")


PIECES = "key string, segment int, total long, type string, name string, url string, refers string, stated string, status string, block binary, bytes long, digest string"


def _pieces(fields: dict[str, str], block: bytes, whole: bool) -> dict:
    row = {
        "key": fields.get("warc-segment-origin-id", fields.get("warc-record-id", "")) + fields.get("x-copy", ""), "segment": int(fields.get("warc-segment-number", 0)),
        "total": int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else None, "type": fields.get("warc-type"), "name": fields.get("warc-record-id"),
        "url": fields.get("warc-target-uri"), "refers": fields.get("warc-refers-to"), "stated": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, "status": None, "block": block, "bytes": None, "digest": None,
    }
    return row if row["segment"] else _decoded(row, whole)


def _decoded(row: dict, with_payload: bool) -> dict:
    """The record with its payload decoded and checked; status tells what is wrong with it."""
    payload, status = None, "ok"
    if row["type"] != "revisit":
        try:
            payload = http_payload(row["block"])
            if row["stated"] and digest(payload) != row["stated"]:
                status = "payload digest differs"
        except ValueError as e:
            status = str(e)
    ok = payload is not None and status == "ok"
    return row | {"status": status, "block": payload if ok and with_payload else None, "bytes": len(payload) if ok else None, "digest": digest(payload) if ok else None}


def reassemble(segments: list[dict], with_payload: bool = True) -> dict:
    """One record of the segments of an origin, in any order: numbers must run from 1 without gaps to the one that states the total length."""
    segments = sorted(segments, key=lambda r: r["segment"])
    first, last = segments[0], segments[-1]
    if [r["segment"] for r in segments] != list(range(1, len(segments) + 1)) or last["total"] is None:
        return first | {"status": "segments are missing or repeated", "block": None}
    block = b"".join(r["block"] for r in segments)
    if len(block) != last["total"]:
        return first | {"status": "total length differs", "block": None}
    return _decoded(first | {"block": block}, with_payload)


def read_warc(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """(name, type, url, refers_to, stated_digest, status, payload, payload_bytes, payload_digest) of each response and revisit record of the files.

    Files (column uri) are read as streams, once, into a table in the shared folder. Records that stand alone are decoded at once and not shuffled;
    segments go, by origin identifier, to one task each that sorts them by number, verifies the total length, undoes the chunked transfer coding
    and compares the stated digest. What isn't whole has a status other than "ok" and no payload. Revisits have no payload of their own.
    """
    files = max(1, manifest.count())

    def read(batches):
        import pyarrow as pa

        kind = _arrow()
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                system, path = file_system(uri)
                with system.open_input_stream(path, compression=None) as stream:
                    rows, size = [], 0
                    for fields, block in records(stream):
                        if fields.get("warc-type") not in ("response", "revisit", "continuation"):
                            continue
                        rows.append(_pieces(fields, block, with_payload))
                        size += len(rows[-1]["block"] or b"") + 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, kind)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, kind)

    def join(batches):
        import pyarrow as pa

        kind, held = _arrow(), []
        for batch in batches:
            out = []
            for row in (r for at in range(0, batch.num_rows, 64) for r in batch.slice(at, 64).to_pylist()):
                if held and row["key"] != held[0]["key"]:
                    out.append(reassemble(held, with_payload))
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, kind)
        if held:
            yield pa.RecordBatch.from_pylist([reassemble(held, with_payload)], kind)

    pieces = materialize(manifest.select("uri").repartition(files).mapInArrow(read, PIECES), "warc-pieces")
    joined = pieces.where("segment > 0").repartition("key").sortWithinPartitions("key", "segment").mapInArrow(join, PIECES)
    return pieces.where("segment = 0").unionByName(joined).select("name", "type", "url", F.col("refers").alias("refers_to"), F.col("stated").alias("stated_digest"), "status", F.col("block").alias("payload"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"))


def _arrow():
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in PIECES.split(", "))])


def resolve_revisits(read: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records written by write_warc.

    A revisit takes its size from the response record that it refers to, joined by name and payload digest.
    """
    number = lambda c: F.regexp_extract(c, r"^<urn:lexisweave:page:(-?\d+)>$", 1).try_cast("long")
    own = read.where("type = 'response'")
    target = own.groupBy(F.col("name").alias("refers_to"), F.col("payload_digest").alias("stated_digest")).agg(F.max("payload_bytes").alias("size"))
    revisits = read.where("type = 'revisit'").select("name", "refers_to", "stated_digest").join(target, ["refers_to", "stated_digest"], "left")
    return own.select(number("name").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select(number("name").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("stated_digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), number("refers_to").alias("refers_to")))
