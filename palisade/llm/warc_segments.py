"""WARC archives: writing with segmented, chunk-encoded records, and reading with segment reassembly."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a record's block in one segment; a longer block goes on in continuation records.
SEGMENT_BYTES = 1 << 16
#: Bytes of HTTP body in one chunk of the chunked transfer framing.
CHUNK_BYTES = 1 << 13
#: Compressed bytes after which a writer starts its next archive file.
FILE_BYTES = 1 << 23

_DATE = "2024-01-01T00:00:00Z"
_CRLF = b"\r\n"


class WarcError(ValueError):
    """An archive breaks the format: a missing segment, a wrong length or digest, or bad chunk framing."""


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def to_chunks(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    out = io.BytesIO()
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out.write(b"%x\r\n" % len(part) + part + _CRLF)
    out.write(b"0\r\n\r\n")
    return out.getvalue()


def from_chunks(framed: bytes) -> bytes:
    """The payload of chunked transfer framing; chunk extensions and trailers are allowed and dropped."""
    out, at = [], 0
    while True:
        end = framed.find(_CRLF, at)
        size = re.fullmatch(rb"\s*([0-9A-Fa-f]+)\s*(?:;.*)?", framed[at:end]) if end >= 0 else None
        if not size:
            raise WarcError("bad chunk size")
        n, at = int(size[1], 16), end + 2
        if n == 0:
            if not framed.endswith(_CRLF + _CRLF):
                raise WarcError("the last chunk does not end")
            return b"".join(out)
        if framed[at + n : at + n + 2] != _CRLF:
            raise WarcError("a chunk is cut short")
        out.append(framed[at : at + n])
        at += n + 2


def http_block(head: bytes, payload: bytes | None) -> bytes:
    """An HTTP response with a chunked body, or its head alone."""
    if payload is None:
        return head + _CRLF
    return head + b"Transfer-Encoding: chunked\r\n" + _CRLF + to_chunks(payload)


def http_payload(block: bytes) -> bytes:
    """The decoded body of an HTTP response block."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("no end of the HTTP header")
    return from_chunks(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    return gzip.compress(head.encode() + block + _CRLF + _CRLF, compresslevel=4, mtime=0)


def _clean(value: str | None) -> str:
    """A header value: control characters would end the header line."""
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value or "").strip()


def records(key: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The gzip members of one page: a response, segmented if it is long, or a revisit. key makes its record id unique."""
    me, digest = f"<urn:page:{key}>", base32_sha1(payload)
    revisit = refers_to is not None
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", me), ("WARC-Date", _DATE), ("WARC-Target-URI", _clean(url)), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}:{digest}>"), ("X-Refers-To-Page", str(refers_to))]
    block = http_block(b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n", None if revisit else payload)
    if len(block) <= segment_bytes:
        yield _record(fields, block)
        return
    parts = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    yield _record([*fields, ("WARC-Segment-Number", "1")], parts[0])
    for n, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{key}:{n}>"), ("WARC-Date", _DATE), ("WARC-Target-URI", _clean(url)), ("WARC-Segment-Origin-ID", me), ("WARC-Segment-Number", str(n))]
        yield _record([*more, ("WARC-Segment-Total-Length", str(len(block)))] if n == len(parts) else more, part)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-case header fields, block) of each record of an archive of gzip members, one member at a time."""
    view = memoryview(data)
    while len(view):
        d = zlib.decompressobj(31)
        raw = d.decompress(view) + d.flush()
        if not d.eof:
            raise WarcError("a gzip member is cut short")
        view = view[len(view) - len(d.unused_data) :]
        head, gap, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not gap or not lines[0].startswith("WARC/"):
            raise WarcError("no WARC record header")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields.get("content-length", "-1"))
        if n < 0 or rest[n : n + 4] != b"\r\n\r\n":
            raise WarcError("a record's length is wrong")
        yield fields, rest[:n]


WRITTEN = "file string, n_records long, n_bytes long"


def write_archives(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages (page_id, url, payload BINARY, refers_to) as WARC files below folder; returns the manifest (see WRITTEN).

    Each task attempt writes files of its own, and only files named in the manifest count: a repeated or speculative
    attempt leaves files that nobody reads. A file ends at file_bytes, and so may a record's run of segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        out, names, done, n_bytes, n_rec, row = None, [], [], 0, 0, 0

        def close():
            nonlocal out
            out.close()
            done.append((names[-1], n_rec, n_bytes))
            out = None

        for batch in batches:
            cols = [batch[c] for c in ("page_id", "url", "payload", "refers_to")]
            for k in range(batch.num_rows):
                page_id, url, payload, refers_to = (c[k].as_py() for c in cols)
                row += 1
                # a response's identifier is its page and payload, which revisits refer to: rows alike in both write one
                # record twice, and it is read twice; what nothing refers to is told apart by its place
                key = f"{page_id}:{base32_sha1(payload or b'')}"
                if page_id is None or refers_to is not None:
                    key = f"{key}:{task.partitionId()}-{row}"
                for member in records(key, page_id, url, payload or b"", refers_to, segment_bytes):
                    if out is None:
                        names.append(f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(names):04d}.warc.gz")
                        out, n_bytes, n_rec = store.open_output_stream(f"{root}/{names[-1]}", compression=None), 0, 0
                    out.write(member)
                    n_bytes += len(member)
                    n_rec += 1
                    if n_bytes >= file_bytes:
                        close()
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["file", "n_records", "n_bytes"])

    return pages.select("page_id", "url", "payload", "refers_to").mapInArrow(run, WRITTEN)


_SEGMENT = "file string, origin string, number int, total long, kind string, page_id long, refers_to long, digest string, n_bytes long, block binary"
_RECORD = "page_id long, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def read_archives(files: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Records of archives (a DataFrame with path and content, as Spark's binaryFile reader gives), whole and checked.

    Records of one segment are decoded where they are read. Segmented ones are grouped by the origin's identifier and
    ordered by segment number; the numbers must run from 1 without a gap and the total length must agree. Then the chunked
    framing is decoded, and the payload's SHA-1 and length are compared with the header. Anything wrong raises WarcError.
    With keep_payload=False the checked payload itself is left out.
    """
    seg_schema, rec_schema = pa.schema([("file", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("n_bytes", pa.int64()), ("block", pa.binary())]), pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def whole(kind, page_id, refers_to, digest, n_bytes, block):
        payload = None
        if kind == "response":
            payload = http_payload(block)
            if base32_sha1(payload) != digest or len(payload) != n_bytes:
                raise WarcError(f"page {page_id}: the payload isn't what its header says")
        return page_id, kind, payload if keep_payload else None, n_bytes, digest, refers_to

    def number(fields, name):
        return int(fields[name]) if name in fields else None

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for f, block in parse(content.as_py()):
                    kind = f["warc-type"]
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    origin = f["warc-segment-origin-id"] if kind == "continuation" else f["warc-record-id"]
                    k = number(f, "warc-segment-number")
                    row = [path.as_py(), origin, k, number(f, "warc-segment-total-length"), kind, number(f, "x-page-id"), number(f, "x-refers-to-page"), f.get("warc-payload-digest", "").removeprefix("sha1:"), number(f, "x-payload-length"), block]
                    if k is None:  # complete here: only its results go on
                        row = row[:4] + list(whole(*row[4:]))
                        row = [None, None, None, None, row[5], row[4], row[9], row[8], row[7], row[6]]
                    rows.append(row)
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), seg_schema, strict=True)], schema=seg_schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), seg_schema, strict=True)], schema=seg_schema)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        names = seg_schema.names

        def flat():
            for batch in batches:
                yield from zip(*(batch[c].to_pylist() for c in names), strict=True)

        for origin, group in groupby(flat(), key=lambda r: r[1]):
            # several runs with one origin (a page written twice) follow each other by number; equal numbers go to different runs
            runs: list[list[tuple]] = []
            for r in group:
                for run in runs:
                    if run[-1][2] == r[2] - 1:
                        run.append(r)
                        break
                else:
                    runs.append([r])
            rows = []
            for run in runs:
                if run[0][2] != 1 or run[0][4] == "continuation" or run[-1][3] is None:
                    raise WarcError(f"{origin}: a segment is missing")
                block = b"".join(r[9] for r in run)
                if len(block) != run[-1][3]:
                    raise WarcError(f"{origin}: the total length is wrong")
                rows.append(whole(*run[0][4:9], block))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), rec_schema, strict=True)], schema=rec_schema)

    from palisade.llm.common import stored

    parsed = stored(files.select("path", "content").mapInArrow(segments, _SEGMENT), "segments")
    single = parsed.filter("number IS NULL").select("page_id", F.col("kind").alias("record_type"), F.col("block").alias("payload"), F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "refers_to")
    many = parsed.filter("number IS NOT NULL").repartition("origin").sortWithinPartitions("origin", "number", "file")
    return single.unionByName(many.mapInArrow(assemble, _RECORD))


def plan_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with payload (UTF-8, null: empty) and refers_to: the smallest page_id with an equal payload of
    at least min_bytes, or null where the page has that id itself. A null page_id is always a response of its own.
    """
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    key = F.struct(F.sha1("payload").alias("h"), F.octet_length("payload").alias("n"))
    low = p.filter(F.octet_length("payload") >= min_bytes).groupBy(key.alias("k")).agg(F.min("page_id").alias("low"), F.count("page_id").alias("c")).filter("c > 1").select(F.col("k.h").alias("_h"), F.col("k.n").alias("_n"), "low")
    out = p.join(low, (F.sha1("payload") == F.col("_h")) & (F.octet_length("payload") == F.col("_n")), "left")
    return out.select("page_id", "url", "payload", F.when(F.col("page_id") > F.col("low"), F.col("low")).alias("refers_to"))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write every page's record, read the archives back and return page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload; a null url an empty target; rows that share the smallest page_id of a payload are all
    responses; an empty table gives no archive and no row. Payloads of any length are segmented, so no record's block in a
    file exceeds SEGMENT_BYTES. spark.checkpoint.dir must be a folder that pyarrow's file systems can write.
    """
    from palisade.llm.common import stored, work_dir

    spark = pages.sparkSession
    folder = f"{work_dir(spark)}/warc"
    manifest = stored(write_archives(plan_revisits(pages, min_bytes), folder), "manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    # files of attempts that didn't count are filtered by name
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "content")
    files = files.join(manifest.select("file"), F.element_at(F.split("path", "/"), -1) == F.col("file"), "left_semi")
    return read_archives(files, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
d AS (SELECT page_id, n, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1) FOR i IN range(32)], '') AS digest FROM h)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id > min(page_id) OVER (PARTITION BY digest, n) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > min(page_id) OVER (PARTITION BY digest, n) THEN min(page_id) OVER (PARTITION BY digest, n) END AS refers_to
FROM d
"""
