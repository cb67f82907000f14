"""WARC archives: a deduplicating writer and a salvage reader.

Writer: one record per page, each its own gzip member, in files of about
``FILE_BYTES``, named by partition, number and attempt.  The table of archives
that the writer returns is staged and names the files of the attempts that
counted, so what a lost or repeated attempt left behind is never read.  Of pages
with equal payloads of
``REVISIT_BYTES`` or more the largest id holds the payload; the rest become
revisit records that refer to it.

Reader: every record is checked (member, version line, header, lengths, block
digest).  After a failed check the reader searches for the next place where a
whole valid member or record begins, logs the bytes between as a quarantined
gap, and goes on.  Inside a member it searches the plain bytes for the next
version line, and logs the gap with the member's span and its inner offsets.  Of
a member of several records that is cut off, or whose compressed bytes are
damaged, it reads what can be inflated, and keeps those records that carry a
block digest and agree with it; one of a single record is a gap.  So one damaged
record costs itself alone, and damaged compressed bytes cost the rest of their
member.  Data is inflated in steps, so reading is linear in the archive.

Defined cases: null payloads are empty; a null id is written without its number
and read back as null; null urls are left out; repeated rows are written each;
digests, lengths and ids of other writers that are not in a known form are read
as null; other columns are ignored; no pages give no archive and no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.workspace import fresh_path, stage

REVISIT_BYTES = 1000
FILE_BYTES = 32 << 20
LEVEL = 4
#: Tasks that read archives at most; each reads its share of the files.
MOST_TASKS = 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"
_MAGIC, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_LINE = re.compile(rb"WARC/1\.\d+\r\n")
_NUMBER = re.compile(r"-?[0-9]{1,18}")
#: Compressed bytes inflated at once.
INFLATE = 64 << 10


def _digest(data: bytes) -> str:
    return "sha1:" + b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One uncompressed record: a response, or a revisit where ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: {_digest(payload)}",
        f"WARC-Block-Digest: {_digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + "".join(c if c > " " else "%%%02X" % ord(c) for c in url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Damaged(ValueError):
    pass


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` and where it ends; raises Damaged."""
    if not _LINE.match(data, at):
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damaged("header does not end")
    fields = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        fields[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    try:
        size = int(fields["content-length"])
    except (KeyError, ValueError):
        raise Damaged("no content length") from None
    begin, end = stop + 4, stop + 4 + size
    if size < 0 or data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("block does not end where its length says")
    block = data[begin:end]
    want = fields.get("warc-block-digest")
    if want and want != _digest(block):
        raise Damaged("block digest differs")
    return {"fields": fields, "block": block}, end + 4


def _member_at(data: bytes, at: int) -> tuple[bytes, int, bool, str]:
    """What the member holds, where it ends, whether it is whole, and if not why; of a damaged one what can be inflated."""
    unpack, out, view = zlib.decompressobj(31), [], memoryview(data)
    step, spot = INFLATE, at
    while not unpack.eof and spot < len(data):
        before = unpack.copy()
        try:
            out.append(unpack.decompress(view[spot : spot + step]))
            spot += step
        except zlib.error as e:
            if step == 1:
                return b"".join(out), spot, False, f"member: {e}"
            unpack, step = before, max(1, step // 16)  # nearer to the damage in smaller steps
    return b"".join(out), min(spot, len(data)) - len(unpack.unused_data), unpack.eof, "member is cut off"


def _inside(plain: bytes, vouched: bool = True) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(start, end, record or None, why) over the bytes of a member: records and gaps.

    Where no checksum vouches for the member, records must carry a block digest.
    """
    at, bad, why = 0, None, None
    while at < len(plain):
        try:
            one, end = parse(plain, at)
            if not vouched and "warc-block-digest" not in one["fields"]:
                raise Damaged("no digest vouches for the record")
        except Damaged as e:
            if bad is None:
                bad, why = at, str(e)
            at = plain.find(_VERSION, at + 1)
            if at < 0:
                break
            continue
        if bad is not None:
            yield bad, at, None, why
            bad = None
        yield at, end, one, None
        at = end
    if bad is not None:
        yield bad, len(plain), None, why


def _read_at(data: bytes, at: int) -> tuple[list[tuple[dict | None, str | None]], int, str | None]:
    """(record or None, why) of the member or record that begins at ``at``, where it ends, and why it is not whole."""
    if data[at : at + 3] == _MAGIC:
        plain, end, whole, reason = _member_at(data, at)
        found = [(one, why and f"{why}, in member at {at}, inner bytes {a} to {b}") for a, b, one, why in _inside(plain, whole)]
        if plain and not any(one for one, _ in found):
            raise Damaged(found[0][1] if whole else reason)
        # a damaged member of a single record is a gap, even where all the record's bytes are there
        if not whole and len(found) < 2:
            raise Damaged(reason)
        return found, end, None if whole else reason
    one, end = parse(data, at)
    return [(one, None)], end, None


def _next(data: bytes, at: int) -> int:
    spots = [x for x in (data.find(_MAGIC, at), data.find(_VERSION, at)) if x >= 0]
    return min(spots, default=len(data))


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(start, end, record or None, why) over a whole archive: records and quarantined gaps."""
    at, bad, why = 0, None, None
    while at < len(data):
        try:
            found, end, broken = _read_at(data, at)
        except Damaged as e:
            if bad is None:
                bad, why = at, str(e)
            at = _next(data, at + 1)
            continue
        if bad is not None:
            yield bad, at, None, why
            bad = None
        for one, reason in found:
            if one is not None or not broken:
                yield at, end, one, reason
        if broken:
            # its readable records are out; the rest is a gap, unless another member begins within
            bad, why = at, "; ".join([broken, *[reason for one, reason in found if one is None]])
            at = _next(data, at + 1)
            continue
        at = end
    if bad is not None:
        yield bad, len(data), None, why


def _write(folder: str, file_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        buffer: list[bytes] = []
        size = n = 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{n:04d}-{attempt}.warc.gz"
            with store.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(b"".join(buffer))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(buffer)], pa.int64()), pa.array([size], pa.int64())], ["file", "records", "bytes"])

        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(k) for k in range(4)), strict=True):
                one = member(record(page.as_py(), url.as_py(), (html.as_py() or "").encode(), refers.as_py()), level)
                buffer.append(one)
                size += len(one)
                if size >= file_bytes:
                    yield flush()
                    buffer, size, n = [], 0, n + 1
        if buffer:
            yield flush()

    return run


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write ``pages`` below ``folder``; returns the staged table (file, records, bytes) of the archives that count."""
    from pyarrow import fs

    spark = pages.sparkSession
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    base = pages.select(F.col(page_id).cast("long").alias("__id"), F.col(url).alias("__url"), F.coalesce(F.col(html), F.lit("")).alias("__html"))
    # 63 bits of a digest and the id stand for a row; the whole digest decides what is equal
    base = base.withColumn("__key", F.xxhash64("__id", "__html"))
    big = base.filter(F.octet_length("__html") >= revisit_bytes).select("__id", "__key", F.sha1(F.col("__html").cast("binary")).alias("sha"))
    last = big.groupBy("sha").agg(F.max("__id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    again = big.join(last, "sha").filter(~F.col("__id").eqNullSafe(F.col("refers_to"))).groupBy("__key").agg(F.max("refers_to").alias("refers_to"))
    rows = base.join(again.hint("shuffle_hash"), "__key", "left").select("__id", "__url", "__html", "refers_to")
    return stage(rows.mapInArrow(_write(folder, file_bytes, level), "file string, records long, bytes long"), "archives")


_NAMES = ["archive", "kind", "start", "end", "why", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
_ROWS = "archive string, kind string, start long, end long, why string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _number(value: str) -> int | None:
    return int(value) if _NUMBER.fullmatch(value) else None


def _page(value: str) -> int | None:
    return _number(value.strip("<>").removeprefix(_ID))


def _declared_digest(value: str) -> str | None:
    """Hexadecimal SHA-1 of a digest field in base 32 or 16."""
    kind, _, tail = value.partition(":")
    try:
        raw = {32: b32decode, 40: bytes.fromhex}[len(tail)](tail) if kind.lower() == "sha1" else None
    except (KeyError, ValueError):
        return None
    return raw and raw.hex()


def _described(name: str, start: int, end: int, one: dict) -> tuple:
    """The row of a record: a revisit by what it declares, any other by its own payload."""
    fields, block = one["fields"], one["block"]
    kind = fields.get("warc-type")
    head, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    place = (name, "record", start, end, None, _page(fields.get("warc-record-id", "")), fields.get("warc-target-uri"))
    refers = _page(fields.get("warc-refers-to", ""))
    if kind != "revisit":
        return (*place, len(payload), hashlib.sha1(payload).hexdigest(), kind, refers, payload)
    lengths = [x.split(b":", 1)[1].strip().decode("latin-1") for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    return (*place, _number(lengths[0]) if lengths else None, _declared_digest(fields.get("warc-payload-digest", "")), kind, refers, None)


def _rows_of(name: str, content: bytes) -> Iterator[pa.RecordBatch]:
    rows, size, schema = [], 0, pa.schema(list(zip(_NAMES, _KINDS, strict=True)))
    for start, end, one, why in salvage(content):
        rows.append((name, "gap", start, end, why, *[None] * 7) if one is None else _described(name, start, end, one))
        size += 0 if one is None else len(one["block"])
        if size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], schema=schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], schema=schema)


def _read_named(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    content = f.read()
                yield from _rows_of(name, content)

    return run


def _read_binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            yield from _rows_of(path.as_py(), content.as_py())


def read_archives(spark: SparkSession, folder: str, archives: DataFrame | None = None) -> DataFrame:
    """Records and quarantined gaps (``kind``) of the archives below ``folder``: those that ``archives`` names, or all.

    A revisit is described by the length and digest it declares, any other record by its own payload.
    """
    if archives is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", "content")
        return files.mapInArrow(_read_binary, _ROWS)
    tasks = max(1, min(archives.count(), MOST_TASKS))
    return archives.select("file").repartition(tasks).mapInArrow(_read_named(folder), _ROWS)


def query(spark, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, folder, archives).filter("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN m.last IS NULL OR m.last = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m.last <> p.page_id THEN m.last END AS refers_to
FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest AND p.payload_bytes >= 1000
"""
