"""WARC archives with dictionary-compressed records.

Pages become WARC/1.1 records: of equal payloads of at least ``min_revisit`` bytes the one of
the smallest page_id is a response and the others revisit it. An executor gathers records up
to ``archive_bytes``, trains a Zstandard dictionary on them, and writes a ``.warc.zst`` file: a
skippable frame with the (compressed) dictionary, then each record as a frame of its own. Where
training fails, the dictionary is made of the records' own bytes.

A task writes under a name of its own attempt and reports it; only files that the written manifest
lists count, so lost executors and repeated tasks leave no double records. Files
go through pyarrow's file systems, so the folder may be a local, HDFS or object-store path.

Defined results: null html is an empty payload; rows that repeat the smallest page_id with an equal
payload are responses too; a page without page_id is a response unless its payload has one
with an id; rows that repeat a page_id have records of one id; a null url is left out of the record; a payload of any size is one record; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import join_hot, new_path, short_batches, write_table

#: Fixed values of the published formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = b"\r\n"

#: Repeated payloads that are broadcast at most, about 200 MB in a task's hash table.
BROADCAST_PAYLOADS = 1_000_000
READ_BACK = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string"


def _uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page(uri: str) -> int | None:
    own = uri.strip("<>").rpartition(":")[2]
    return None if own == "none" else int(own)


def _target(url: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, refers_url: str | None, kind: str, date: str) -> bytes:
    """``size`` is that of the full payload, which a revisit doesn't hold."""
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % size, b""]
    block = BREAK.join(http) + BREAK + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_target(url)}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Refers-To-Date: {date}", f"WARC-Profile: {PROFILE}"]
        head += [] if refers_url is None else [f"WARC-Refers-To-Target-URI: {_target(refers_url)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + BREAK + block + BREAK + BREAK


def archive(records: list[bytes], dictionary_bytes: int, level: int) -> bytes:
    """A whole ``.warc.zst``; too few or too small records to train on have the last of their own bytes as a raw dictionary."""
    import zstandard

    out = io.BytesIO()
    try:
        trained = zstandard.train_dictionary(min(dictionary_bytes, max(256, sum(map(len, records)) // 100)), records, level=level)
    except zstandard.ZstdError:
        trained = zstandard.ZstdCompressionDict(b"".join(records)[-dictionary_bytes:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packed = zstandard.ZstdCompressor(level=level).compress(trained.as_bytes())
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
    one = zstandard.ZstdCompressor(level=level, dict_data=trained)
    for r in records:
        out.write(one.compress(r))
    return out.getvalue()


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive."""
    import zstandard

    dictionary, at = None, 0
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        raw, at = data[8 : 8 + size], 8 + size
        if struct.unpack_from("<I", raw)[0] == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw)
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(data[at:]), read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while line := stream.readline().rstrip(BREAK):
            key, _, value = line.decode("utf-8", "surrogatepass").partition(": ")
            head[key] = value
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != BREAK + BREAK:
            raise ValueError("a record's end is missing")
        yield head, block


def _types(pages: DataFrame, min_revisit: int) -> DataFrame:
    """pages with digest, kind, refers_to and refers_url; html is null for revisits, whose records hold none.

    What is known of repeated payloads, a row each, is broadcast up to BROADCAST_PAYLOADS of them, so html stays where it is read.
    Beyond, pages are joined by digest, frequent ones aside; html is moved then.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    sized = rows.where(F.octet_length("html") >= min_revisit).select("page_id", "url", "digest")
    known = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    first = sized.groupBy("digest").agg(known.alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    first = write_table(first.select("digest", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"), "n"), "payloads")
    if first.count() <= BROADCAST_PAYLOADS:
        typed = rows.join(F.broadcast(first), "digest", "left")
    else:
        typed = join_hot(rows, first, "digest", "n", pages.count(), "left")
    later = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    size = F.octet_length("html").cast("long").alias("size")
    when = lambda c: F.when(later, F.col(c))
    return typed.select("page_id", "url", F.when(~later, F.col("html")).alias("html"), size, "digest", when("first").alias("refers_to"), when("first_url").alias("refers_url"), F.when(later, "revisit").otherwise("response").alias("kind"))


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit: int = 100, archive_bytes: int = 16 << 20, dictionary_bytes: int = 64 << 10, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write all pages; the manifest: archive, records, bytes, raw_bytes of each file."""
    short_batches(pages.sparkSession)
    folder = folder or new_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder)

        def flush(records: list[bytes], size: int) -> pa.RecordBatch:
            name = f"part-{uuid.uuid4().hex}.warc.zst"
            data = archive(records, dictionary_bytes, level)
            where.create_dir(base, recursive=True)
            with where.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(data)
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": pa.array([len(records)], pa.int64()), "bytes": pa.array([len(data)], pa.int64()), "raw_bytes": pa.array([size], pa.int64())})

        records, size = [], 0
        for b in batches:
            for p, url, html, full, digest, first, first_url, kind in zip(*(c.to_pylist() for c in b.columns), strict=True):
                records.append(record(p, url, (html or "").encode("utf-8", "surrogatepass"), full, digest, first, first_url, kind, date))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield flush(records, size)
                    records, size = [], 0
        if records:
            yield flush(records, size)

    return write_table(_types(pages, min_revisit).mapInArrow(run, "archive string, records long, bytes long, raw_bytes long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row for every record of the manifest's archives. A response's digest and size are those of the bytes read; a revisit has them in its headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path in b.column(0).to_pylist():
                where, name = fs.FileSystem.from_uri(path)
                with where.open_input_stream(name, compression=None) as f:
                    data = f.read()
                rows = []
                for head, block in parse(data):
                    http, _, payload = block.partition(BREAK + BREAK)
                    said = int(next(x for x in http.split(BREAK) if x.lower().startswith(b"content-length:")).partition(b":")[2])
                    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].partition(":")[2]
                    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != said):
                        raise ValueError(f"{path}: damaged payload of {head['WARC-Record-ID']}")
                    rows.append((_page(head["WARC-Record-ID"]), said, digest, kind, _page(head["WARC-Refers-To"]) if kind == "revisit" else None, path))
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive"])

    paths = manifest.select("archive")
    return paths.repartition(max(1, min(10_000, manifest.count()))).mapInArrow(run, READ_BACK)
