"""WARC archives in Zstandard: one frame per record, compressed with the dictionary of the leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, named, scratch_path, shuffle_width

#: Fixed values of the format: magic of the skippable frame that holds the dictionary, and of an ordinary frame.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"

DICTIONARY_BYTES = 16 << 10
SAMPLE_RECORDS = 64
SAMPLE_BYTES = 1 << 20
SHARD_BYTES = 16 << 20
#: Revisits that are broadcast to the rows; more are joined by key, which shuffles the payloads.
MOST_BROADCAST = 100_000
#: Bytes of archives that one task reads.
READ_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"

_RECORD = "record_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(text: str) -> str:
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def format_record(record_id: int | None, uri: str | None, payload: bytes, record_type: str, refers_to: int | None, date: str = DATE) -> bytes:
    """A response holds an HTTP header and the payload; a revisit holds the HTTP header alone and names its response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if record_type == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:page:{'' if record_id is None else record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_header_value(uri)}")
    if record_type == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page(urn: str) -> int | None:
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise ValueError(f"unknown record id {urn!r}")
    return int(urn[10:-1]) if urn[10:-1] else None


def parse_record(data: bytes) -> dict:
    """Validates one record: version, mandatory headers, both lengths, the end mark, and a response's payload digest."""
    head, found, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not found or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"header line without a colon: {line!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"no {name} header")
    if not headers["content-length"].isdecimal() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not agree with the record's length")
    http, found, payload = rest[:-4].partition(b"\r\n\r\n")
    if not found or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP header in the block")
    sizes = [line.partition(b":")[2].strip() for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    if len(sizes) != 1 or not sizes[0].isdigit():
        raise ValueError("no single HTTP Content-Length")
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = headers["warc-type"]
    if kind == "response":
        if int(sizes[0]) != len(payload):
            raise ValueError("HTTP Content-Length does not agree with the payload's length")
        if payload_digest(payload) != digest:
            raise ValueError("payload digest differs")
    elif kind == "revisit":
        if payload or "warc-refers-to" not in headers:
            raise ValueError("a revisit with a payload or without its response")
    else:
        raise ValueError(f"unknown record type {kind!r}")
    return {
        "record_id": _page(headers["warc-record-id"]), "uri": headers.get("warc-target-uri"), "record_type": kind,
        "refers_to": _page(headers["warc-refers-to"]) if kind == "revisit" else None,
        "payload_bytes": int(sizes[0]), "payload_digest": digest, "payload": payload,
    }


class ArchiveWriter:
    """Builds one archive in memory: dictionary frame first, then a frame for every record."""

    def __init__(self, samples: list[bytes], level: int = 3):
        try:
            self.dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples)
        except zstandard.ZstdError:  # too few or too small samples
            self.dictionary = zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=self.dictionary, write_checksum=True)
        body = self.dictionary.as_bytes()
        self.frames = [struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body]
        self.size, self.records = len(self.frames[0]), 0

    def add(self, record: bytes) -> None:
        self.frames.append(self.compressor.compress(record))
        self.size += len(self.frames[-1])
        self.records += 1


def iterate_records(data: bytes | memoryview) -> Iterator[bytes]:
    """The records of an archive, each decoded from a frame of its own with the archive's dictionary."""
    view = memoryview(data)
    if len(view) < 8:
        raise ValueError("an archive needs a leading dictionary frame")
    magic, size = struct.unpack("<II", view[:8])
    if magic != DICTIONARY_MAGIC or len(view) < 8 + size:
        raise ValueError("an archive needs a leading dictionary frame")
    body = bytes(view[8 : 8 + size])
    if body[:4] == FRAME_MAGIC:  # the dictionary itself may be compressed
        body = zstandard.ZstdDecompressor().decompress(body)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
    at = 8 + size
    while at < len(view):
        frame, parts, step = decoder.decompressobj(), [], 16 << 10
        while not frame.eof:
            if at >= len(view):
                raise ValueError("the last frame is cut off")
            fed = view[at : at + step]
            parts.append(frame.decompress(fed))
            at += len(fed) - len(frame.unused_data)
            step = 1 << 20
        yield b"".join(parts)


def write_archives(records: DataFrame, path: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes ``(record_id, uri, payload binary, record_type, refers_to)`` as archives below a shared folder.

    Each task trains the dictionary of a file on that file's own first records and starts a new file at
    ``shard_bytes``. Every attempt at a task names its files anew and a file gets its name by a rename once complete, so
    attempts never touch each other's files. Returns the manifest ``(file, records, bytes)``, one row per archive of
    the attempts that count; a folder may hold files of others, which a reader of the manifest never sees. Write the
    manifest before use: evaluating it anew writes anew.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        part, attempt, made = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        writer, waiting, held = None, [], 0

        def start() -> None:
            nonlocal writer, waiting, held
            writer = ArchiveWriter(waiting)
            for record in waiting:
                writer.add(record)
            waiting, held = [], 0

        def finish() -> pa.RecordBatch:
            nonlocal writer, made
            name = f"part-{part:06d}-{made:04d}-{attempt}.warc.zst"
            temporary = f"{folder}/.{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as out:
                for frame in writer.frames:
                    out.write(frame)
            store.move(temporary, f"{folder}/{name}")
            row = pa.RecordBatch.from_pydict({"file": [name], "records": [writer.records], "bytes": [writer.size]})
            writer, made = None, made + 1
            return row

        for batch in batches:
            for record_id, uri, payload, kind, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                record = format_record(record_id, uri, payload or b"", kind, refers_to)
                if writer is None:
                    waiting.append(record)
                    held += len(record)
                    if len(waiting) >= SAMPLE_RECORDS or held >= SAMPLE_BYTES:
                        start()
                else:
                    writer.add(record)
                if writer is not None and writer.size >= shard_bytes:
                    yield finish()
        if waiting:
            start()
        if writer is not None:
            yield finish()

    return records.select("record_id", "uri", "payload", "record_type", "refers_to").mapInArrow(run, "file string, records long, bytes long")


def _fields(with_payload: bool) -> tuple[str, list[str], list[pa.DataType]]:
    schema = _RECORD + (", payload binary" if with_payload else "")
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*[f.split() for f in schema.split(", ")], strict=True)
    return schema, list(names), [kinds[t] for t in types]


def _rows_of(file: str, content: bytes | memoryview | pa.Buffer, with_payload: bool) -> Iterator[pa.RecordBatch]:
    """The validated records of one archive, in batches of bounded size."""
    _, names, types = _fields(with_payload)
    rows: list[dict] = []
    held = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

    for at, record in enumerate(iterate_records(content)):
        try:
            rows.append(parse_record(record))
        except ValueError as e:
            raise ValueError(f"{file}, record {at}: {e}") from None
        held += len(record)
        if not with_payload:
            del rows[-1]["payload"]
        if len(rows) >= 5000 or held >= 32 << 20:
            yield out()
            rows, held = [], 0
    if rows:
        yield out()


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Reads every ``.warc.zst`` below a folder in any store that Spark opens; fails on the first invalid record."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _rows_of(file, content.as_buffer(), with_payload)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("path", "content").mapInArrow(run, _fields(with_payload)[0])


def read_manifest(manifest: DataFrame, path: str, with_payload: bool = False) -> DataFrame:
    """Reads the archives that a manifest of ``write_archives`` lists, and no others; fails on the first invalid record.

    Archives are dealt among tasks by name, about ``READ_BYTES`` to each; the driver never lists them.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for file, records in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                with store.open_input_file(f"{folder}/{file}") as source:
                    content = source.read_buffer()
                read = 0
                for rows in _rows_of(file, content, with_payload):
                    read += rows.num_rows
                    yield rows
                if read != records:
                    raise ValueError(f"{file}: {read} records where the manifest has {records}")

    total = manifest.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(shuffle_width(manifest.sparkSession), -(-total // READ_BYTES))
    return manifest.select("file", "records").repartition(tasks, "file").mapInArrow(run, _fields(with_payload)[0])


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Archives every row and reads the archives back: ``record_id, uri, record_type, refers_to, payload_bytes, payload_digest``.

    A null payload is empty. Of rows with equal payloads of at least ``least_bytes`` bytes the one with the largest id
    is a response and the others are revisits of it; rows that repeat that id with that payload are responses too. A
    null id ranks below all others; a null url gives a record without a target. An empty table gives no archive and no
    rows. Payload equality is decided by SHA-256 over digests and ids alone. Up to ``MOST_BROADCAST`` revisits are sent
    to the rows, and no payload is shuffled; more are joined by payload digest and id, which shuffles every row once.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    rows = named(pages, record_id=id_col, uri=url_col, payload=html_col).select(
        F.col("record_id").cast("long").alias("record_id"), F.col("uri").cast("string").alias("uri"), F.coalesce(F.encode(F.col("payload").cast("string"), "UTF-8"), F.lit(b"")).alias("payload")
    )
    keyed = rows.withColumn("same", F.sha2("payload", 256))
    keys = keyed.where(F.octet_length("payload") >= least_bytes).select("record_id", "same")
    kept = keys.groupBy("same").agg(F.max("record_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "keep")
    revisits = keys.join(kept, "same").where("NOT (record_id <=> keep)").select(F.col("record_id").alias("r"), F.col("same").alias("s"), F.col("keep").alias("refers_to")).distinct()
    revisits = materialise(revisits, "warc-revisits")
    if revisits.count() <= MOST_BROADCAST:
        revisits = F.broadcast(revisits)
    marked = keyed.join(revisits, F.col("record_id").eqNullSafe(F.col("r")) & (F.col("same") == F.col("s")), "left")
    records = marked.select("record_id", "uri", "payload", F.when(F.col("s").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to")
    written = materialise(write_archives(records, path), "warc-manifest")
    return read_manifest(written, path)
