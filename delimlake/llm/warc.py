"""WARC archives in Zstandard (.warc.zst): writer and reader.

An archive starts with a skippable frame that holds a compression dictionary
(trained on the archive's own first records, or their first bytes as they are
where there is too little to train on), followed by one frame per WARC
record, all compressed with that dictionary. Records of equal payload are
written once as a response; the others are revisit records that refer to it.

Archives go to a folder that all executors share, by Arrow's file systems, under
a temporary name until they are complete: a lost or repeated task leaves no
half-written archive behind. The writer's result is a manifest of archives; the
reader turns a manifest into rows, one task taking whole archives of bounded size.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import struct
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delimlake.llm.common import attach, new_path

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

#: Compressed bytes after which an archive is closed; also bounds what a reader holds.
ARCHIVE_BYTES = 16 << 20
#: Bytes of the first records that the dictionary is trained on, and its size.
TRAINING_BYTES, DICTIONARY_BYTES = 1 << 19, 1 << 15
#: Records that training takes at least, and bytes of each that it looks at.
TRAINING_RECORDS, SAMPLE_BYTES = 16, 1 << 14
DATE = "2024-01-01T00:00:00Z"

MANIFEST = "path string, records long, bytes long"
RECORDS = (
    "path string, offset long, record_id string, record_type string, target_uri string, "
    "payload_digest string, payload_bytes long, refers_to string, payload binary"
)


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(record_id: str, uri: str, payload: bytes, sha1: bytes, refers_to: str | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of a WARC record; ValueError if its headers or lengths are wrong."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"not a header: {line[:80]!r}")
        fields[name.strip()] = value.strip()
    if missing := [x for x in REQUIRED if x not in fields]:
        raise ValueError(f"missing headers: {missing}")
    if not fields["Content-Length"].isdigit() or len(rest) != int(fields["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not agree with the record")
    block = rest[:-4]
    if fields.get("WARC-Block-Digest", "") not in ("", f"sha1:{digest32(block)}"):
        raise ValueError("block digest does not agree")
    http, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no HTTP header")
    sizes = [int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if len(sizes) != 1:
        raise ValueError("no HTTP Content-Length")
    digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != sizes[0] or digest32(payload) != digest):
        raise ValueError("payload does not agree with its length or digest")
    if kind == "revisit" and (payload or "WARC-Refers-To" not in fields):
        raise ValueError("not a revisit record")
    return {
        "record_id": fields["WARC-Record-ID"].strip("<>"),
        "record_type": kind,
        "target_uri": fields.get("WARC-Target-URI"),
        "payload_digest": digest,
        "payload_bytes": sizes[0],
        "refers_to": fields["WARC-Refers-To"].strip("<>") if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def frame_length(data, at: int) -> int:
    """Bytes of the Zstandard frame that starts at `at`, by its block headers."""
    import zstandard

    if data[at : at + 4] != FRAME_MAGIC:
        raise ValueError(f"no frame at {at}")
    pos = at + zstandard.frame_header_size(data[at : at + 18])
    last = False
    while not last:
        block = int.from_bytes(data[pos : pos + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        pos += 3 + (1 if kind == 1 else size)
        if kind == 3 or pos > len(data):
            raise ValueError(f"broken frame at {at}")
    pos += 4 * zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
    if pos > len(data):
        raise ValueError(f"broken frame at {at}")
    return pos - at


def read_archive(data: bytes):
    """(offset, fields) of every record of an archive."""
    import zstandard

    at, dictionary = 0, None
    if len(data) >= 8 and int.from_bytes(data[:4], "little") == DICTIONARY_FRAME:
        size = int.from_bytes(data[4:8], "little")
        content = data[8 : 8 + size]
        if len(content) != size:
            raise ValueError("the dictionary frame is cut off")
        if content[:4] == FRAME_MAGIC:
            content = zstandard.ZstdDecompressor().decompress(content)
        dictionary, at = zstandard.ZstdCompressionDict(content), 8 + size
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        size = frame_length(data, at)
        try:
            raw = decoder.decompress(data[at : at + size])
        except zstandard.ZstdError as e:
            raise ValueError(f"frame at {at}: {e}") from e
        yield at, parse_record(raw)
        at += size


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _Archive:
    """An archive while it is written; the records before the dictionary exists wait in memory."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.fs, self.name = _open(self.path)
        self.out = self.fs.open_output_stream(self.name + ".part", compression=None)
        self.waiting: list[bytes] | None = []
        self.waits = self.records = self.bytes = 0

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.waiting is None:
            return self.put(self.coder.compress(record))
        self.waiting.append(record)
        self.waits += len(record)
        if self.waits >= TRAINING_BYTES and len(self.waiting) >= TRAINING_RECORDS:
            self.start()

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def start(self) -> None:
        import zstandard

        options = {"level": 3, "write_checksum": True, "write_content_size": True}
        parts = [x[:SAMPLE_BYTES] for x in self.waiting]
        trained = None
        if len(parts) >= TRAINING_RECORDS:
            with contextlib.suppress(zstandard.ZstdError):  # too little to train on
                trained = zstandard.train_dictionary(DICTIONARY_BYTES, parts, k=512, d=8)
        trained = trained or zstandard.ZstdCompressionDict(b"".join(parts)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content = trained.as_bytes()
        self.put(struct.pack("<II", DICTIONARY_FRAME, len(content)) + content)
        self.coder = zstandard.ZstdCompressor(dict_data=trained, **options)
        waiting, self.waiting = self.waiting, None
        for x in waiting:
            self.put(self.coder.compress(x))

    def close(self) -> tuple[str, int, int]:
        if self.waiting is not None:
            self.start()
        self.out.close()
        self.fs.move(self.name + ".part", self.name)
        return self.path, self.records, self.bytes


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, payload (UTF-8; null html: empty),
    sha1 (hex), original (the page_id of the response, for revisits).

    Of pages with equal payloads of min_bytes or more the largest page_id is the
    original; rows that share this page_id are all responses, and so are all
    rows of payloads that only null page_ids have. A null page_id revisits.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    best = rows.groupBy("sha1").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1 and best is not null")
    revisit = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best")) & (F.length("payload") >= min_bytes)
    return attach(rows, best.drop("n"), ["sha1"]).withColumn("original", F.when(revisit, F.col("best"))).drop("best")


def record_id(page_id, sha1: str) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{sha1}"


def page_of(record: str):
    """The page_id column of a record id column."""
    return F.expr(f"try_cast(split_part({record}, ':', 3) as bigint)")


def write_archives(pages: DataFrame, folder: str | None = None, *, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per row of pages; returns the manifest (path, records, bytes), already written.

    folder must be shared by the executors; by default a new one beside Spark's
    checkpoints. Line breaks in urls are percent-encoded; a null url is empty.
    Columns other than page_id, url and html are ignored. No rows, no archive.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        target, name = fs.FileSystem.from_uri(folder)
        target.create_dir(name, recursive=True)
        done, now = [], None
        for batch in batches:
            url, payload, sha1 = (batch.column(i) for i in (1, 2, 3))
            ids, original = batch.column(0).to_pylist(), batch.column(4).to_pylist()
            for i in range(batch.num_rows):
                h = sha1[i].as_py()
                refers = None if original[i] is None else record_id(original[i], h)
                uri = (url[i].as_py() or "").replace("\r", "%0D").replace("\n", "%0A")
                now = now or _Archive(folder)
                now.add(record_bytes(record_id(ids[i], h), uri, payload[i].as_py(), bytes.fromhex(h), refers))
                if now.bytes >= archive_bytes:
                    done.append(now.close())
                    now = None
        if now:
            done.append(now.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["path", "records", "bytes"])

    rows = with_revisits(pages, min_bytes).select("page_id", "url", "payload", "sha1", "original")
    manifest = new_path(spark, "manifest")
    rows.mapInArrow(write, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def read_archives(manifest: DataFrame, *, payloads: bool = True) -> DataFrame:
    """One row a record of the archives that manifest names (column path).

    Every frame must hold one valid record, else the job fails with the archive
    and the fault. payloads=False leaves the payload column null.
    """
    n = max(1, manifest.count())

    def read(batches):
        import pyarrow as pa

        names = ["offset", "record_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

        def batch_of(path, rows):
            arrays = [pa.array([r[x] for r in rows], kind) for x, kind in zip(names, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), *arrays], names=["path", *names])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = _open(path)
                with fs.open_input_stream(name, compression=None) as f:
                    data = f.read()
                rows, held = [], 0
                try:
                    for at, fields in read_archive(data):
                        held += fields["payload_bytes"] if payloads else 0
                        rows.append(fields | {"offset": at} | ({} if payloads else {"payload": None}))
                        if held >= 8 << 20 or len(rows) >= 10_000:
                            yield batch_of(path, rows)
                            rows, held = [], 0
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
                if rows:
                    yield batch_of(path, rows)

    return manifest.select("path").repartition(n).mapInArrow(read, RECORDS)
