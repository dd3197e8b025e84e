"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a skippable frame at a bundle's end tells the sizes of all frames, so
that each can be reached without those before it. An index maps a record's identifier to its bundle and frame and to its offset in the
frame's content: whoever wants one record reads the seek table and one frame. A payload that is repeated is kept once, and
the records that repeat it are revisits.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import join_kept
from ..operators.shared import checkpoint, shared_folder

#: Fixed values of the seekable format: a skippable frame's mark, the seek table's mark, and its flag for no checksums.
SKIPPABLE, SEEKABLE, PLAIN = 0x184D2A5E, 0x8F92EAB1, 0
#: Bytes of records from which on a frame is closed, and of a bundle from which on another is begun; a record is never split.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 30
LEVEL = 3
#: Bytes of payload from which on a repeated one is kept once.
LEAST_PAYLOAD = 100
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Fixed value: how the standard names a revisit of an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Name space of record identifiers, which are made of a page's id and its payload's digest.
RECORDS = uuid.UUID("6d0c2f4e-58a1-4a4c-9a57-0d6f0a4c9b11")
INDEX = "record_id string, page_id long, bundle string, frame int, start long, length long"
RECORD = "record_id string, page_id long, record_type string, url string, refers_to string, payload binary, payload_bytes long, payload_digest string"


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path that a folder's name stands for, to be reached from any executor."""
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri.removeprefix("file:")


# one record


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(RECORDS, f'{page_id} {digest}')}>"


def _uri(url: str | None) -> str | None:
    """A url that fits one header line: white space and control characters are percent-encoded."""
    return None if url is None else "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, refers_to: int | None, date: str) -> tuple[str, bytes]:
    """(identifier, record): a response with its payload or, without one, a revisit of the response that refers_to has."""
    name = record_id(page_id, digest)
    block = HTTP + (payload or b"")
    fields = {
        "WARC-Type": "response" if payload is not None else "revisit", "WARC-Record-ID": name, "WARC-Date": date, "WARC-Target-URI": _uri(url), "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Profile": PROFILE if payload is None else None, "WARC-Refers-To": record_id(refers_to, digest) if payload is None else None, "X-Page-ID": page_id, "Content-Type": "application/http; msgtype=response", "Content-Length": len(block),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
    return name, head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parsed(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(fields, payload, length) of the record that begins at this offset."""
    head = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:head].decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no record begins at {at}")
    fields = dict(line.split(": ", 1) for line in lines)
    begin, n = head + 4, int(fields["Content-Length"])
    payload = data[data.index(b"\r\n\r\n", begin) + 4 : begin + n]
    return fields, payload, begin + n + 4 - at


# one bundle


class Bundle:
    """A bundle that is being written: frames one after the other, and the seek table at the end."""

    def __init__(self, path: str):
        files, at = store(path)
        self.path, self.out, self.sizes, self.written = path, files.open_output_stream(at, compression=None), [], 0
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def frame(self, content: bytes) -> int:
        """Adds a frame and returns its number."""
        packed = self.zstd.compress(content)
        self.out.write(packed)
        self.sizes.append((len(packed), len(content)))
        self.written += len(packed)
        return len(self.sizes) - 1

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), PLAIN, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class Reader:
    """A bundle that is being read: its seek table, and any frame of it."""

    def __init__(self, path: str):
        files, at = store(path)
        self.file = files.open_input_file(at)
        end = self.file.size()
        n, flags, mark = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if mark != SEEKABLE or flags & 0x7F:
            raise ValueError(f"{path} has no seek table")
        each = 12 if flags & 0x80 else 8  # with checksums or without
        sizes = list(struct.iter_unpack("<II" + "4x" * (each == 12), self.file.read_at(n * each, end - 9 - n * each)))
        self.places, begin = [], 0
        for packed, content in sizes:
            self.places.append((begin, packed, content))
            begin += packed
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        begin, packed, content = self.places[k]
        return self.zstd.decompress(self.file.read_at(packed, begin), max_output_size=content)

    def close(self) -> None:
        self.file.close()


# tables


def _bundled(folder: str, date: str, frame_bytes: int, bundle_bytes: int):
    """Writes a partition's pages to bundles and gives the index rows of each frame. An attempt's files have names of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}"
        bundle, held, rows, size, n = None, [], [], 0, 0

        def closed() -> pa.RecordBatch:
            nonlocal bundle, held, rows, size, n
            if bundle is None:
                bundle, n = Bundle(f"{name}-{n}.warc.zst"), n + 1
            k = bundle.frame(b"".join(held))
            columns = list(zip(*rows))
            out = pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array([bundle.path] * len(rows), pa.string()), pa.array([k] * len(rows), pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                names=["record_id", "page_id", "bundle", "frame", "start", "length"],
            )
            if bundle.written >= bundle_bytes:
                bundle.close()
                bundle = None
            held, rows, size = [], [], 0
            return out

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, html, digest, refers_to = (c[i] for c in columns)
                payload = None if refers_to.is_valid else html.as_buffer().to_pybytes() if html.is_valid else b""
                identifier, data = record(page_id.as_py(), url.as_py(), payload, digest.as_py(), refers_to.as_py(), date)
                rows.append((identifier, page_id.as_py(), size, len(data)))
                held.append(data)
                size += len(data)
                if size >= frame_bytes:
                    yield closed()
        if held:
            yield closed()
        if bundle is not None:
            bundle.close()

    return run


def with_heads(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """pages (page_id, url, html) with digest, and with refers_to where another page of smaller id has the same payload of least bytes or more.

    Only digests are counted. Those that come more than once are broadcast if they are few; otherwise pages are sent to their digest, and those of a frequent
    one are dealt to several tasks.
    """
    own = pages.select("page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
    long = own.where(F.octet_length("html") >= least)
    heads = long.groupBy("digest").agg(F.min("page_id").alias("head"), F.count("*").alias("n")).where("n > 1 and head is not null")
    out = join_kept(own, checkpoint(heads.select("digest", "head", "n")), ["digest"], [F.col("page_id"), F.col("url")], how="left")
    return out.select("page_id", "url", "html", "digest", F.when((F.octet_length("html") >= least) & ~F.col("page_id").eqNullSafe(F.col("head")), F.col("head")).alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) to bundles in folder and returns their index (see INDEX).

    Of rows with equal payloads of at least LEAST_PAYLOAD bytes that of the smallest page_id is a response, and the others revisit it. Each task writes its own
    rows to its own files as they come, one frame held at a time. The index is written by Spark to folder/index as one commit: it names only files
    of attempts that have succeeded, so that what a lost executor has left is never read. Executors must reach the folder by a name that
    Arrow's file systems know.

    A null html is an empty payload, and a null url leaves its field out. Rows with a null page_id are records too: they revisit a page that has an id if there is
    one, and are responses otherwise. Repeated rows are records each; rows that share the smallest page_id are all responses. page_id is an
    integer. Other columns are ignored. An empty table gives an empty index.
    """
    files, at = store(folder)
    files.create_dir(at, recursive=True)
    spark = pages.sparkSession
    with_heads(pages).mapInArrow(_bundled(folder, date, frame_bytes, bundle_bytes), INDEX).write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _read(payloads: bool):
    """Records at rows of an index that are ordered by bundle and frame; each frame is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, path, frame, content = None, None, None, b""
        for batch in batches:
            rows = list(zip(*[batch.column(c).to_pylist() for c in ("bundle", "frame", "start", "record_id")]))
            for (bundle, k), group in groupby(rows, lambda r: r[:2]):
                if bundle != path:
                    if reader:
                        reader.close()
                    reader, path, frame = Reader(bundle), bundle, None
                if k != frame:
                    content, frame = reader.frame(k), k
                out = []
                for _, _, start, identifier in group:
                    fields, payload, _ = parsed(content, start)
                    if identifier != fields["WARC-Record-ID"]:
                        raise ValueError(f"{identifier} is not at {start} of frame {k} of {bundle}")
                    full = fields["WARC-Type"] == "response"
                    digest = hashlib.sha256(payload).hexdigest() if full else fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if full and fields["WARC-Payload-Digest"] != f"sha256:{digest}":
                        raise ValueError(f"{identifier} of {bundle} has another payload than it says")
                    page_id = int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None
                    out.append((identifier, page_id, fields["WARC-Type"], fields.get("WARC-Target-URI"), fields.get("WARC-Refers-To"), payload if full and payloads else None, len(payload) if full else None, digest))
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=[f.split()[0] for f in RECORD.split(", ")])
        if reader:
            reader.close()

    return run


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records (see RECORD) that rows of an index point to; all of an index, or those of its rows that are asked for.

    Only frames that some row names are read, each once by one task. A response's digest is that of the payload read, which must be what its header says; a
    revisit has no payload, and what its header says of the digest. Without payloads these are null.
    """
    frames = index.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "start")
    return frames.select("bundle", "frame", "start", "record_id").mapInArrow(_read(payloads), RECORD)


def rebuild_index(bundles: DataFrame) -> DataFrame:
    """The index of bundles (bundle) by what is in them: a walk over all frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("bundle").to_pylist():
                reader = Reader(path)
                for k in range(len(reader.places)):
                    content, at, rows = reader.frame(k), 0, []
                    while at < len(content):
                        fields, _, n = parsed(content, at)
                        rows.append((fields["WARC-Record-ID"], int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None, path, k, at, n))
                        at += n
                    kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=[f.split()[0] for f in INDEX.split(", ")])
                reader.close()

    return bundles.select("bundle").distinct().mapInArrow(run, INDEX)


def resolved(records: DataFrame) -> DataFrame:
    """records with page_id of the response in refers_to, and each revisit's payload_bytes and payload_digest those of the response it refers to.

    A response that many revisit meets them in several tasks.
    """
    asked = records.where("refers_to is not null").groupBy("refers_to").agg(F.count("*").alias("n"))
    answers = records.where("record_type = 'response'").groupBy("record_id").agg(F.first(F.struct("page_id", "payload_bytes", "payload_digest")).alias("response"))
    answers = checkpoint(asked.join(answers, F.col("refers_to") == F.col("record_id")).select("refers_to", "n", "response"))
    out = join_kept(records, answers, ["refers_to"], [F.col("record_id"), F.col("page_id")], how="left")
    own = {c: F.when(F.col("record_type") == "response", F.col(c)).otherwise(F.col(f"response.{c}")).alias(c) for c in ("payload_bytes", "payload_digest")}
    return out.select("page_id", *own.values(), "record_type", F.col("response.page_id").alias("refers_to"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
    return resolved(checkpoint(read_records(index, payloads=False).drop("payload", "url")))


OP11_SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, coalesce(strlen(html), 0)::BIGINT AS payload_bytes FROM pages),
h AS (SELECT payload_digest, min(page_id) AS head FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN head IS NOT NULL AND page_id IS DISTINCT FROM head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM head THEN head END AS refers_to
FROM p LEFT JOIN h USING (payload_digest)
"""
