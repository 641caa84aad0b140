"""WARC archives as seekable Zstandard bundles: independent frames, a seek table at the end, an index."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridcut.llm.common import stored
from gridcut.session import shared_dir

#: Bytes of records in a frame, and of records in a bundle, before the next one begins.
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 32 << 20, 3
# Fixed values of the seekable format: skippable frame, end mark.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Up to so many pages with shared payloads (some 50 bytes each) are broadcast; beyond it joins shuffle.
BROADCAST_SHARED = 500_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(name: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response record, or a revisit of the record named `refers_to`, which keeps the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Refers-To", refers_to and f"<{refers_to}>"),
        ("WARC-Profile", refers_to and PROFILE),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, bytes, int]:
    """The record at `at`: its fields, HTTP head, payload, and where the next record begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    stop = end + 4 + int(fields["Content-Length"])
    head, _, payload = data[end + 4 : stop].partition(b"\r\n\r\n")
    return fields, head, payload, stop + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


class BundleReader:
    """Random access to the frames of a bundle by its seek table."""

    def __init__(self, path: str):
        fs, inner = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        count, _, mark = struct.unpack("<IBI", self._at(size - 9, 9))
        if mark != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        rows = self._at(size - 9 - 8 * count, 8 * count)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", rows):
            self.frames.append((at, packed, plain))
            at += packed

    def _at(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def frame(self, k: int) -> bytes:
        start, packed, plain = self.frames[k]
        return zstd.ZstdDecompressor().decompress(self._at(start, packed), max_output_size=plain)

    def close(self) -> None:
        self.file.close()


class _BundleWriter:
    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        fs, inner = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        self.file = fs.open_output_stream(inner, compression=None)
        self.frames: list[tuple[int, int]] = []
        self.pending: list[bytes] = []
        self.held = self.total = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """The frame and the offset in it at which the record lies."""
        place = len(self.frames), self.held
        self.pending.append(data)
        self.held += len(data)
        self.total += len(data)
        if self.held >= FRAME_BYTES:
            self._flush()
        return place

    def _flush(self) -> None:
        if self.pending:
            packed = zstd.ZstdCompressor(level=LEVEL).compress(b"".join(self.pending))
            self.file.write(packed)
            self.frames.append((len(packed), self.held))
            self.pending, self.held = [], 0

    def close(self) -> None:
        self._flush()
        self.file.write(seek_table(self.frames))
        self.file.close()


#: Most tasks that read bundles; beyond it a task reads several one after another.
MOST_TASKS = 20_000
INDEX = "record_id string, page_id long, bundle string, frame long, offset long, length long"


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_revisit_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Writes a record for each row and returns the index (INDEX) as a stored table.

    Of rows with equal payloads (of `least_revisit_bytes` or more) the one with the smallest id is
    the response; the others are revisits of it. Only digests are grouped; a hot payload is one row
    after the map side. Pages whose payload is theirs alone are written where they are read; the
    others meet their verdict by id and digest, which no payload skews.

    Each task writes bundles of its own under `folder` (any store that pyarrow opens, which all
    executors reach). A bundle belongs to the archive once its index rows are written; what a lost
    task left behind is not in the index and never read.

    Null html is the empty payload, null urls have no target field. Null ids come after all others;
    of rows with equal id and payload one is the response if that id is the smallest. No rows give an
    empty index. Columns other than the three are not archived.
    """
    body = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").alias("url"),
        body.alias("payload"),
        F.sha1(body.cast("binary")).alias("digest"),
    )
    keys = rows.where(F.octet_length("payload") >= least_revisit_bytes).select("page_id", "digest")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    known = keys.distinct().join(first.drop("n"), "digest").withColumnsRenamed({"page_id": "k_page", "digest": "k_digest"})
    known = stored(known, "shared_payloads")
    if known.count() <= BROADCAST_SHARED:
        known = F.broadcast(known)
    met = F.col("page_id").eqNullSafe(F.col("k_page")) & (F.col("digest") == F.col("k_digest"))
    alike = Window.partitionBy("page_id", "digest").orderBy("url")
    shared = rows.join(known, met).withColumn("nth", F.row_number().over(alike))
    leads = F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("nth") == 1)
    alone = rows.join(known, met, "left_anti").select(
        "page_id", "url", "payload", F.lit(1).alias("nth"), F.lit(None).cast("long").alias("first_id"), F.lit(False).alias("again")
    )
    told = alone.unionByName(shared.select("page_id", "url", "payload", "nth", "first_id", (~leads).alias("again")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            index = []
            for page, link, text, nth, first_id, again in zip(*((x.as_py() for x in c) for c in batch.columns), strict=True):
                payload = text.encode("utf-8", "surrogatepass")
                digest = digest_of(payload)
                name = _name(page, digest, nth)
                data = record(name, link, payload, digest, _name(first_id, digest, 1) if again else None, date)
                writer = writer or _BundleWriter(folder)
                index.append((name, page, writer.path, *writer.add(data), len(data)))
                if writer.total >= BUNDLE_BYTES:
                    writer.close()
                    writer = None
            yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, x, strict=True)) for x in index], schema=_SCHEMA)
        if writer:
            writer.close()

    return stored(told.mapInArrow(run, INDEX), "warc_index")


_SCHEMA = pa.schema(
    [("record_id", pa.string()), ("page_id", pa.int64()), ("bundle", pa.string())]
    + [(k, pa.int64()) for k in ("frame", "offset", "length")]
)


def _name(page: int | None, digest: str, nth: int) -> str:
    return f"urn:page:{'' if page is None else page}:{digest}:{nth}"


def _page(name: str | None) -> int | None:
    number = (name or "::").strip("<>").split(":")[2] if name else ""
    return int(number) if number else None


def read_archives(index: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the indexed bundles, frame by frame: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, and for responses the `payload` if asked for.

    A response whose payload does not have its digest fails the job."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    schema += ", payload binary" * payloads
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + payloads]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                reader = BundleReader(path)
                for k in range(len(reader.frames)):
                    rows = [_row(*x, payloads) for x in _records(reader.frame(k))]
                    cols = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)
                reader.close()

    bundles = index.select("bundle").distinct()
    return bundles.repartition(_tasks(bundles), "bundle").mapInArrow(run, schema)


def _tasks(bundles: DataFrame) -> int:
    """A task for each bundle or a few: their paths are a small table, their contents are not, so the
    number is set and adaptive execution does not fold it."""
    return max(1, min(bundles.count(), MOST_TASKS))


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    at = 0
    while at < len(data):
        fields, head, payload, at = parse(data, at)
        yield fields, head, payload


def _row(fields: dict[str, str], head: bytes, payload: bytes, payloads: bool) -> tuple:
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and digest_of(payload) != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    length = int(re.search(rb"Content-Length: (\d+)", head)[1])
    refers = _page(fields.get("WARC-Refers-To"))
    row = (_page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), length, digest, kind, refers)
    return (*row, payload if kind == "response" else None) if payloads else row


def fetch(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(record_id, page_id, payload) of the indexed records whose page_id is in `wanted`: each bundle's
    seek table gives the frames, and only frames that hold a wanted record are read."""
    places = index.join(wanted.select("page_id").distinct(), "page_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None, None, b"")
        for batch in batches:
            out = []
            for name, page, path, k, offset, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held[0] != path:
                    if held[1]:
                        held[1].close()
                    held = (path, BundleReader(path), None, b"")
                if held[2] != k:
                    held = (path, held[1], k, held[1].frame(k))
                out.append((name, page, parse(held[3], offset)[2]))
            cols = [list(c) for c in zip(*out, strict=True)] or [[], [], []]
            kinds = [pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["record_id", "page_id", "payload"]
            )

    names = ["record_id", "page_id", "bundle", "frame", "offset", "length"]
    tasks = _tasks(places.select("bundle").distinct())
    dealt = places.select(*names).repartition(tasks, "bundle").sortWithinPartitions("bundle", "frame", "offset")
    return dealt.mapInArrow(run, "record_id string, page_id long, payload binary")


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder of the session."""
    return f"{shared_dir(spark)}/warc_{uuid.uuid4().hex}"
