"""WARC archives: written, normalised, and read back by offset.

``write`` makes archives the way many crawls come, as one gzip stream a file, which
can only be read from its beginning. ``normalise`` inflates each stream once, in
chunks, and writes every record as a gzip member of its own, with a sidecar index of
offsets; ``read`` opens members at those offsets and nothing else of a file.

Tasks write files under names of their own and return them; only files named in a
written manifest count, so a task that runs again does no harm. Files are opened with
``pyarrow.fs``, in any store it knows.
"""

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbwait.session import written

LEAST = 1000
FILE_BYTES = 64 << 20
_CHUNK = 1 << 20
_DATE = "2020-01-01T00:00:00Z"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def classified(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``page_id``, ``url``, ``payload`` (null for a revisit), ``payload_bytes``,
    ``payload_digest`` (hex SHA-1), ``record_type`` and ``refers_to``.

    Of equal payloads of at least ``least`` bytes the one with the largest page_id is
    the response, repeated rows with that id included; a page without an id is only
    one if none of them has any. A null html is an empty payload.
    """
    rows = pages.selectExpr(
        "cast(page_id as bigint) as page_id",
        "cast(url as string) as url",
        "cast(coalesce(html, '') as binary) as payload",
    ).selectExpr("*", "cast(octet_length(payload) as bigint) as payload_bytes", "sha1(payload) as payload_digest")
    many = (
        rows.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 and top is not null")
        .drop("copies")
    )
    again = "coalesce(top is not null and not page_id <=> top, false)"
    return rows.join(many, "payload_digest", "left").selectExpr(
        "page_id",
        "url",
        f"if({again}, null, payload) as payload",
        "payload_bytes",
        "payload_digest",
        f"if({again}, 'revisit', 'response') as record_type",
        f"if({again}, top, null) as refers_to",
    )


def _uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page(uri: str | None) -> int | None:
    number = (uri or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def record(row: dict) -> bytes:
    """One record: WARC header, HTTP header, and the payload unless a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    block = http.encode() + (row["payload"] or b"")
    head = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": _uri(row["page_id"]),
        "WARC-Date": _DATE,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode(),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if row["url"]:
        head["WARC-Target-URI"] = "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in row["url"])
    if row["record_type"] == "revisit":
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = _uri(row["refers_to"])
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def write(records: DataFrame, folder: str, most: int = FILE_BYTES) -> DataFrame:
    """Write the records as archives of about ``most`` bytes, each one gzip stream, and
    return their paths, as a written table."""

    def run(batches):
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        out = None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, size, pack = f"{uuid.uuid4().hex}.warc.gz", 0, zlib.compressobj(6, zlib.DEFLATED, 31)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                made = record(row)
                out.write(pack.compress(made))
                size += len(made)
                if size >= most:
                    out.write(pack.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"file": [name]})
        if out is not None:
            out.write(pack.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name]})

    return written(records.mapInArrow(run, "file string"), "warc_files")[0]


def split(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a stream of WARC bytes, each with its closing line ends. Holds a
    record and a chunk at a time."""
    held, need = bytearray(), None
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + _length(bytes(held[:end])) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError("the archive ends within a record")


def _length(head: bytes) -> int:
    return int(_fields(head)["content-length"])


def _fields(head: bytes) -> dict[str, str]:
    return {
        k.strip().lower(): v.strip()
        for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])
    }


def _inflated(stream) -> Iterator[bytes]:
    """The contents of one or more gzip members, in chunks of bounded size."""
    unpack = zlib.decompressobj(31)
    while data := stream.read(_CHUNK):
        while data:
            yield unpack.decompress(data, _CHUNK)
            data = unpack.unconsumed_tail
            if unpack.eof:
                data = unpack.unused_data
                unpack = zlib.decompressobj(31)


def normalise(files: DataFrame, folder: str, into: str) -> DataFrame:
    """Rewrite archives of one stream below ``folder`` so that every record is a gzip
    member, below ``into``, each with a sidecar ``.idx`` of JSON lines (offset, length,
    record_id, record_type). Returns the new names, as a written table."""

    def run(batches):
        (store, base), (target, to) = _open(folder), _open(into)
        target.create_dir(to, recursive=True)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                new, at = f"{uuid.uuid4().hex}.warc.gz", 0
                with (
                    store.open_input_stream(f"{base}/{name}", compression=None) as source,
                    target.open_output_stream(f"{to}/{new}", compression=None) as out,
                    target.open_output_stream(f"{to}/{new}.idx", compression=None) as index,
                ):
                    for made in split(_inflated(source)):
                        head = _fields(made[: made.index(b"\r\n\r\n")])
                        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = pack.compress(made) + pack.flush()
                        out.write(member)
                        line = {
                            "file": new,
                            "offset": at,
                            "length": len(member),
                            "record_id": head["warc-record-id"],
                            "record_type": head["warc-type"],
                        }
                        index.write(json.dumps(line).encode() + b"\n")
                        at += len(member)
                yield pa.RecordBatch.from_pydict({"file": [new]})

    spread = files.repartition(max(1, files.count()))  # a task for each file, however short its name
    return written(spread.mapInArrow(run, "file string"), "warc_members")[0]


_INDEX = "file string, offset long, length long, record_id string, record_type string"
_RECORDS = (
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long"
)


def index(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """The sidecar entries of the files named."""
    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    entries = spark.read.schema(_INDEX).option("pathGlobFilter", "*.idx").json(folder)
    return entries.join(files, "file", "left_semi")


def read(entries: DataFrame, folder: str, tasks: int) -> DataFrame:
    """The records at index entries, each member opened at its offset, by as many tasks.
    A response's bytes and digest are those of the payload read, and must agree with
    its header."""

    def run(batches):
        store, base = _open(folder)
        name, source = None, None
        for batch in batches:
            rows = []
            for entry in batch.to_pylist():
                if entry["file"] != name:
                    name = entry["file"]
                    source = store.open_input_file(f"{base}/{name}")
                member = source.read_at(entry["length"], entry["offset"])
                rows.append(parsed(zlib.decompress(member, 31)))
                if len(rows) >= 256:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("payload", pa.binary()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
        ]
    )
    laid = entries.repartition(max(1, tasks), "file").sortWithinPartitions("file", "offset")
    return laid.mapInArrow(run, _RECORDS)


def parsed(made: bytes) -> dict:
    """A record's fields and payload."""
    head, _, rest = made.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    size = int(_fields(http)["content-length"])
    revisit = fields["warc-type"] == "revisit"
    if not revisit:
        size, stated, digest = len(body), (size, digest), hashlib.sha1(body).hexdigest()
        if stated != (size, digest):
            raise ValueError(f"record {fields['warc-record-id']} differs from its header")
    return {
        "page_id": _page(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "payload": None if revisit else body,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": _page(fields.get("warc-refers-to")),
    }


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages as archives below ``folder``, normalise them, and read all records."""
    raw, members = f"{folder}/raw", f"{folder}/members"
    files = normalise(write(classified(pages), raw), raw, members)
    return read(index(pages.sparkSession, files, members), members, files.count())
