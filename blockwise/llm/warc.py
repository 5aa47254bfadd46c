"""WARC archives: writing pages, and normalising archives that are one gzip stream.

``write`` puts pages into archives of about ``ARCHIVE_BYTES``, each a single gzip stream, as some crawlers leave them.
``normalise`` inflates each such stream once, from front to back, and rewrites every record as a gzip member of its own,
with a sidecar file ``.idx`` that has offset, length, type and id of each; after that any record can be read alone, which
``read`` does.  Of records with equal payloads (of ``least`` bytes or more) the one with the smallest page_id is written
in full, the others are revisits that name it.

Archives lie in the shared folder, under names made from their content: a task that is run twice leaves the same file or
an unused one, and rows only name files that their own task has finished.

A damaged archive (cut off, not gzip, a record without its length) ends the job with a ``DamagedArchive`` that names it; with
``strict=False`` its whole records are kept and the index says ``damaged`` once in the place of the rest.  Zero bytes that pad a
file are no damage.

Defined results: null html is an empty payload; null urls become ``about:blank``; a null page_id comes after all others;
of rows with the same page_id and payload one is the response; an empty table gives no archives; extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockwise import session
from blockwise.llm.common import small
from blockwise.session import stage

#: Uncompressed size at which the next archive is begun.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
#: Compressed bytes that a task reads back, and tasks that a step is dealt to at most.
READ_BYTES, MOST_TASKS = 4 << 20, 20_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DAMAGED = "damaged"
INDEX = "archive string, offset long, length long, record_type string, page_id long"


class DamagedArchive(ValueError):
    """An archive that cannot be read to its end."""


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}' if page_id is not None else f'payload:{digest}')}>"


def _uri(url: str | None) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "about:blank")


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, kind: str, refers_to: int | None) -> bytes:
    """A WARC record; a revisit has the HTTP head only."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    block = HTTP + (payload if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", "" if page_id is None else str(page_id))]
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Payload-Length", str(len(payload))),
                 ("X-Refers-To-Page-Id", "" if refers_to is None else str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    top, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = top.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise DamagedArchive("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    return fields, rest[:int(fields["Content-Length"])]


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated archive, one at a time."""
    held, need = bytearray(), 0
    for chunk in chunks:
        held += chunk
        while True:
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                lines = bytes(held[:end]).split(b"\r\n")
                size = next((x.split(b":", 1)[1].strip() for x in lines if x.lower().startswith(b"content-length:")), b"")
                if not size.isdigit():
                    raise DamagedArchive("a record does not say its length")
                need = end + 4 + int(size) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise DamagedArchive("the archive ends inside a record")


class _Archive:
    """A file that gets its name from what was written to it."""

    def __init__(self, folder: str, suffix: str):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.suffix, self.sum, self.size = suffix, hashlib.blake2b(digest_size=16), 0
        self.draft = f"{self.folder}/.draft-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.draft)

    def add(self, data: bytes) -> None:
        self.sum.update(data)
        self.out.write(data)
        self.size += len(data)

    def close(self) -> str:
        self.out.close()
        name = self.sum.hexdigest() + self.suffix
        self.fs.move(self.draft, f"{self.folder}/{name}")
        return name


def _writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = [], []
        archive, packer, n, size = None, None, 0, 0

        def close() -> None:
            nonlocal archive, n, size
            archive.add(packer.flush())
            names.append(archive.close())
            counts.append(n)
            archive, n, size = None, 0, 0

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "sha1", "kind", "refers_to"))):
                if archive is None:
                    archive, packer = _Archive(folder, ".warc.gz"), zlib.compressobj(1, zlib.DEFLATED, 31)
                data = record(*row)
                archive.add(packer.compress(data))
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    close()
        if archive is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["archive", "records"])
    return run


def with_kinds(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages as (page_id, url, payload, sha1, kind, refers_to)."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url"), payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    keys = stage(rows.where(F.octet_length("payload") >= least).select("page_id", "sha1"))
    groups = keys.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = small(groups.select(F.col("sha1").alias("_sha1"), "first"))
    repeats = small(keys.groupBy(F.col("page_id").alias("_id"), F.col("sha1").alias("_repeated")).count().where("count > 1").drop("count"))
    same = (F.col("sha1") == F.col("_repeated")) & F.col("page_id").eqNullSafe(F.col("_id"))
    numbered = rows.join(repeats, same, "left_semi").withColumn("copy", F.row_number().over(W.partitionBy("page_id", "sha1").orderBy("url")))
    rows = rows.join(repeats, same, "left_anti").withColumn("copy", F.lit(1)).unionByName(numbered)
    rows = rows.join(groups, F.col("sha1") == F.col("_sha1"), "left")
    response = F.col("_sha1").isNull() | (F.col("page_id").eqNullSafe(F.col("first")) & (F.col("copy") == 1))
    return rows.select("page_id", "url", "payload", "sha1", F.when(response, "response").otherwise("revisit").alias("kind"),
                       F.when(~response, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes archives of one gzip stream each; (archive, records) for each."""
    return stage(with_kinds(pages, least).mapInArrow(_writer(folder), "archive string, records long"))


def _inflated(stream) -> Iterator[bytes]:
    """The content of a gzip file of one member or several, in pieces of at most ``CHUNK`` bytes."""
    unpacker = None
    try:
        while data := stream.read(CHUNK):
            while data:
                if unpacker is None:
                    data = data.lstrip(b"\0")  # what pads a file after a member
                    if not data:
                        break
                    unpacker = zlib.decompressobj(31)
                yield unpacker.decompress(data, CHUNK)
                data = unpacker.unconsumed_tail
                if unpacker.eof:
                    data, unpacker = unpacker.unused_data, None
        while unpacker is not None and (rest := unpacker.decompress(unpacker.unconsumed_tail, CHUNK)):
            yield rest
    except zlib.error as e:
        raise DamagedArchive(str(e)) from None
    if unpacker is not None and not unpacker.eof:
        raise DamagedArchive("the gzip stream is cut off")


def _normaliser(folder: str, target: str, strict: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch["archive"].to_pylist():
                out, index = _Archive(target, ".warc.gz"), []
                try:
                    with source.open_input_stream(f"{path}/{name}", compression=None) as stream:
                        for data in split_records(_inflated(stream)):
                            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                            member = packer.compress(data) + packer.flush()
                            fields, _ = parse(data)
                            index.append((out.size, len(member), fields["WARC-Type"], int(fields["X-Page-Id"]) if fields.get("X-Page-Id") else None))
                            out.add(member)
                except DamagedArchive as e:
                    if strict:
                        raise DamagedArchive(f"{name}: {e}") from None
                    index.append((out.size, 0, DAMAGED, None))
                done = out.close()
                with out.fs.open_output_stream(f"{out.folder}/{done}.idx") as sidecar:
                    sidecar.write("".join("\t".join("" if v is None else str(v) for v in row) + "\n" for row in index).encode())
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*index), kinds)] if index else [pa.array([], t) for t in kinds]
                yield pa.RecordBatch.from_arrays([pa.array([done] * len(index), pa.string()), *columns],
                                                 names=["archive", "offset", "length", "record_type", "page_id"])
    return run


def normalise(archives: DataFrame, folder: str, target: str, strict: bool = True) -> DataFrame:
    """Rewrites the archives named in ``archives`` from ``folder`` to ``target`` record by record; the index of all records."""
    # an archive is a task's work: the rows are too small for Spark to spread them by itself
    spread = archives.select("archive").repartition(min(MOST_TASKS, max(1, archives.count())))
    return stage(spread.mapInArrow(_normaliser(folder, target, strict), INDEX))


def _reader(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, path = pafs.FileSystem.from_uri(folder)
        opened, file = None, None
        for batch in batches:
            rows = []
            for name, offset, length in zip(*(batch[c].to_pylist() for c in ("archive", "offset", "length"))):
                if name != opened:
                    opened, file = name, source.open_input_file(f"{path}/{name}")
                file.seek(offset)
                fields, block = parse(zlib.decompress(file.read(length), 31))
                body = block.partition(b"\r\n\r\n")[2]
                declared = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                full = fields["WARC-Type"] == "response"
                found = base64.b32encode(hashlib.sha1(body).digest()).decode() if full else declared
                if found != declared:
                    raise ValueError(f"{name} at {offset}: the payload does not have its digest")
                number = lambda k: int(fields[k]) if fields.get(k) else None
                rows.append((number("X-Page-Id"), len(body) if full else number("X-Payload-Length"), found, fields["WARC-Type"],
                             number("X-Refers-To-Page-Id"), fields["WARC-Target-URI"], body if full else None))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])
    return run


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` names, each read on its own: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url, payload (null for a revisit)."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    index = index.where(F.col("record_type") != DAMAGED)
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    places = index.select("archive", "offset", "length").repartitionByRange(min(MOST_TASKS, 1 + size // READ_BYTES), "archive", "offset")
    return places.sortWithinPartitions("archive", "offset").mapInArrow(_reader(folder), schema)


def new_folder(df: DataFrame, name: str) -> str:
    """A folder of its own in the shared one."""
    return session.new_folder(df.sparkSession, name)
