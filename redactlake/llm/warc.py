"""WARC archives with a two-level capture index.

Records are gzip members in one archive per task; where payloads are equal, the capture of the largest id is the
response and the others are revisits of it. The index sorts captures by reversed-host URL key and id into compressed
blocks; a sparse directory at the end of each index file holds each block's first key and place. A lookup
binary-searches the files' first keys, the file's directory and the block, and then reads one range of an archive.

Archives and index files lie in the shared folder under names of their own for every attempt, and only those that a
finished task has reported are read, so lost executors and repeated tasks do no harm.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections import OrderedDict
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.llm.common import Scratch, parallelism, pieces, small_batches, utf8

BLOCK_ENTRIES = 2000
LEVEL = 4
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_URL = re.compile(r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://(?:[^/?#@]*@)?([^/?#]*))?([^#]*)", re.S)
_RECORDS = "page_id long, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def url_key(url: str | None) -> str:
    """`com,example,blog)/path?query`: the host reversed and lower-cased, without scheme, user and fragment; null: ''."""
    if not url:
        return ""
    _, host, rest = _URL.match(url).groups()
    name, _, port = (host or "").lower().partition(":")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + (rest or "/")


def entry_key(url: str | None, page_id: int | None) -> bytes:
    """The index orders captures by it: URL key, then id (null first)."""
    key = quote(url_key(url), safe="!-~ ,)/:?&=%+;@$*'(.").replace(" ", "%20").encode()
    return key + b" " + (b"" if page_id is None else b"%020d" % (page_id + (1 << 63)))


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id)).urn}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member. refers_to None: a response."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if revisit else payload)
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": quote(url or "", safe="".join(map(chr, range(0x21, 0x7F)))),
        "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}",
        "X-Page-Id": "" if page_id is None else page_id,
        "X-Payload-Length": len(payload),
    }
    if revisit:
        head |= {"WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page-Id": refers_to, "WARC-Profile": PROFILE}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return gzip.compress(b"WARC/1.0\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


def parsed(member: bytes) -> tuple:
    """(page_id, record_type, payload or None, payload_bytes, payload_digest, refers_to) of a record."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:20]!r}")
    fields = {k: v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(fields["Content-Length"])]
    number = lambda name: int(fields[name]) if fields.get(name) else None
    if fields["WARC-Type"] == "revisit":
        return number("X-Page-Id"), "revisit", None, number("X-Payload-Length"), fields["WARC-Payload-Digest"].removeprefix("sha1:"), number("X-Refers-To-Page-Id")
    payload = block.partition(b"\r\n\r\n")[2]
    digest = sha1_base32(payload)
    if fields["WARC-Payload-Digest"] != f"sha1:{digest}":
        raise ValueError(f"payload of page {fields['X-Page-Id']} is damaged")
    return number("X-Page-Id"), "response", payload, len(payload), digest, None


def _files(root: str) -> tuple[pafs.FileSystem, str]:
    """Archives are written by Arrow's file systems, which name one scheme of Hadoop's otherwise."""
    files, path = pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", root))
    return files, path.rstrip("/")


@dataclass
class Archive:
    """Where a capture lies, and its index files as (first key, name), in order."""

    root: str
    index: list[tuple[bytes, str]]


def write(df: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", least: int = 0, block: int = BLOCK_ENTRIES) -> Archive:
    """Archives and index of a table of pages.

    Null payloads are empty; payloads under `least` bytes are always responses. Of equal payloads the rows of the
    largest id are responses; null ids never are unless all of them are null. Null URLs have the empty key. Repeated
    rows are captures of their own. Empty tables give an archive without files.
    """
    spark = df.sparkSession
    small_batches(spark, 500)
    scratch = Scratch(spark, "warc")
    files, base = _files(scratch.root)
    for sub in ("archive", "index"):
        files.create_dir(f"{base}/{sub}")
    root = scratch.root
    pages = df.select(F.col(page).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), utf8(html).alias("payload"))
    pages = pages.withColumns({"sha": F.sha1("payload"), "size": F.length("payload")})
    again = pages.where(F.col("size") >= least).groupBy("sha", "size").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = pages.join(scratch.table(again, "again"), ["sha", "size"], "left").select("page_id", "url", "payload", F.expr("CASE WHEN page_id <=> latest THEN NULL ELSE latest END").alias("refers_to"))

    def archive(batches):
        out, fs, path = None, *_files(root)
        name, at = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
        try:
            for b in pieces(batches, "payload"):
                out = out or fs.open_output_stream(f"{path}/archive/{name}", compression=None)
                rows = []
                for page_id, address, payload, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    member = record(page_id, address, payload, refers_to)
                    out.write(member)
                    rows.append((entry_key(address, page_id), name, at, len(member)))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.string(), pa.int64(), pa.int64()))], names=["key", "file", "offset", "size"])
        finally:
            if out:
                out.close()

    entries = scratch.table(joined.mapInArrow(archive, "key binary, file string, offset long, size long"), "entries")

    def index(batches):
        fs, path = _files(root)
        name, held, directory, at, out = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.idx", [], [], 0, None

        def flush(rows):
            nonlocal at
            data = zlib.compress(b"\n".join(rows))
            directory.append(b"%s\t%d\t%d" % (rows[0].partition(b"\t")[0], at, len(data)))
            out.write(data)
            at += len(data)

        for b in batches:
            if b.num_rows:
                out = out or fs.open_output_stream(f"{path}/index/{name}", compression=None)
                held += [b"%s\t%s\t%d\t%d" % (k, f.encode(), o, s) for k, f, o, s in zip(*(c.to_pylist() for c in b.columns), strict=True)]
                while len(held) >= block:
                    flush(held[:block])
                    held = held[block:]
        if out:
            if held:
                flush(held)
            tail = zlib.compress(b"\n".join(directory))
            out.write(tail + len(tail).to_bytes(8, "little"))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([directory[0].partition(b"\t")[0]], pa.binary()), pa.array([name])], names=["first", "name"])

    order = ["key", "file", "offset"]
    made = entries.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order).mapInArrow(index, "first binary, name string")
    return Archive(root, sorted((bytes(r["first"]), r["name"]) for r in scratch.table(made, "files").collect()))  # a row per task


class Reader:
    """Looks captures up. Keeps a few open archives, directories and blocks."""

    def __init__(self, archive: Archive, keep: int = 32):
        self.fs, self.path = _files(archive.root)
        self.index, self.first, self.keep = archive.index, [k for k, _ in archive.index], keep
        self.held: OrderedDict = OrderedDict()

    def _once(self, key, make):
        if key in self.held:
            self.held.move_to_end(key)
        else:
            if len(self.held) >= self.keep:
                self.held.popitem(last=False)
            self.held[key] = make()
        return self.held[key]

    def _file(self, name: str):
        return self._once(name, lambda: self.fs.open_input_file(f"{self.path}/{name}"))

    def _directory(self, name: str) -> list[list[bytes]]:
        def make():
            f = self._file(f"index/{name}")
            n = int.from_bytes(f.read_at(8, f.size() - 8), "little")
            return [x.split(b"\t") for x in zlib.decompress(f.read_at(n, f.size() - 8 - n)).split(b"\n")]

        return self._once(("directory", name), make)

    def _block(self, name: str, at: int, size: int) -> list[bytes]:
        return self._once((name, at), lambda: zlib.decompress(self._file(f"index/{name}").read_at(size, at)).split(b"\n"))

    def entries(self, key: bytes, prefix: bool = False):
        """(file, offset, size) of captures whose entry key is `key`, or begins with it."""
        hit = (lambda k: k.startswith(key)) if prefix else (lambda k: k == key)
        start = max(bisect.bisect_left(self.first, key) - 1, 0)
        for first, name in self.index[start:]:
            if first > key and not hit(first):
                return
            directory = self._directory(name)
            for first_in, at, size in directory[max(bisect.bisect_left(directory, [key]) - 1, 0) :]:
                if first_in > key and not hit(first_in):
                    return
                block = self._block(name, int(at), int(size))
                for line in block[bisect.bisect_left(block, key) :]:
                    k, file, offset, length = line.split(b"\t")
                    if hit(k):
                        yield file.decode(), int(offset), int(length)
                    elif k > key:
                        return

    def read(self, file: str, offset: int, size: int) -> tuple:
        return parsed(self._file(f"archive/{file}").read_at(size, offset))

    def captures(self, url: str) -> list[tuple]:
        """All records of a URL."""
        return [self.read(*e) for e in self.entries(entry_key(url, None), prefix=True)]


def lookup(archive: Archive, pages: DataFrame, page: str = "page_id", url: str = "url") -> DataFrame:
    """The records of the captures (page, url), each wanted one once, whatever number of rows asks for it."""
    spark: SparkSession = pages.sparkSession
    wanted = pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).cast("string").alias("url")).distinct()

    def keys(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([entry_key(u, p) for p, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.binary())], names=["key"])

    def read(batches):
        reader, last = Reader(archive), None
        kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
        names = ["page_id", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        for b in batches:
            rows, held = [], 0
            for key in b.column(0).to_pylist():
                if key == last:  # two URLs of one key
                    continue
                last = key
                for e in reader.entries(key):
                    rows.append(reader.read(*e))
                    held += rows[-1][3]
                    if held > 4 << 20:
                        yield out(rows)
                        rows, held = [], 0
            yield out(rows)

    sorted_keys = wanted.mapInArrow(keys, "key binary").repartitionByRange(parallelism(spark), "key").sortWithinPartitions("key")
    return sorted_keys.mapInArrow(read, _RECORDS)
