"""WARC archives: writing with revisit records, and a sequential reader of any archive with one gzip member a record.

Writing: each task writes its rows as .warc.gz files, one gzip member a record, a new file after `roll_bytes`. A file gets its
name only when it is whole, so a task that runs again leaves no half archive; only files that a finished task names are read.
A record's id is a UUID from its page_id, url and payload, so that a task that runs again gives the same ids, and revisits name
the record that they refer to. The page_id itself goes in fields of our own (Page-ID, Refers-To-Page-ID).
Reading: one task an archive, read in pieces of 256 KB; zlib decompresses member after member, Content-Length frames the block,
and record order and all digests that a record states are verified (sha1, sha256 or md5, in base32 or hex); memory is bounded by a
piece, however large a record is. Records of other types (warcinfo, request, metadata ...) are read alike. The payload of
an HTTP response is what follows its header; that of all other records is the block.

Defined cases: null html is an empty payload; of equal payloads, every row with the largest page_id is a response; null ids never
win against another id; rows equal in page_id, url and payload are the same record, written again under the same id; line breaks in
a url are percent-encoded and nothing else of it is changed, a null url is left out; an empty table gives no archive and no rows;
other columns are ignored; records without a digest have digest_ok null, a revisit's digest is the one that it states.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import local_path, lookup, new_path, stage, table

PIECE = 1 << 18
ARCHIVES = "archive string, records long"
RECORDS = pa.schema(
    [
        ("archive", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("content_type", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("refers_to_id", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()),
    ]
)


def _open(folder: str):
    store, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    return store, path


def record_id(page_id, url, sha: bytes) -> str:
    """The same for rows equal in page_id, url and payload."""
    name = f"{page_id!r} {url!r} ".encode("utf-8", "surrogatepass") + sha
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(name).digest()[:16], version=5)}>"


def _record(page_id, url, payload: bytes, kept: bytes, sha: bytes, refers_to, refers_url=None) -> bytes:
    """One record; revisits hold the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + kept
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, url, sha)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha).decode()}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, refers_url, sha)}", f"Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive_writer(folder: str, roll_bytes: int, level: int):
    def write(batches):
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        out = name = None
        size = records = 0

        def close():
            out.close()
            store.move(f"{base}/{name}.part", f"{base}/{name}.warc.gz")
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}.warc.gz"], "records": [records]}, schema=pa.schema([("archive", pa.string()), ("records", pa.int64())]))

        for batch in batches:
            for page_id, url, html, refers_to, refers_url in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "refers_url")), strict=True):
                if out is None:
                    name, size, records = uuid.uuid4().hex, 0, 0
                    out = store.open_output_stream(f"{base}/{name}.part", compression=None)
                payload = (html or "").encode()
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = pack.compress(_record(page_id, url, payload, payload if refers_to is None else b"", hashlib.sha1(payload).digest(), refers_to, refers_url)) + pack.flush()
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= roll_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return write


class _Members:
    """The decompressed bytes of one gzip member after another, from a stream that is read once."""

    def __init__(self, stream):
        self.stream, self.raw, self.ended = stream, b"", False

    def start(self) -> bool:
        """Begins the next member; False at the archive's end."""
        if not self.raw:
            self.raw = self.stream.read(PIECE)
        self.unpack, self.have = zlib.decompressobj(31), b""
        return bool(self.raw)

    def more(self) -> bytes:
        """Up to one piece of the member, b"" at its end."""
        while not self.unpack.eof:
            data = self.unpack.decompress(self.unpack.unconsumed_tail or self.raw, PIECE)
            if not self.unpack.unconsumed_tail:
                self.raw = b""
            if self.unpack.eof:
                self.raw = self.unpack.unused_data
                return data
            if data:
                return data
            if not self.unpack.unconsumed_tail:
                self.raw = self.stream.read(PIECE)
                if not self.raw:
                    raise ValueError("the archive ends inside a record")
        return b""

    def until(self, mark: bytes) -> bytes:
        """The bytes up to the mark, which is passed."""
        while mark not in self.have:
            piece = self.more()
            if not piece:
                raise ValueError("a record's header has no end")
            self.have += piece
        head, _, self.have = self.have.partition(mark)
        return head

    def exactly(self, n: int):
        """The next n bytes, in pieces."""
        while n:
            if not self.have:
                self.have = self.more()
                if not self.have:
                    raise ValueError("a record is shorter than its Content-Length")
            piece, self.have = self.have[:n], self.have[n:]
            n -= len(piece)
            yield piece


def _fields(head: bytes) -> dict[str, str]:
    """A record's named fields; a line that starts with a blank goes on with the field before it."""
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:80]!r}")
    out: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in " \t" and name:
            out[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _stated(digest: str | None):
    """(algorithm, digest as bytes) of a field like sha1:ABC in base32 or hex; None for other algorithms and forms."""
    kind, _, value = (digest or "").partition(":")
    kind = kind.lower().replace("-", "")
    size = {"sha1": 20, "sha256": 32, "md5": 16}.get(kind)
    if size is None:
        return None
    try:
        raw = bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError:
        return None
    return (kind, raw) if len(raw) == size else None


def _number(text: str | None):
    return int(text) if text and text.lstrip("-").isdigit() else None


def records_of(stream):
    """The records of one archive, in order, as the fields of RECORDS (but archive). A revisit has no payload of its own: its
    payload_bytes are null, its payload_digest is the one that it states."""
    members = _Members(stream)
    while members.start():
        head = _fields(members.until(b"\r\n\r\n"))
        kind, content = head.get("warc-type", ""), head.get("content-type")
        revisit, has_http = kind == "revisit", (content or "").lower().startswith("application/http")
        whole, part = _stated(head.get("warc-block-digest")), _stated(head.get("warc-payload-digest"))
        block, payload, sha = (hashlib.new(x[0]) if x else None for x in (whole, part, ("sha1", b"")))
        size, http, in_body = 0, b"", not has_http
        for piece in members.exactly(int(head["content-length"])):
            if block:
                block.update(piece)
            if not in_body:
                http += piece
                _, mark, piece = http.partition(b"\r\n\r\n")
                if not mark:
                    continue
                in_body, http = True, b""
            for h in (payload, sha):
                if h:
                    h.update(piece)
            size += len(piece)
        if b"".join(members.exactly(4)) != b"\r\n\r\n" or members.have or members.more():
            raise ValueError("a record does not end where its Content-Length says")
        checks = [block.digest() == whole[1]] if whole else []
        if part and not revisit:
            checks.append(payload.digest() == part[1])
        digest = (part[1].hex() if part else None) if revisit else sha.hexdigest()
        yield {
            "record_id": head.get("warc-record-id"), "record_type": kind, "target_uri": head.get("warc-target-uri"), "content_type": content, "payload_bytes": None if revisit else size, "payload_digest": digest,
            "digest_ok": all(checks) if checks else None, "refers_to_id": head.get("warc-refers-to"), "page_id": _number(head.get("page-id")), "refers_to": _number(head.get("refers-to-page-id")),
        }


def archive_reader(batches):
    def flush(rows):
        return pa.RecordBatch.from_pylist(rows, schema=RECORDS)

    for batch in batches:
        for archive in batch.column("archive").to_pylist():
            store, path = _open(archive)
            rows = []
            with store.open_input_stream(path, compression=None) as stream:
                for record in records_of(stream):
                    rows.append({"archive": archive, **record})
                    if len(rows) == 4096:
                        yield flush(rows)
                        rows = []
            if rows:
                yield flush(rows)


def revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """(page_id, url, html, refers_to, refers_url): the largest page_id with the same payload of at least `least_bytes`, and the url
    of its row (the lowest of several), null for such a row itself."""
    rows = pages.select("page_id", "url", "html", F.coalesce("html", F.lit("")).cast("binary").alias("_p"))
    keyed = rows.select("page_id", "url", "html", F.when(F.length("_p") >= least_bytes, F.struct(F.sha1("_p").alias("sha"), F.length("_p").alias("n"))).alias("_key"))
    first = F.struct(F.col("page_id").isNull().alias("none"), (-F.col("page_id")).alias("back"), "url")
    groups = keyed.filter("_key is not null").groupBy("_key").agg(F.min(first).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    groups = stage(groups.select("_key", (-F.col("_first.back")).alias("_best"), F.col("_first.url").alias("_url")), "payloads")
    out = lookup(keyed, groups, ["_key"], "left").withColumn("_other", F.col("_best").isNotNull() & ~F.col("_best").eqNullSafe(F.col("page_id")))
    return out.select("page_id", "url", "html", F.when(F.col("_other"), F.col("_best")).alias("refers_to"), F.when(F.col("_other"), F.col("_url")).alias("refers_url"))


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = 64 << 20, level: int = 6, least_bytes: int = 1000) -> DataFrame:
    """Writes pages (page_id, url, html) as archives in the shared folder; returns (archive, records), staged."""
    rows = revisits(pages, least_bytes)
    return stage(rows.mapInArrow(archive_writer(local_path(folder), roll_bytes, level), ARCHIVES), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row a record, from a table with the column archive. Payload sizes of revisits come from the record that they refer to,
    where it was read too."""
    n = max(1, min(10_000, archives.count()))
    kinds = "archive string, record_id string, record_type string, target_uri string, content_type string, payload_bytes long, payload_digest string, digest_ok boolean, refers_to_id string, page_id long, refers_to long"
    rows = stage(archives.select("archive").repartition(n, "archive").mapInArrow(archive_reader, kinds), "records")
    bad = rows.filter("not digest_ok").limit(1).collect()
    if bad:
        raise ValueError(f"digest mismatch in {bad[0].archive}, record {bad[0].record_id}")
    wanted = stage(rows.filter("record_type = 'revisit' and refers_to_id is not null").select("refers_to_id").distinct(), "wanted")
    sizes = rows.filter("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to_id"), F.col("payload_bytes").alias("_full"))
    sizes = stage(lookup(sizes, wanted, ["refers_to_id"]).groupBy("refers_to_id").agg(F.max("_full").alias("_full")), "sizes")
    return lookup(rows, sizes, ["refers_to_id"], "left").withColumn("payload_bytes", F.coalesce("payload_bytes", F.when(F.col("record_type") == "revisit", F.col("_full")))).drop("_full")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
g as (select html, max(page_id) as best, count(*) as n from p where strlen(html) >= 1000 group by html)
select p.page_id, strlen(p.html) as payload_bytes, sha1(p.html) as payload_digest,
  case when g.best is null or g.best is not distinct from p.page_id then 'response' else 'revisit' end as record_type,
  case when g.best is distinct from p.page_id then g.best end as refers_to
from p left join g on p.html = g.html
"""
