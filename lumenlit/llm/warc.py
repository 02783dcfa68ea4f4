"""WARC archives: writing, normalising monolithic gzip streams, reading back.

The writer makes archives that are one gzip stream each, as many crawlers'
exports are: a warcinfo record, then responses with an HTTP message as block, and
revisits that name the record of the response they repeat. The normaliser inflates such a stream once, piece by piece,
rewrites every record as a gzip member of its own and writes a sidecar index
(tab-separated: record id, type, page id, offset, length). The reader fetches
single members by that index.

Cases: a null payload counts as empty; equal payloads of at least
``min_bytes`` bytes are kept once, in the record of the smallest page id (all
rows of that id are responses, others are revisits); rows without a page id are
responses, and a group without any page id has no revisits; every record has an
id of its own, also where rows repeat; characters that a URI can't hold are
escaped as UTF-8; an empty table gives no archive; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlit.llm.caches import tidy
from lumenlit.llm.store import AtomicFile, materialise, read_file

_PIECE = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def mark_revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int, url_col: str | None) -> DataFrame:
    """page_id, url, payload (binary), refers_to: the smallest id among equal
    payloads, for rows that are not that one; named: the row that these name.
    Only digests are grouped, and of the groups those of several rows travel to
    the pages: as a broadcast while they are few."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), (F.col(url_col) if url_col else F.lit(None)).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"), F.monotonically_increasing_id().alias("row"))
    long_enough = F.octet_length("payload") >= min_bytes
    keyed = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    once = keyed.filter(long_enough).groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("first"), F.count("*").alias("n"))
    firsts = materialise(once.filter("n > 1 and first is not null").select("digest", "first"), "warc-firsts")
    if firsts.count() <= 200_000:  # 50 bytes a row
        firsts = F.broadcast(firsts)
    other = (F.col("first.page_id") != F.col("page_id")) & long_enough
    joined = keyed.join(firsts, "digest", "left")
    return joined.select("page_id", "url", "payload", F.when(other, F.col("first.page_id")).alias("refers_to"), F.coalesce(F.col("first.row") == F.col("row"), F.lit(False)).alias("named"))


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ':'.join(map(str, parts)))}>"


def _escaped(url: str) -> str:
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)


def _wrapped(fields: list[str], block: bytes) -> bytes:
    digest = f"WARC-Block-Digest: sha1:{base32_sha1(block)}"
    return "\r\n".join(["WARC/1.1", *fields, digest, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_record(name: str, date: str) -> bytes:
    block = b"software: lumenlit\r\nformat: WARC File Format 1.1\r\n"
    return _wrapped(["WARC-Type: warcinfo", f"WARC-Record-ID: {record_id('info', name)}", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], block)


def _record(page_id, url, payload: bytes, refers_to, named: bool = True, place: str = "", date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A record of a page. The one that revisits name gets an id made from page
    and payload, so that they know it; others get one made from their place."""
    kind, digest = "response" if refers_to is None else "revisit", base32_sha1(payload)
    name = record_id("named", page_id, digest) if named else record_id(kind, place, page_id, digest)
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url:
        head.append(f"WARC-Target-URI: {_escaped(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id('named', refers_to, digest)}", f"X-Refers-To-Page: {refers_to}", f"WARC-Profile: {_PROFILE}"]
    head.append("Content-Type: application/http; msgtype=response")
    return _wrapped(head, http + payload if refers_to is None else http)


def write_monolithic(marked: DataFrame, out: str, bytes_per_file: int = 64 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives of one gzip stream each; one row (uri) per archive. A task
    holds one record at a time."""

    def write(stream):
        from pyspark import TaskContext

        part, seq, held, n, file, pack, uri = TaskContext.get().partitionId(), 0, 0, 0, None, None, ""
        made = []
        try:
            for r in (r for batch in stream for lo in range(0, batch.num_rows, 256) for r in batch.slice(lo, 256).to_pylist()):
                if file is None:
                    uri = f"{out}/raw-{part:06d}-{seq:04d}.warc.gz"
                    file = AtomicFile(uri)
                    pack, held, n = zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                    file.stream.write(pack.compress(info_record(uri.rsplit("/", 1)[1], date)))
                data = _record(r["page_id"], r["url"], r["payload"], r["refers_to"], r["named"], f"{part}-{seq}-{n}", date)
                held, n = held + len(data), n + 1
                file.stream.write(pack.compress(data))
                if held >= bytes_per_file:
                    file.stream.write(pack.flush())
                    file.__exit__(None, None, None)
                    file, seq = None, seq + 1
                    made.append(uri)
            if file is not None:
                file.stream.write(pack.flush())
                file.__exit__(None, None, None)
                file = None
                made.append(uri)
        except BaseException as e:
            if file is not None:
                file.__exit__(type(e), e, None)
            raise
        if made:
            yield pa.RecordBatch.from_pydict({"uri": made})

    return marked.mapInArrow(tidy(write), "uri string")


class _Inflated:
    """The bytes of a gzip file (of one member or several), read forwards."""

    def __init__(self, uri: str):
        self.file, self.pack, self.held, self.raw = read_file(uri), zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        while True:
            if self.pack.eof:
                self.raw = self.pack.unused_data or self.file.read(_PIECE)
                if not self.raw:
                    return False
                self.pack = zlib.decompressobj(31)
            else:
                self.raw = self.pack.unconsumed_tail or self.file.read(_PIECE)
                if not self.raw:
                    raise ValueError("the gzip stream ends early")
            data = self.pack.decompress(self.raw, _PIECE)
            if data:
                self.held += data
                return True

    def until(self, mark: bytes) -> bytes | None:
        begin = 0
        while (at := self.held.find(mark, begin)) < 0:
            begin = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held.strip():
                    raise ValueError("a record's header ends early")
                return None
        out, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return out

    def take(self, n: int):
        while n:
            if not self.held and not self._more():
                raise ValueError("a record ends early")
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def normalise_archive(uri: str, out: str, level: int = 3) -> int:
    """Rewrite one archive with a member per record, and its sidecar
    ``<out>.idx``; returns the number of records. Memory is bounded by a piece
    of 1 MB, whatever the size of the archive or of a record."""
    source, offset, n = _Inflated(uri), 0, 0
    with AtomicFile(out) as data, AtomicFile(out + ".idx") as index:
        while (head := source.until(b"\r\n\r\n")) is not None:
            head = head.lstrip(b"\r\n")
            fields = _fields(head)
            pack, size = zlib.compressobj(level, zlib.DEFLATED, 31), 0
            size += data.write(pack.compress(head))
            for piece in source.take(int(fields["content-length"]) + 4):
                size += data.write(pack.compress(piece))
            size += data.write(pack.flush())
            index.write("\t".join([fields.get("warc-record-id", ""), fields.get("warc-type", ""), fields.get("x-page-id", ""), str(offset), str(size)]).encode() + b"\n")
            offset, n = offset + size, n + 1
    return n


def normalise(archives: DataFrame, out: str) -> DataFrame:
    """Every archive (column uri) normalised; one row (uri, records) for each."""

    def run(stream):
        for batch in stream:
            for uri in batch.column(0).to_pylist():
                to = f"{out}/{uri.rsplit('/', 1)[1]}"
                yield pa.RecordBatch.from_pydict({"uri": [to], "records": [normalise_archive(uri, to)]})

    return archives.select("uri").mapInArrow(tidy(run), "uri string, records long")


def read_record(file, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Fields and block of the member at this place."""
    data = zlib.decompress(file.read_at(length, offset), 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    return fields, rest[: int(fields["content-length"])]


def read_archives(archives: DataFrame, verify: bool = True) -> DataFrame:
    """One row per record, fetched by the sidecars: page_id, url, record_type,
    payload_digest, payload_bytes, refers_to, and the payload of responses."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(stream):
        for batch in stream:
            for uri in batch.column(0).to_pylist():
                file, rows, held = read_file(uri), [], 0
                for line in read_file(uri + ".idx").read().decode().splitlines():
                    offset, length = map(int, line.split("\t")[3:5])
                    f, block = read_record(file, offset, length)
                    if f["warc-type"] not in ("response", "revisit"):
                        continue
                    if f.get("content-type", "").startswith("application/http"):
                        block = block.partition(b"\r\n\r\n")[2]
                    kind, digest = f["warc-type"], f["warc-payload-digest"].removeprefix("sha1:")
                    n = len(block) if kind == "response" else int(f["x-payload-length"])
                    if verify and kind == "response":
                        digest = base32_sha1(block)
                        if f["warc-payload-digest"] != "sha1:" + digest:
                            raise ValueError(f"{uri}: the payload at {offset} is damaged")
                    to = f.get("x-refers-to-page")
                    rows.append({"page_id": int(f["x-page-id"]) if "x-page-id" in f else None, "url": f.get("warc-target-uri"), "record_type": kind, "payload_digest": digest, "payload_bytes": n, "refers_to": int(to) if to else None, "payload": block if kind == "response" else None})
                    held += len(block)
                    if held > 16 * _PIECE or len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return archives.select("uri").mapInArrow(tidy(run), "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def warc_roundtrip(pages: DataFrame, out: str, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise them, and read every
    record back by the index. The lists of archives are kept as tables."""
    spark = pages.sparkSession
    write_monolithic(mark_revisits(pages, id_col, payload_col, min_bytes, url_col), f"{out}/raw").write.parquet(f"{out}/raw-list")
    raw = spark.read.parquet(f"{out}/raw-list")
    n = max(1, min(raw.count(), 10_000))
    normalise(raw.repartition(n, "uri"), f"{out}/warc").write.parquet(f"{out}/warc-list")
    return read_archives(spark.read.parquet(f"{out}/warc-list").repartition(n, "uri"))
