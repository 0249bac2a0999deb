"""WARC archives: writing with revisit records, and a reader that salvages what damage leaves."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.llm import common
from quill.llm.rans import _arrow, _batch

#: Payloads below this size are always written whole.
REVISIT_BYTES = 100
#: Bytes of records, before compression, after which an archive is closed.
ARCHIVE = 8 << 20
LEVEL = 3
#: Fixed values of the format.
VERSION, GZIP = b"WARC/1.1\r\n", b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def record(kind: str, uri: str | None, page: int | None, digest: str, size: int, payload: bytes, refers: int | None = None) -> bytes:
    """One record: version line, header, block. size is the full payload's, which a revisit leaves out of its block."""
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri or "urn:none")
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", clean),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Payload-Length", str(size)),
        ("WARC-Block-CRC32", f"{zlib.crc32(payload):08x}"),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(payload))),
    ]
    if refers is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers}>"), ("WARC-Profile", PROFILE)]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + payload + b"\r\n\r\n"


def member(raw: bytes, level: int = LEVEL) -> bytes:
    """A record as a gzip member of its own."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


@dataclass
class Record:
    header: dict[str, str]
    payload: bytes

    @property
    def page(self) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", self.header.get("warc-record-id", ""))
        return int(found[1]) if found else None

    @property
    def refers(self) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", self.header.get("warc-refers-to", ""))
        return int(found[1]) if found else None

    @property
    def digest(self) -> str:
        return self.header.get("warc-payload-digest", "").removeprefix("sha256:")


@dataclass
class Salvage:
    """The records that passed their checks, and the byte gaps (first, end, why) that were put aside."""

    records: list[Record] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


def _plain(raw: bytes, at: int) -> tuple[Record, int]:
    """The record at a place in uncompressed bytes, and where it ends; ValueError if a check fails."""
    if raw[at : at + 5] != b"WARC/":
        raise ValueError("no version line")
    stop = raw.find(b"\r\n\r\n", at)
    if stop < 0:
        raise ValueError("header without end")
    header = {}
    for line in raw[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("header line without a name")
        header[name.strip().lower()] = value.strip()
    if not header.get("content-length", "").isdigit():
        raise ValueError("no content length")
    begin = stop + 4
    end = begin + int(header["content-length"])
    if raw[end : end + 4] != b"\r\n\r\n":
        raise ValueError("block doesn't end where its length says")
    payload = raw[begin:end]
    if "warc-block-crc32" in header and header["warc-block-crc32"] != f"{zlib.crc32(payload):08x}":
        raise ValueError("block checksum")
    found = Record(header, payload)
    if header.get("warc-type") == "response" and found.digest and found.digest != hashlib.sha256(payload).hexdigest():
        raise ValueError("payload digest")
    return found, end + 4


def _inflated(raw: bytes, at: int) -> tuple[bytes, int]:
    """The gzip member at a place, and where it ends; fed in pieces that grow, so that reading is linear in the archive."""
    d, view, step, out = zlib.decompressobj(31), memoryview(raw), 4096, []
    while not d.eof:
        if at >= len(raw):
            raise ValueError("member without end")
        piece = view[at : at + step]
        out.append(d.decompress(piece))
        at += len(piece)
        step = min(2 * step, 1 << 20)
    return b"".join(out), at - len(d.unused_data)


def read(raw: bytes) -> Salvage:
    """All records of an archive of gzip members, plain records, or both.

    After a failed check the bytes up to the next place where a member or a version line starts and passes all checks are
    logged as a gap, and reading goes on there. An empty archive has neither records nor gaps.
    """
    out, at, bad, why = Salvage(), 0, None, ""
    while at < len(raw):
        try:
            if raw[at : at + 3] == GZIP:
                text, end = _inflated(raw, at)
                found, inner = [], 0
                while inner < len(text):
                    one, inner = _plain(text, inner)
                    found.append(one)
            else:
                one, end = _plain(raw, at)
                found = [one]
        except (ValueError, zlib.error) as e:
            if bad is None:
                bad, why = at, str(e)
            starts = [k for k in (raw.find(GZIP, at + 1), raw.find(b"WARC/", at + 1)) if k >= 0]
            at = min(starts, default=len(raw))
            continue
        if bad is not None:
            out.gaps.append((bad, at, why))
            bad = None
        out.records += found
        at = end
    if bad is not None:
        out.gaps.append((bad, len(raw), why))
    return out


_ARCHIVES = "part int, archive int, body binary"
_DIGESTS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _write(batches: Iterable[pa.RecordBatch], size: int, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, number, out, held = TaskContext.get().partitionId(), 0, [], 0
    for b in common.rows_of(batches):
        for page, url, html, digest, refers in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            payload = (html or "").encode()
            kind = "response" if refers is None else "revisit"
            one = record(kind, url, page, digest, len(payload), payload if refers is None else b"", refers)
            out.append(member(one))
            held += len(one)
            if held >= size:
                yield _batch([(part, number, b"".join(out))], arrow)
                number, out, held = number + 1, [], 0
    if out:
        yield _batch([(part, number, b"".join(out))], arrow)


def _read_digests(batches: Iterable[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in common.rows_of(batches, 2):
        for raw in b.column(0).to_pylist():
            found = read(raw).records
            for k in range(0, len(found), 4096):
                rows = [(r.page, int(r.header["warc-payload-length"]), r.digest if r.refers is not None else hashlib.sha256(r.payload).hexdigest(), r.header["warc-type"], r.refers) for r in found[k : k + 4096]]
                yield _batch(rows, arrow)


def write(pages: DataFrame, size: int = ARCHIVE) -> DataFrame:
    """Archives (part, archive, body) of one record a row of pages (page_id, url, html), as a written table.

    Null html is an empty payload; a null url gets a placeholder. Of payloads that are equal and have at least REVISIT_BYTES
    bytes, the smallest page_id is the response and the others revisit it; rows that repeat that page_id are responses too.
    A row without a page_id is a response. An empty table gives no archives.

    Only digests are compared: the smallest page_id of each is summed up before the shuffle, and who revisits whom is joined
    back by digest without the payloads, which themselves move once, by page_id, so that a payload that a third of all pages
    share isn't gathered anywhere. An archive's bytes are a row of a Parquet table in the shared folder, for Spark has no
    sink for bare binary files.
    """
    common.ship(pages.sparkSession)
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    digest = F.sha2(F.col("html").cast("binary"), 256)
    slim, _ = common.materialise(rows.filter(F.octet_length("html") >= REVISIT_BYTES).filter("page_id is not null").select("page_id", digest.alias("digest")), "page-digests")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    shared, _ = common.materialise(first, "shared-digests")
    again, _ = common.materialise(slim.join(shared, "digest").filter("page_id <> first").select("page_id", F.col("digest").alias("same"), "first").distinct(), "revisits")
    parts = common.partitions(pages.sparkSession)
    whole = rows.withColumn("digest", digest).join(again, (rows["page_id"] == again["page_id"]) & (F.col("digest") == F.col("same")), "left").select(rows["page_id"], "url", "html", "digest", "first")
    arrow = _arrow(_ARCHIVES)
    return common.materialise(whole.mapInArrow(lambda b: _write(b, size, arrow), _ARCHIVES), "archives")[0]


def digests(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record read back; digests of responses are taken from their payloads."""
    arrow = _arrow(_DIGESTS)
    return archives.select("body").mapInArrow(lambda b: _read_digests(b, arrow), _DIGESTS)


def gaps(archives: DataFrame) -> DataFrame:
    """The quarantine log: part, archive, and the first and end byte of each gap, with the check that failed."""
    schema = "part int, archive int, first long, end long, why string"
    arrow = _arrow(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.rows_of(batches, 2):
            rows = [(p, a, *g) for p, a, raw in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True) for g in read(raw).gaps]
            if rows:
                yield _batch(rows, arrow)

    return archives.select("part", "archive", "body").mapInArrow(run, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(write(common.table(spark, sf_dir, "pages")))


ORACLE = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages
), f AS (
  SELECT digest, min(page_id) AS first FROM p WHERE n >= {REVISIT_BYTES} GROUP BY digest
)
SELECT p.page_id, p.n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN f.first IS NULL OR p.page_id IS NULL OR p.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND p.n >= {REVISIT_BYTES}
"""
