"""WARC archives: a writer with payload deduplication and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import held, staged, staged_path

RECORDS = (
    "file string, offset long, length long, kind string, reason string, record_type string, page_id long, url string, "
    "refers_to long, payload_bytes long, payload_digest string, payload binary"
)
#: Bytes of a page, and how many pages up to that length one archive file holds: no file has more than about 256 MB,
#: or one page that is larger by itself.
FILE_PAGES = ((64 << 10, 4096), (4 << 20, 64), (None, 1))
#: Payloads below this many bytes are always written.
LEAST_DUPLICATE = 100
#: Bytes of a gzip member that are unfolded at a time, and that are fed for that; bytes of a name in its header at most.
UNFOLDED, FED, NAME_BYTES = 1 << 24, 1 << 16, 1024
#: Bytes of a record's headers at most, and the digests that are checked. Records with others are not judged by them.
HEAD_BYTES, DIGESTS = 1 << 20, frozenset({"md5", "sha1", "sha256", "sha512"})
_CRLF = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write_warc(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", file_pages: tuple[tuple[int | None, int], ...] = FILE_PAGES) -> None:
    """Writes one WARC 1.1 record per row of pages (page_id, url, html) to files under path.

    Of records with equal payloads of LEAST_DUPLICATE bytes or more, those with the smallest page_id are responses
    and the others revisit it, without a payload. The duplicates are found over (digest, page_id) alone. Spark's
    own text writer writes the files, pages of like length together, so a lost task leaves no half-written archive behind and any store will do.

    Null html counts as empty; a null url is left out; a null page_id is written as `null` and never the one
    that others refer to unless no other has the payload. Control characters in a url are percent-encoded.
    An empty table gives archives without records. Extra columns are ignored.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).withColumn("n", F.octet_length("html")).withColumn("digest", F.sha2("html", 256))
    groups = rows.filter(F.col("n") >= LEAST_DUPLICATE).groupBy(F.unhex("digest").alias("sha")).agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    firsts = staged(groups.filter("copies > 1 AND first IS NOT NULL").select("sha", "first"), "warc-firsts")
    # a small table of firsts is broadcast by its size on disk, else the join is shuffled and AQE splits hot digests
    marked = rows.join(firsts, F.unhex("digest") == F.col("sha"), "left").withColumn("refers", F.expr("CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first AND n >= %d THEN first END" % LEAST_DUPLICATE))

    def line(name: str, value) -> F.Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))

    uri = F.lit("<urn:page:")
    here = F.concat(uri, F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"))
    url = F.expr("aggregate(array('%', '\\r', '\\n', '\\t'), url, (u, c) -> replace(u, c, concat('%', hex(c))))")
    http = F.concat(F.lit("HTTP/1.1 200 OK" + _CRLF), line("Content-Type", F.lit("text/html; charset=UTF-8")), line("Content-Length", F.col("n").cast("string")), F.lit(_CRLF))
    revisit = F.col("refers").isNotNull()
    block = F.when(revisit, F.col("http")).otherwise(F.concat("http", "html"))
    head = F.concat(
        F.lit("WARC/1.1" + _CRLF),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", here),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", F.concat(uri, F.col("refers").cast("string"), F.lit(">"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit(_CRLF),
    )
    records = marked.withColumn("http", http).withColumn("block", block).select("n", F.concat(head, "block", F.lit(_CRLF)).alias("value"))
    least, longest = -1, rows.agg(F.max("n")).first()[0] or 0
    for most, pages_a_file in file_pages:
        if least >= longest:  # no page is so long
            break
        own = records.filter((F.col("n") > least) & (F.lit(True) if most is None else F.col("n") <= most))
        own.select("value").write.mode("append").option("lineSep", _CRLF).option("maxRecordsPerFile", pages_a_file).text(path)
        least = most


@dataclass
class Found:
    """A record, or a gap of bytes that no valid record covers."""

    offset: int
    length: int
    kind: str
    reason: str | None = None
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    payload_bytes: int = 0


_VERSION = re.compile(rb"WARC/\d\.\d\r\n")
_CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n")


def _headers(lines: bytes) -> dict[str, str]:
    """Names in lower case, and values; a line that begins with white space goes on with the one before."""
    out = {}
    for x in re.sub(r"\r\n[ \t]+", " ", lines.decode("utf-8")).split("\r\n"):
        name, colon, value = x.partition(":")
        if not colon:
            raise ValueError("header line without a colon")
        out[name.strip().lower()] = value.strip()
    return out


class Ends:
    """The next end of headers from a place on. Places are asked for in ascending order mostly, so the bytes are searched once."""

    def __init__(self, data: bytes):
        self.data, self.since, self.found = data, 0, -2

    def after(self, at: int) -> int:
        """-1 if there is none."""
        if self.found == -2 or at < self.since or -1 < self.found < at:
            self.since, self.found = at, self.data.find(b"\r\n\r\n", at)
        return self.found


def _record(data: bytes, at: int, ends: Ends) -> tuple[Found, int]:
    """The record at this place and where it ends; ValueError if a check fails."""
    version = _VERSION.match(data, at)
    if not version:
        raise ValueError("no version line")
    end = ends.after(at)
    if end < 0 or end - at > HEAD_BYTES:
        raise ValueError("headers have no end")
    if _VERSION.search(data, version.end(), end + 2):
        raise ValueError("another record begins among the headers")
    headers = _headers(data[version.end() : end])
    if not headers.get("content-length", "").isdigit():
        raise ValueError("no content length")
    start = end + 4
    stop = start + int(headers["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record doesn't end where its length says")
    block, size = data[start:stop], None
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        cut = block.find(b"\r\n\r\n")
        if cut < 0:
            raise ValueError("HTTP headers have no end")
        payload = block[cut + 4 :]
        size = _headers(block[block.find(b"\r\n") + 2 : cut]).get("content-length")
    kind, digest = headers.get("warc-type"), headers.get("warc-payload-digest", "")
    if kind != "revisit":
        if size is not None and size != str(len(payload)):
            raise ValueError("payload is shorter or longer than its length says")
        name, _, want = digest.partition(":")
        if want and (name := name.strip().lower().replace("-", "")) in DIGESTS:
            got = hashlib.new(name, payload)
            if want.lower() != got.hexdigest() and want.upper() != base64.b32encode(got.digest()).decode():
                raise ValueError("payload digest differs")
    return Found(at, stop + 4 - at, "record", None, headers, payload, int(size) if size else len(payload)), stop + 4


def _deflated(data: bytes, at: int) -> int:
    """Where the gzip header at this place ends; ValueError if it has none of usual size."""
    flags, end = data[at + 3 : at + 4], at + 10
    if not flags or flags[0] & 0xE0:
        raise ValueError("no gzip header")
    if flags[0] & 4:
        end += 2 + int.from_bytes(data[end : end + 2], "little")
    for bit in (8, 16):  # a name and a comment, each up to a zero byte
        if flags[0] & bit:
            end = data.find(b"\0", end, end + NAME_BYTES) + 1
            if not end:
                raise ValueError("name in the gzip header has no end")
    return end + (2 if flags[0] & 2 else 0)


def _member(data: bytes, at: int) -> tuple[list[Found], int]:
    """The records of the gzip member at this place and where it ends; ValueError if a check fails."""
    fed, inside, rest = _deflated(data, at), bytearray(), memoryview(data)
    unzip = zlib.decompressobj(31)
    chunk = rest[at:fed]
    try:
        while not unzip.eof:
            got = unzip.decompress(chunk, UNFOLDED)
            if not inside and got and not _VERSION.match(got):
                raise ValueError("no version line in the member")  # of what is no archive no more is unfolded
            inside += got
            chunk = unzip.unconsumed_tail
            if not chunk and not unzip.eof:
                chunk, fed = rest[fed : fed + FED], fed + FED
                if not chunk and not got:
                    raise ValueError("member is cut off")
    except zlib.error as e:
        raise ValueError(f"damaged member: {e}") from None
    stop = min(fed, len(data)) - len(unzip.unused_data)
    inside = bytes(inside)
    ends = Ends(inside)
    found, pos = [], 0
    while pos < len(inside):
        record, pos = _record(inside, pos, ends)
        record.offset, record.length = at, stop - at
        found.append(record)
    if not found:
        raise ValueError("empty member")
    return found, stop


def _here(data: bytes, at: int, ends: Ends) -> tuple[list[Found], int]:
    if data[at : at + 2] == b"\x1f\x8b":
        return _member(data, at)
    record, stop = _record(data, at, ends)
    return [record], stop


def salvage(data: bytes) -> Iterator[Found]:
    """All valid records of an archive, and a gap for every run of bytes that belongs to none.

    Where the bytes at hand fail a check (version line, lengths, end marks, digest, gzip sums), the next place
    that looks like a member or a version line and passes all checks is searched, and reading goes on there.
    """
    at, ends = 0, Ends(data)
    while at < len(data):
        try:
            found, stop = _here(data, at, ends)
        except ValueError as e:
            reason, found, stop = str(e), [], len(data)
            gap = at
            for m in _CANDIDATE.finditer(data, at + 1):
                try:
                    found, stop = _here(data, m.start(), ends)
                except ValueError:
                    continue
                at = m.start()
                break
            else:
                at = len(data)
            yield Found(gap, at - gap, "gap", reason)
        yield from found
        at = max(at, stop)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of RECORDS for all archives under path: kind `record`, or `gap` with the reason and the quarantined bytes.

    One file is read by one task, which holds it and one member of it. payload is null unless asked for.
    """

    def page(uri: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
        return int(m[1]) if m else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import urllib.parse

        names = [f.split()[0] for f in RECORDS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 3, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

        def handed(rows: list[tuple]) -> pa.RecordBatch:
            cols = zip(*rows, strict=True) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for x in salvage(content.as_py()):
                    h = x.headers
                    digest = h.get("warc-payload-digest", "").rpartition(":")[2] or None
                    url = h.get("warc-target-uri")
                    rows.append((file, x.offset, x.length, x.kind, x.reason, h.get("warc-type"), page(h.get("warc-record-id")), url and urllib.parse.unquote(url), page(h.get("warc-refers-to")), x.payload_bytes, digest, x.payload if payloads else None))
                    if len(rows) >= 1000:
                        yield handed(rows)
                        rows = []
                yield handed(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, RECORDS)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back."""
    path = staged_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    return held(read_warc(pages.sparkSession, path, payloads=False), path)
