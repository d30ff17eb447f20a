"""WARC archives: written one gzip member a record, read in byte ranges.

``write_pages`` gives every page a record.  Of pages with equal payloads (of at least
``least`` bytes) the one with the largest id is a ``response``, the others are
``revisit`` records that name it and hold no payload.  Each record is a gzip member of
its own, each task writes one archive that begins with a ``warcinfo`` record.  Spark's
text writer puts the bytes down, so its commit protocol covers lost executors and any
store that Spark reaches: a line is a member without its last byte, and that byte, zero
in a gzip member below 16 MB, is the line separator.  (A longer one gets an empty
member behind it, which ends so too.)

``read_records`` splits archives without an index.  Spark hands each task a byte range;
the text reader cuts it at the gzip magic, and what starts inside a range belongs to it,
its end may lie beyond.  The magic also occurs by chance inside compressed data, so a
piece is only a candidate: it starts a record if it inflates to a WARC version line,
otherwise it goes on with the member before it.  A member that a chance magic cuts across
a range's border leaves its pieces to a second, small pass, which joins them in file
order.

Cases: NULL html is an empty payload, a NULL url an empty one; NULL ids come before
others, and rows with the largest id of their payload are responses each, so repeated
rows get equal results; an empty table gives no archive and no records; other columns
are not read.  Members that are damaged or cut short are left out, alone.  A member that lies
uncompressed inside another's data is told apart from it only within a range.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.llm.common import stored

MAGIC, EMPTY_MEMBER = b"\x1f\x8b\x08", bytes.fromhex("1f8b080000000000000303000000000000000000")
VERSION, LEVEL = b"WARC/1.", 6
#: Hot payloads are joined with the id of their response in so many parts.
SALTS = 64
#: Bytes and records after which a task hands on a batch.
BATCH_BYTES, BATCH_RECORDS = 32 * 2**20, 1_000
#: A record's date; pages have none of their own.
DATE = "1970-01-01T00:00:00Z"
ID = "urn:page:"
#: The first record of an archive.
INFO = (("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{ID}info>"), ("Content-Type", "application/warc-fields"))
RECORD = "record_id string, warc_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, intact boolean, payload binary"


# ---------------------------------------------------------------- records as bytes


def header_text(value: str) -> str:
    """A header value; what a header line cannot hold goes into an encoded word."""
    plain = value.isprintable() and value == value.strip() and not value.startswith("=?")
    return value if plain else f"=?UTF-8?B?{base64.b64encode(value.encode()).decode()}?="


def plain_text(value: str) -> str:
    """Reverse of ``header_text``; in Q words '=XX' stands for a byte and '_' for a blank."""
    match = re.fullmatch(r"=\?([^?]+)\?([BbQq])\?([^?]*)\?=", value)
    if not match:
        return value
    charset, kind, written = match.groups()
    try:
        if kind in "Bb":
            return base64.b64decode(written).decode(charset)
        return re.sub(rb"=([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), written.replace("_", " ").encode()).decode(charset)
    except (ValueError, LookupError):
        return value


def digest_name(payload: bytes) -> str:
    """SHA-1 in base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(headers: Iterable[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = [("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {header_text(value)}\r\n" for name, value in lines) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def page_member(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the response's HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{ID}{'' if page_id is None else page_id}>")]
    headers += [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest_name(payload)}")]
    if revisit:
        headers += [("WARC-Refers-To", f"<{ID}{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return member([*headers, ("Content-Type", "application/http; msgtype=response")], http if revisit else http + payload)


def line(packed: bytes) -> bytes:
    """A member as a line: without the zero byte that the separator puts back."""
    return (packed if packed.endswith(b"\0") else packed + EMPTY_MEMBER)[:-1]


def parse_headers(block: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name (folded lines joined) and what follows them."""
    head, _, rest = block.partition(b"\r\n\r\n")
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")[1:]
    pairs = (x.decode("utf-8", "replace").partition(":") for x in lines)
    return {name.strip().lower(): plain_text(value.strip()) for name, _, value in pairs}, rest


def parse_record(data: bytes) -> dict | None:
    """The record's columns, None if its block is cut short.

    The payload is what follows the HTTP headers, or the whole block without such.  A
    revisit has none; its size is the response's, as its HTTP headers tell.  ``intact``
    says whether the payload has the SHA-1 that the record states.
    """
    headers, block = parse_headers(data)
    length = headers.get("content-length", "")
    if not length.isdigit() or len(block) < int(length):
        return None
    block = block[: int(length)]
    kind = headers.get("warc-type", "")
    http, payload = parse_headers(block) if block.startswith(b"HTTP/") else ({}, block)
    size: int | None = len(payload)
    algorithm, _, digest = headers.get("warc-payload-digest", "").rpartition(":")
    intact = digest == digest_name(payload) if algorithm == "sha1" and kind != "revisit" else None
    if kind == "revisit":
        told = http.get("content-length", "")
        size, payload = int(told) if told.isdigit() else None, None
    return {
        "record_id": headers.get("warc-record-id", "").strip("<>"),
        "warc_type": kind,
        "target_uri": headers.get("warc-target-uri"),
        "payload_digest": digest or None,
        "payload_bytes": size,
        "refers_to": headers.get("warc-refers-to", "").strip("<>") or None,
        "intact": intact,
        "payload": payload,
    }


# ---------------------------------------------------------------- pieces to records


@dataclass
class Splicer:
    """Puts the pieces of one stretch of a file together to members.

    ``records`` are whole, ``loose`` are pieces before the first member that starts in
    the stretch; ``open_pieces`` hold a member that has begun but not ended.
    """

    records: list[bytes] = field(default_factory=list)
    loose: list[bytes] = field(default_factory=list)
    open_pieces: list[bytes] = field(default_factory=list)
    size: int = 0

    def __post_init__(self) -> None:
        self.engine, self.out, self.begun = None, [], False

    def add(self, piece: bytes) -> None:
        """The next piece, its magic included."""
        waiting = [piece]
        while waiting:
            piece = waiting.pop()
            if self.engine is not None:
                waiting += self._feed(piece)
            elif starts_record(piece):
                self.begun, self.engine = True, zlib.decompressobj(31)
                waiting += self._feed(piece)
            elif not self.begun:
                self.loose.append(piece)

    def end(self) -> None:
        """No more pieces: a member that is still open is cut short, what it took may hold whole ones."""
        while self.open_pieces:
            again = self._broken()
            for piece in again:
                self.add(piece)

    def _feed(self, piece: bytes) -> list[bytes]:
        """Goes on with the member; pieces to look at again if it turns out to be broken, the next one last."""
        self.open_pieces.append(piece)
        try:
            self.out.append(self.engine.decompress(piece))
        except zlib.error:
            return self._broken()[::-1]
        if self.engine.eof:
            self.records.append(b"".join(self.out))
            self.size += len(self.records[-1])
            self._close()
        return []

    def _broken(self) -> list[bytes]:
        pieces = self.open_pieces[1:]
        self._close()
        return pieces

    def _close(self) -> None:
        self.engine, self.out, self.open_pieces = None, [], []


def starts_record(piece: bytes) -> bool:
    """The gzip header is sound and inflates to a WARC version line."""
    if len(piece) < 10 or piece[3] & 0xE0:
        return False
    try:
        return zlib.decompressobj(31).decompress(piece, len(VERSION)) == VERSION
    except zlib.error:
        return False


_FIELDS = [
    pa.field("record_id", pa.string()), pa.field("warc_type", pa.string()), pa.field("target_uri", pa.string()),
    pa.field("payload_digest", pa.string()), pa.field("payload_bytes", pa.int64()), pa.field("refers_to", pa.string()),
    pa.field("intact", pa.bool_()), pa.field("payload", pa.binary()),
]
_PIECE = [pa.field("file", pa.string()), pa.field("start", pa.int64()), pa.field("place", pa.int32()), pa.field("piece", pa.binary())]


def _splice(batches: Iterator[pa.RecordBatch], fields: list[pa.Field], last: bool) -> Iterator[pa.RecordBatch]:
    """Records of the stretches from pieces (file, start of the range, piece) in file order.

    The first pass also gives the pieces that a range cannot place.  In the last one a
    stretch is what is left of a file.
    """
    at, splicer, schema = None, Splicer(), pa.schema(fields if last else [*fields, *_PIECE])

    def rows(ended: bool) -> Iterator[pa.RecordBatch]:
        if ended and last:
            splicer.end()
        found = [r for r in map(parse_record, splicer.records) if r]
        if ended and not last:
            found += [{"file": at[0], "start": at[1], "place": n, "piece": p} for n, p in enumerate([*splicer.loose, *splicer.open_pieces])]
        splicer.records, splicer.size = [], 0
        if found:
            yield pa.RecordBatch.from_pylist(found, schema)

    for batch in batches:
        for file, start, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            here = (file, None if last else start)
            if here != at:
                if at:
                    yield from rows(True)
                at, splicer = here, Splicer()
                if start == 0 and not last:
                    continue  # what stands before the file's first magic
            splicer.add(piece.as_py())
            if last:
                splicer.loose = []
            if splicer.size > BATCH_BYTES or len(splicer.records) > BATCH_RECORDS:
                yield from rows(False)
    if at:
        yield from rows(True)


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives below ``path``: columns of ``RECORD``, without ``payload`` if it is not wanted."""
    lines = spark.read.options(lineSep=MAGIC.decode("latin-1"), encoding="ISO-8859-1").text(path)
    piece = F.concat(F.lit(MAGIC), F.col("value").cast("binary"))
    pieces = lines.select("_metadata.file_path", "_metadata.file_block_start", piece.alias("piece"))
    fields = _FIELDS if payload else _FIELDS[:-1]
    columns = RECORD if payload else RECORD.rpartition(",")[0]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _splice(batches, fields, last=False)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _splice(batches, fields, last=True)

    placed = stored(pieces.mapInArrow(first, f"{columns}, file string, start long, place int, piece binary"), "records")
    whole = placed.where("file is null").select(*(f.name for f in fields))
    left = placed.where("file is not null").select("file", "start", "place", "piece")
    ordered = left.repartition("file").sortWithinPartitions("file", "start", "place").select("file", "start", "piece")
    return whole.unionByName(ordered.mapInArrow(second, columns))


# ---------------------------------------------------------------- pages


def write_pages(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> None:
    """Archives of all pages below ``path``; payloads of ``least`` bytes or more are held once."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    named = pages.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), payload.alias("payload"))
    named = named.withColumn("sha", F.unhex(F.sha1("payload")))
    most = named.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.max("id").alias("last"), F.count("*").alias("n"))
    # Every copy of a hot payload would meet in one task: both sides are dealt by a salt too.
    most = most.where("n > 1").select("sha", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = named.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    placed = salted.join(most, ["sha", "salt"], "left")
    refers = F.when(F.col("id").isNull() | (F.col("id") < F.col("last")), F.col("last"))
    records = placed.select("id", "url", "payload", refers.alias("refers_to"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, held, begun = [], 0, False
        for batch in batches:
            for row in zip(*batch.columns):
                if not begun:
                    begun = True
                    lines.append(line(member(INFO, b"format: WARC File Format 1.1\r\n")))
                lines.append(line(page_member(*(x.as_py() for x in row))))
                held += len(lines[-1])
                if held > BATCH_BYTES or len(lines) > BATCH_RECORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["line"])
                    lines, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["line"])

    packed = records.mapInArrow(pack, "line binary")
    # The cast does not touch the bytes.
    packed.select(F.col("line").cast("string")).write.option("lineSep", "\0").text(path)


def read_pages(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of the pages that ``write_pages`` wrote.

    A revisit's payload is NULL; its response holds it.  A response that is not intact
    is left out.
    """
    records = read_records(spark, path, payload).where(F.col("warc_type").isin("response", "revisit") & F.coalesce("intact", F.lit(True)))
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(ID) + 1}) as long)")
    return records.select(
        number("record_id").alias("page_id"),
        F.col("target_uri").alias("url"),
        "payload_bytes",
        "payload_digest",
        F.col("warc_type").alias("record_type"),
        number("refers_to").alias("refers_to"),
        *(["payload"] if payload else []),
    )
