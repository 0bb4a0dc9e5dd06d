"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame a record.

Writing: of records with equal payloads the one with the smallest id is the response that the others revisit. A task gathers
records up to a bound, trains a dictionary on a sample of them and leaves one archive; Spark's text writer puts each into a file
of its own, whose commit survives lost tasks. That writer ends a line by a separator, so an empty skippable frame is the
separator and files are plain concatenated frames. Reading: Spark's binary files, one archive a row; every frame is decoded on
its own and its headers, lengths and digest are validated.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import join_groups, small, stored

# Fixed values of the formats: Zstandard's frame magic, a skippable frame's (sixteen of them) and that of a dictionary frame.
FRAME, SKIPPABLE, DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
#: An empty skippable frame, as text.
SEPARATOR = struct.pack("<II", SKIPPABLE, 0).decode("ascii")
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes from which equal records become revisits.
LEAST = 100
#: Uncompressed bytes of an archive (or one larger record), of the records that its dictionary learns from, and of a dictionary.
ARCHIVE, SAMPLE, DICTIONARY_BYTES = 32 << 20, 2 << 20, 64 << 10
#: Groups of copies that are sent to all tasks; more are joined by a shuffle.
GROUPS_SENT = 200_000
#: Compressed bytes fed at once, of which the last piece of a frame may belong to the next.
_FED = 1 << 16
_END = b"\r\n\r\n"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """(id, url, payload, digest, refers_to) of each row: whether it revisits another, and which one."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    equal = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    equal = stored(equal.filter("copies > 1 AND first IS NOT NULL"), "equal-payloads")
    n, copies = equal.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    both = rows.join(small(equal, n), "digest", "left") if n <= GROUPS_SENT else join_groups(rows, equal, ["digest"], copies, "left")
    return both.select("id", "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def _uri(page_id: object) -> str:
    return "urn:page:none" if pd.isna(page_id) else f"urn:page:{int(page_id)}"


def record_bytes(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the response's HTTP headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = not pd.isna(refers_to)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_uri(page_id)}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe=_KEPT) or _uri(page_id)}", f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: <{_uri(refers_to)}>", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + _END + block + _END


#: Characters that an address keeps; white space, controls and what is not ASCII are escaped.
_KEPT = "".join(map(chr, range(0x21, 0x7F)))


def archive_bytes(items: list[bytes]) -> bytes:
    """An archive of some records. Where they are too few or too alike to train on there is no dictionary."""
    step, sample, size = max(1, sum(map(len, items)) // SAMPLE), [], 0
    for item in items[::step]:
        if size + len(item) <= 2 * SAMPLE:
            sample.append(item)
            size += len(item)
    try:
        learned = zstandard.train_dictionary(max(1024, min(DICTIONARY_BYTES, size // 20)), sample, k=200, d=8)
        learned.precompute_compress(level=3)
    except (zstandard.ZstdError, ValueError):
        learned = None
    out = []
    if learned:
        data = learned.as_bytes()
        out = [struct.pack("<II", DICTIONARY, len(data)), data]
    packer = zstandard.ZstdCompressor(level=3, dict_data=learned, write_checksum=True)
    return b"".join(out + [packer.compress(item) for item in items])


def write_archives(rows: DataFrame, path: str, date: datetime | None = None) -> None:
    """Archives of records() into a new folder, one file each: no more than ARCHIVE bytes of records, or one larger record."""
    stamp = (date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for x in batch.itertuples(index=False):
                item = record_bytes(x.id, x.url, bytes(x.payload), x.digest, x.refers_to, stamp)
                if held and size + len(item) > ARCHIVE:
                    yield pd.DataFrame({"value": [archive_bytes(held)]})
                    held, size = [], 0
                held.append(item)
                size += len(item)
        if held:
            yield pd.DataFrame({"value": [archive_bytes(held)]})

    # ids as text: pandas would turn nullable numbers into floating point ones
    texts = rows.withColumns({c: F.col(c).cast("string") for c in ("id", "refers_to")})
    archives = texts.mapInPandas(gather, "value binary")
    archives.select(F.col("value").cast("string")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 1).text(path)


def frames(raw: bytes) -> Iterator[tuple[int, bytes, str | None]]:
    """(offset, record, problem) of each frame, decoded with the archive's dictionary; after a broken frame nothing more is found."""
    at, learned = 0, None
    if raw[:4] == struct.pack("<I", DICTIONARY):
        data = raw[8 : 8 + struct.unpack("<I", raw[4:8].ljust(4, b"\0"))[0]]
        at = 8 + len(data)
        if data[:4] == struct.pack("<I", FRAME):
            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        learned = zstandard.ZstdCompressionDict(data)
    opener = zstandard.ZstdDecompressor(dict_data=learned)
    while at < len(raw):
        if len(raw) - at < 8:
            yield at, b"", "rest is shorter than a frame"
            return
        magic, size = struct.unpack("<II", raw[at : at + 8])
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            at += 8 + size
            continue
        start, parts, frame = at, [], opener.decompressobj()
        try:
            while not frame.eof and at < len(raw):
                fed = raw[at : at + _FED]
                parts.append(frame.decompress(fed))
                at += len(fed) - len(frame.unused_data)
        except zstandard.ZstdError as broken:
            yield start, b"", f"frame cannot be decoded: {broken}"
            return
        yield start, b"".join(parts), None if frame.eof else "frame is cut off"


def _fields(head: bytes) -> dict[str, str]:
    """Named fields by lower-case name, folded lines joined; the last of a repeated name counts."""
    unfolded = re.sub(rb"\r\n[ \t]+", b" ", head)
    pairs = [line.partition(b":") for line in unfolded.split(b"\r\n") if line]
    return {name.strip().lower().decode("utf-8", "replace"): value.strip().decode("utf-8", "replace") for name, _, value in pairs}


_NO_RECORD = {"headers": None, "record_id": None, "record_type": None, "payload": None, "payload_bytes": None, "payload_digest": None, "refers_to": None}


def parse_record(record: bytes) -> dict:
    """A record's headers and payload, with the first problem found: version, named fields, lengths, digest."""
    head, _, block = record.partition(_END)
    first, _, rest = head.partition(b"\r\n")
    fields = _fields(rest)
    out = _NO_RECORD | {"headers": fields, "record_id": fields.get("warc-record-id", "").strip("<>") or None, "record_type": fields.get("warc-type"), "problem": None}
    missing = [name for name in ("warc-record-id", "warc-type", "warc-date", "content-length") if name not in fields]
    length = fields.get("content-length", "")
    if first not in VERSIONS:
        return out | {"problem": "no version of WARC"}
    if missing:
        return out | {"problem": f"no {missing[0]}"}
    if not re.fullmatch(r"[0-9]+", length) or len(block) != int(length) + len(_END) or not block.endswith(_END):
        return out | {"problem": "length of the block is not that of its header"}
    block = block[: int(length)]
    stated = fields.get("warc-payload-digest", "")
    payload, full = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(_END)
        counted = _fields(http.partition(b"\r\n")[2]).get("content-length", "")
        full = int(counted) if re.fullmatch(r"[0-9]+", counted) else len(payload)
    revisit = out["record_type"] == "revisit"
    digest = stated.removeprefix("sha256:") if stated.startswith("sha256:") else None
    if not revisit:
        found = hashlib.sha256(payload).hexdigest()
        if full != len(payload):
            out["problem"] = "length of the payload is not that of its header"
        elif digest not in (None, found):
            out["problem"] = "digest of the payload is not that of its header"
        digest = found
    elif digest is None or "warc-refers-to" not in fields:
        out["problem"] = "revisit without digest or target"
    return out | {"payload": None if revisit else payload, "payload_bytes": full, "payload_digest": digest, "refers_to": fields.get("warc-refers-to", "").strip("<>") or None}


_READ = "archive string, offset long, record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string, headers map<string,string>, problem string"


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record of all archives in a folder, in any order: where it is, its headers and what was wrong with it (or
    null). payload_bytes and payload_digest are of the full payload, for revisits by their headers. `payloads` adds the bytes,
    null for revisits. Archives without a dictionary, or with a compressed one, are read too; empty files hold no records."""
    schema = _READ + (", payload binary" if payloads else "")
    names = re.findall(r"(?:^|, )(\w+)", re.sub(r"<[^>]*>", "", schema))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, raw in zip(batch["path"], batch["content"], strict=True):
                held, size = [], 0
                for offset, record, broken in frames(bytes(raw)):
                    found = _NO_RECORD | {"problem": broken} if broken else parse_record(record)
                    held.append({"archive": archive, "offset": offset} | found)
                    size += len(record)
                    if size > ARCHIVE:
                        yield _table(held, names)
                        held, size = [], 0
                if held:
                    yield _table(held, names)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInPandas(read, schema)


def _table(rows: list[dict], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names, dtype=object)
    return out.astype({"offset": "int64", "payload_bytes": "Int64"})


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Pages written to archives in `path` and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload; payloads below LEAST bytes, empty ones included, are responses each, as are rows repeated under
    the smallest page_id of equal payloads. Rows without page_id revisit the smallest that is there, and are responses if none
    is. Addresses may be null, empty or hold any characters: they are escaped. A very long page is an archive of its own; an
    empty table gives no archive and no rows. Only page_id, url and html are read. A damaged archive stops the reading query.
    """
    write_archives(records(pages), path)
    read = read_archives(pages.sparkSession, path)
    whole = F.when(F.col("problem").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat_ws(" ", F.col("archive"), F.col("offset"), F.col("problem"))).cast("string"))
    number = lambda c: F.expr(f"try_cast(substring({c}, {len('urn:page:') + 1}) AS bigint)")
    return read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", whole.alias("record_type"), number("refers_to").alias("refers_to"))


def sql() -> str:
    """What the archives must hold, in DuckDB."""
    return f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {LEAST} GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
