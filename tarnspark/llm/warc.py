"""WARC archives: records written and read, and transactions put together.

A capture has a response (or revisit), a request and a metadata record; the latter two name the
first in WARC-Concurrent-To.  ``write_archives`` makes gzip members, one for each record,
in segments of a few MB; the segments of an archive in order are its .warc.gz file.
``read_records`` parses such segments, or whole files, compressed or not.  ``assemble`` joins the records of
a transaction through their concurrent-to identifiers into one nested row.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnspark.llm import _text
from tarnspark.llm._bitmap import members, only_members, with_member
from tarnspark.llm._scratch import save

SEGMENT = 4 << 20
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES = "archive string, segment int, n_records int, content binary"
RECORDS = (
    "archive string, segment int, ordinal int, record_id string, record_type string, target_uri string, date string, concurrent_to array<string>, refers_to_uri string,"
    " payload_digest string, digest_ok boolean, payload_bytes long, fields map<string,string>, payload binary, error string"
)


def base32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def base32_sha1(payload: bytes) -> str:
    return base32(hashlib.sha1(payload).hexdigest())


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, record_id: str, block: bytes, content_type: str, **headers: str | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    lines += [f"{k.replace('_', '-')}: {_clean(v)}" for k, v in headers.items() if v is not None]
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def capture(page_id: int | None, url: str | None, payload: bytes | None, sha1: str, length: int, first: int | None, first_url: str | None) -> list[bytes]:
    """The records of one capture: response, or revisit of page ``first``, which needs no payload; request; metadata."""
    ids = [f"urn:uuid:{uuid.uuid4()}" for _ in range(3)]
    digest = f"sha1:{base32(sha1)}"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    common = {"WARC_Target_URI": url}
    if first is None:
        main = record("response", ids[0], head + (payload or b""), "application/http;msgtype=response", **common, WARC_Payload_Digest=digest)
    else:
        main = record("revisit", ids[0], head, "application/http;msgtype=response", **common, WARC_Payload_Digest=digest, WARC_Profile=REVISIT, WARC_Refers_To_Target_URI=first_url)
    host, _, path = (url or "").partition("://")[2].partition("/")
    asked = record("request", ids[1], f"GET /{_clean(path)} HTTP/1.1\r\nHost: {_clean(host)}\r\n\r\n".encode(), "application/http;msgtype=request", **common, WARC_Concurrent_To=f"<{ids[0]}>")
    facts = {"pageId": page_id, "payloadLength": length, "refersToPage": first}
    block = "".join(f"{k}: {v}\r\n" for k, v in facts.items() if v is not None).encode()
    return [main, asked, record("metadata", ids[2], block, "application/warc-fields", **common, WARC_Concurrent_To=f"<{ids[0]}>")]


def write_archives(captures: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The archives of the rows that ``mark_revisits`` gives, as a table of segments in the shared folder."""
    names = ("page_id", "url", "html", "sha1", "length", "first", "first_url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        members, size, number = [], 0, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [{"archive": name, "segment": number, "n_records": len(members), "content": b"".join(members)}],
                pa.schema([("archive", pa.string()), ("segment", pa.int32()), ("n_records", pa.int32()), ("content", pa.binary())]),
            )

        for batch in batches:
            for page_id, url, html, *facts in zip(*(batch[c] for c in names), strict=True):
                for raw in capture(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), *(f.as_py() for f in facts)):
                    members.append(_member(raw))
                    size += len(members[-1])
                if size >= segment:
                    yield out()
                    members, size, number = [], 0, number + 1
        if members:
            yield out()

    return save(captures.select(*names).mapInArrow(write, ARCHIVES), "warc", "uncompressed")


def members_of(content: bytes) -> Iterator[bytes]:
    """The gzip members of a segment, or the whole of an uncompressed one.  A broken or cut member raises ValueError."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    while at < len(view):
        z, parts, start = zlib.decompressobj(31), [], at
        try:
            while not z.eof and at < len(view):
                piece = view[at : at + 65_536]
                parts.append(z.decompress(piece))
                at += len(piece) - len(z.unused_data)
        except zlib.error as e:
            raise ValueError(f"broken gzip member at byte {start}") from e
        if not z.eof:
            raise ValueError(f"gzip member at byte {start} is cut short")
        yield b"".join(parts)


def records_of(raw: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(headers by lower-case name, block) of each record.  A record that is cut short or has no length raises ValueError."""
    at = 0
    while at < len(raw):
        if raw[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        end = raw.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError("headers without end")
        headers: dict[str, list[str]] = {}
        for line in raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            key, _, value = line.partition(":")
            headers.setdefault(key.strip().lower(), []).append(value.strip())
        length = headers.get("content-length", [""])[0]
        if not length.isascii() or not length.isdigit():
            raise ValueError(f"record at byte {at} without Content-Length")
        size = int(length)
        block = raw[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError("block cut short")
        yield headers, block
        at = end + 4 + size + 4


def parse(headers: dict[str, list[str]], block: bytes) -> dict:
    one = lambda k: (headers.get(k) or [None])[0]
    kind = one("warc-type") or ""
    payload, fields = None, None
    if kind in ("response", "request"):
        payload = block.partition(b"\r\n\r\n")[2]
    elif kind == "resource":
        payload = block
    elif one("content-type") == "application/warc-fields":
        fields = [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in block.decode("utf-8", "replace").splitlines()) if k.strip()]
    digest = (one("warc-payload-digest") or "").rpartition(":")[2] or None
    own = base32_sha1(payload) if payload is not None and kind in ("response", "resource") else None
    return {
        "record_id": (one("warc-record-id") or "").strip("<>"), "record_type": kind, "target_uri": one("warc-target-uri"), "date": one("warc-date"),
        "concurrent_to": [v.strip("<>") for v in headers.get("warc-concurrent-to", [])], "refers_to_uri": one("warc-refers-to-target-uri"),
        "payload_digest": own or digest, "digest_ok": None if own is None or digest is None else own == digest,
        "payload_bytes": None if own is None else len(payload), "fields": fields, "payload": payload, "error": None,
    }


def read_records(archives: DataFrame) -> DataFrame:
    """The records of (archive, segment, content) rows; a null content holds none.

    What can't be read gives one row with ``error`` and no record_id: the rest of a gzip member after a bad record, or the rest of a segment
    after a broken member.  All that stands before, and other members after a bad record, are read.
    """
    names = [x.split()[0] for x in RECORDS.replace("map<string,string>", "map").split(", ")]
    kinds = {"segment": pa.int32(), "ordinal": pa.int32(), "concurrent_to": pa.list_(pa.string()), "digest_ok": pa.bool_(), "payload_bytes": pa.int64(), "fields": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, segment, content in zip(batch["archive"], batch["segment"], batch["content"], strict=True):
                rows: list[dict] = []
                place = lambda: {"archive": archive.as_py(), "segment": segment.as_py(), "ordinal": len(rows)}  # noqa: B023, E731
                try:
                    for member in members_of(content.as_py() or b""):
                        try:
                            for headers, block in records_of(member):
                                rows.append(parse(headers, block) | place())
                        except ValueError as e:
                            rows.append({"error": str(e), "concurrent_to": []} | place())
                except ValueError as e:
                    rows.append({"error": str(e), "concurrent_to": []} | place())
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)
        _text.trim()

    return archives.select("archive", "segment", "content").mapInArrow(read, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, main, request, metadata.

    A capture is a response, revisit or resource record.  Requests and metadata belong to the capture that they name
    in WARC-Concurrent-To; one that names a request of the capture belongs to it too, as does one
    that the capture itself names.  Of several the one with the smallest record_id is kept.  A record
    that leads to no capture has a row of its own without ``main``.
    """
    columns = [c for c in records.columns if c != "record_id"]
    body = F.struct("record_id", *columns)
    records = records.where("record_id is not null")  # a row of what can't be read is no record
    is_main = F.col("record_type").isin("response", "revisit", "resource")
    keyed = records.withColumn("_main", is_main)
    # most records name one other; a capture that names its request is turned round, and chains of two are followed
    named_by = keyed.where("_main").select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("_named_by"))
    others = keyed.where("not _main")
    links = others.select("record_id", F.explode("concurrent_to").alias("to")).groupBy("record_id").agg(F.min("to").alias("to"))
    hop = links.join(links.select(F.col("record_id").alias("to"), F.col("to").alias("_next")), "to", "left").select("record_id", F.coalesce("_next", "to").alias("_to"))
    hop = hop.join(named_by.groupBy("record_id").agg(F.min("_named_by").alias("_named_by")), "record_id", "full")
    keys = hop.select("record_id", F.coalesce("_to", "_named_by").alias("_key"))
    mains = keyed.where("_main").select(F.col("record_id").alias("capture_id"), F.lit("main").alias("_role"), body.alias("_r"))
    rest = others.join(keys, "record_id", "left").select(F.coalesce("_key", "record_id").alias("capture_id"), F.col("record_type").alias("_role"), body.alias("_r"))
    pick = lambda role: F.min_by(F.when(F.col("_role") == role, F.col("_r")), F.when(F.col("_role") == role, F.col("_r.record_id"))).alias(role)
    return mains.unionByName(rest).groupBy("capture_id").agg(pick("main"), pick("request"), pick("metadata"))


def mark_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, sha1, length, first, first_url) of every row of ``pages`` (page_id, url, html): of equal payloads of at least
    ``least`` bytes ``first`` is the page of smallest id, null for that page itself and for smaller payloads; a row with ``first`` has no html.

    Pages that share no payload aren't shuffled, a bit array of fixed size tells them; of the others html goes on only for the first ones.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    length = F.octet_length(html).cast("long")
    keyed = pages.select("page_id", "url", "html", F.sha1(html.cast("binary")).alias("sha1"), length.alias("length"))
    large = keyed.where(F.col("length") >= least)
    firsts = (
        large.groupBy(F.col("sha1").alias("_d"))
        .agg(F.min("page_id").alias("_first"), F.min_by("url", F.struct("page_id", "url")).alias("_url"), F.count("*").alias("_n"))
        .where("_n > 1 and _first is not null").drop("_n")
    )
    firsts = save(firsts, "first-payloads")
    names = ("page_id", "url", "html", "sha1", "length")
    none = (F.lit(None).cast(pages.schema["page_id"].dataType).alias("first"), F.lit(None).cast("string").alias("first_url"))
    marked = with_member(keyed, members(firsts, "_d"), "_may", "sha1").withColumn("_may", F.col("_may") & (F.col("length") >= least))
    alone = marked.where("not _may").select(*names, *none)
    shared = marked.where("_may")
    own = F.col("page_id").eqNullSafe(F.col("_first"))
    later = shared.select("page_id", "url", "sha1", "length").join(firsts, F.col("sha1") == F.col("_d")).where(~own)
    later = later.select("page_id", "url", F.lit(None).cast("string").alias("html"), "sha1", "length", F.col("_first").alias("first"), F.col("_url").alias("first_url"))
    astray = shared.select("page_id", "sha1").join(firsts, F.col("sha1") == F.col("_d"), "left_anti")  # only share a slot of the bit array
    whole = save(firsts.select(F.col("_first").alias("_p"), "_d").unionByName(astray.select(F.col("page_id").alias("_p"), F.col("sha1").alias("_d"))).distinct(), "whole-payloads")
    first = only_members(shared, members(whole, "_p", "_d"), "page_id", "sha1")
    first = first.join(whole, (F.col("sha1") == F.col("_d")) & F.col("page_id").eqNullSafe(F.col("_p")), "left_semi").select(*names, *none)
    return alone.unionByName(later).unionByName(first)


def page_captures(pages: DataFrame, least: int = 0) -> DataFrame:
    """One row per page, from the archives as they are read back.

    A null html is an empty payload.  Repeated page ids give a capture for each row; all rows with the
    smallest id of a payload are responses.  A null id comes after every other.  An empty table gives no rows; other columns are ignored.
    """
    archives = write_archives(mark_revisits(pages, least))
    captures = assemble(save(read_records(archives).drop("payload"), "warc-records"))
    fact = lambda k: F.element_at("metadata.fields", k).cast("long")
    digest: Column = F.col("main.payload_digest")
    return captures.where("main is not null").select(
        fact("pageId").alias("page_id"),
        F.coalesce("main.payload_bytes", fact("payloadLength")).alias("payload_bytes"),
        digest.alias("payload_digest"),
        F.col("main.record_type").alias("record_type"),
        fact("refersToPage").alias("refers_to"),
        "capture_id",
        F.col("main.target_uri").alias("url"),
        F.col("request.record_id").alias("request_id"),
    )
