"""Media columns: ISO base media containers, written and read without any codec.

``mux`` stores a payload as uncompressed 8-bit grey frames of 24 x 24 samples in one
video track.  ``probe`` walks the nested boxes of any container, decodes the sample tables
(stsd, stts, stss, stsc, stsz, stco/co64, and of fragments tfhd, trex and trun) and gives codec, duration and the byte ranges of the samples and
keyframes of every track; it never touches the payload.  ``demux`` reads the samples' bytes back by those ranges.
Column functions wrap each for Arrow batches.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE = 24
FRAME = SIDE * SIDE
TIMESCALE = 24
PER_CHUNK = 64
#: Boxes that hold boxes.
CONTAINERS = frozenset({b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"})
_UNITY = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)
    return head + b"".join(parts)


def full(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(raw: bytes) -> bytes:
    """``raw`` and bytes 255 up to a positive multiple of a frame."""
    return raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)


def mux(raw: bytes) -> bytes:
    """A container with ``pad(raw)`` as frames, chunk by chunk, and the unpadded length in user data."""
    payload = pad(raw)
    n = len(payload) // FRAME
    chunks = -(-n // PER_CHUNK)
    entry = struct.pack(">6xHHH12xHHIIIH32shH", 1, 0, 0, SIDE, SIDE, 0x480000, 0x480000, 0, 1, b"\x04grey".ljust(32, b"\0"), 40, 0xFFFF)
    runs = [(1, PER_CHUNK, 1)] * (n >= PER_CHUNK) + [(chunks, n % PER_CHUNK, 1)] * (n % PER_CHUNK > 0)

    def moov(first: int) -> bytes:
        offsets = [first + i * PER_CHUNK * FRAME for i in range(chunks)]
        wide = offsets[-1] >= 1 << 32
        stbl = box(
            b"stbl",
            full(b"stsd", 0, 0, struct.pack(">I", 1), box(b"raw ", entry)),
            full(b"stts", 0, 0, struct.pack(">III", 1, n, 1)),
            full(b"stsc", 0, 0, struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", 0, 0, struct.pack(">II", FRAME, n)),
            full(b"co64" if wide else b"stco", 0, 0, struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        minf = box(b"minf", full(b"vmhd", 0, 1, bytes(8)), box(b"dinf", full(b"dref", 0, 0, struct.pack(">I", 1), full(b"url ", 0, 1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)), full(b"hdlr", 0, 0, struct.pack(">I4s12x", 0, b"vide"), b"\0"), minf)
        tkhd = full(b"tkhd", 0, 3, struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, n, 0, 0, 0, 0), _UNITY, struct.pack(">II", SIDE << 16, SIDE << 16))
        mvhd = full(b"mvhd", 0, 0, struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, n, 0x10000, 0x100), _UNITY, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia), box(b"udta", box(b"nbyt", struct.pack(">Q", len(raw)))))

    ftyp = box(b"ftyp", struct.pack(">4sI", b"qt  ", 0), b"qt  ")
    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    first = len(ftyp) + len(moov(0)) + head
    index = moov(first)
    if len(ftyp) + len(index) + head != first:  # 64-bit offsets took more room
        index = moov(len(ftyp) + len(index) + head)
    return ftyp + index + box(b"mdat", payload)


def boxes(data: memoryview, start: int, end: int, depth: int = 0) -> Iterator[tuple[bytes, int, int, int]]:
    """(type, start of content, end, depth) of each box, in file order, containers before their content."""
    at = start
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("cut box header")
            (size,), head = struct.unpack_from(">Q", data, at + 8), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} at {at} has a wrong size")
        yield kind, at + head, at + size, depth
        if kind in CONTAINERS and depth < 16:
            yield from boxes(data, at + head, at + size, depth + 1)
        at += size


@dataclass
class Track:
    number: int = 0
    kind: str = ""
    codec: str = ""
    width: int = 0
    height: int = 0
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keyframes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def add(self, sizes: np.ndarray, offsets: np.ndarray, sync: np.ndarray, duration: int) -> None:
        """More samples, of a fragment; ``sync``: which of them are keyframes."""
        self.keyframes = np.concatenate([self.keyframes, len(self.sizes) + np.flatnonzero(sync)])
        self.sizes, self.offsets = np.concatenate([self.sizes, sizes]), np.concatenate([self.offsets, offsets])
        self.duration += duration

    def ranges(self) -> list[tuple[int, int]]:
        """(offset, length) of the keyframes' bytes, neighbours joined."""
        at, size = self.offsets[self.keyframes], self.sizes[self.keyframes]
        if not len(at):
            return []
        new = np.concatenate([[True], at[1:] != at[:-1] + size[:-1]])
        starts = at[new]
        ends = (at + size)[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
        return list(zip(starts.tolist(), (ends - starts).tolist(), strict=True))


@dataclass
class Media:
    brand: str = ""
    tracks: list[Track] = field(default_factory=list)
    n_boxes: int = 0
    unpadded: int | None = None


def _ints(data: memoryview, at: int, n: int, kind: str, end: int) -> np.ndarray:
    if n < 0 or at + n * np.dtype(kind).itemsize > end:
        raise ValueError("a sample table is longer than its box")
    return np.frombuffer(data, kind, n, at).astype(np.int64)


@dataclass
class Fragment:
    """What a track fragment says before its runs: the track, the offset that runs count from, and (duration, size, flags) by default."""

    track: Track
    base: int
    defaults: tuple[int, int, int]
    end: int


#: Bits of tfhd and trun flags (fixed values of the format) and of a sample's flags: not a keyframe.
TF_BASE, TF_ENTRY, TF_DURATION, TF_SIZE, TF_FLAGS = 0x1, 0x2, 0x8, 0x10, 0x20
TR_OFFSET, TR_FIRST, TR_DURATION, TR_SIZE, TR_FLAGS, TR_SHIFT = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NOT_SYNC = 0x10000


def _fields(data: memoryview, at: int, end: int, flags: int, bits: tuple[tuple[int, str], ...]) -> tuple[dict[int, int], int]:
    """The optional fields that ``flags`` names, in order, and where they end."""
    out = {}
    for bit, kind in bits:
        if flags & bit:
            size = struct.calcsize(kind)
            if at + size > end:
                raise ValueError("a fragment's box is cut short")
            (out[bit],) = struct.unpack_from(kind, data, at)
            at += size
    return out, at


def _run(data: memoryview, at: int, end: int, of: Fragment, limit: int) -> None:
    """The samples of one trun."""
    flags, n = struct.unpack_from(">I", data, at)[0] & 0xFFFFFF, struct.unpack_from(">I", data, at + 4)[0]
    head, at = _fields(data, at + 8, end, flags, ((TR_OFFSET, ">i"), (TR_FIRST, ">I")))
    columns = [bit for bit in (TR_DURATION, TR_SIZE, TR_FLAGS, TR_SHIFT) if flags & bit]
    if not columns and n > limit:
        raise ValueError("a run has more samples than the file holds")
    table = _ints(data, at, n * len(columns), ">u4", end).reshape(n, len(columns))
    own = {bit: table[:, i] for i, bit in enumerate(columns)}
    duration, size, marks = (own.get(bit, np.full(n, d, np.int64)) for bit, d in zip((TR_DURATION, TR_SIZE, TR_FLAGS), of.defaults, strict=True))
    if TR_FIRST in head and n and TR_FLAGS not in own:
        marks = marks.copy()
        marks[0] = head[TR_FIRST]
    start = of.base + head[TR_OFFSET] if TR_OFFSET in head else of.end
    offsets = start + np.cumsum(size) - size
    of.end = start + int(size.sum())
    if start < 0 or of.end > limit:
        raise ValueError("samples lie outside the file")
    of.track.add(size, offsets, marks & NOT_SYNC == 0, int(duration.sum()))


def probe(media: bytes) -> Media:
    """What the boxes say.  Raises ValueError for what isn't an ISO media container."""
    data = memoryview(media)
    out = Media()
    tables: dict[bytes, np.ndarray] = {}
    defaults: dict[int, tuple[int, int, int]] = {}
    moof, fragment = 0, None

    def close() -> None:
        if not out.tracks or not tables:
            return
        t = out.tracks[-1]
        sizes, chunk_at, runs = tables.get(b"size"), tables.get(b"chunk"), tables.get(b"stsc")
        if sizes is not None and chunk_at is not None and runs is not None and len(sizes):
            first, per = runs.reshape(-1, 3)[:, 0] - 1, runs.reshape(-1, 3)[:, 1]
            if not len(first) or first[0] != 0 or (np.diff(first) <= 0).any() or first[-1] >= len(chunk_at):
                raise ValueError("stsc doesn't fit the chunks")
            counts = np.repeat(per, np.diff(np.append(first, len(chunk_at))))
            if (counts < 0).any() or counts.sum() != len(sizes):
                raise ValueError("stsc doesn't fit the samples")
            begin = np.cumsum(sizes) - sizes
            first_of = np.repeat(np.cumsum(counts) - counts, counts)
            t.offsets = np.repeat(chunk_at, counts) + begin - begin[first_of]
            t.sizes = sizes
            if (t.offsets < 0).any() or (t.offsets + sizes > len(media)).any():
                raise ValueError("samples lie outside the file")
            sync = tables.get(b"stss")
            t.keyframes = np.arange(len(sizes)) if sync is None else sync - 1
            if len(t.keyframes) and (t.keyframes.min() < 0 or t.keyframes.max() >= len(sizes)):
                raise ValueError("stss names samples that aren't there")
        tables.clear()

    try:
        for kind, at, end, depth in boxes(data, 0, len(data)):
            out.n_boxes += 1
            if kind == b"ftyp":
                out.brand = bytes(data[at : at + 4]).decode("latin-1")
            elif kind == b"trak":
                close()
                out.tracks.append(Track())
            elif kind == b"nbyt":
                (out.unpadded,) = struct.unpack_from(">Q", data, at)
            elif kind == b"trex":
                number, _, *by_default = struct.unpack_from(">5I", data, at + 4)
                defaults[number] = tuple(by_default)
            elif kind == b"moof":
                close()
                moof, fragment = at - 8, None
            elif kind == b"traf":
                fragment = None
            elif kind == b"tfhd":
                flags, number = struct.unpack_from(">II", data, at)
                known = {t.number: t for t in out.tracks}
                if number not in known:
                    raise ValueError(f"a fragment names track {number}, which isn't there")
                found, _ = _fields(data, at + 8, end, flags, ((TF_BASE, ">Q"), (TF_ENTRY, ">I"), (TF_DURATION, ">I"), (TF_SIZE, ">I"), (TF_FLAGS, ">I")))
                base = found.get(TF_BASE, moof)
                before = defaults.get(number, (0, 0, 0))
                fragment = Fragment(known[number], base, tuple(found.get(b, d) for b, d in zip((TF_DURATION, TF_SIZE, TF_FLAGS), before, strict=True)), base)
            elif kind == b"trun":
                if fragment is None:
                    raise ValueError("a run without a track fragment header")
                _run(data, at, end, fragment, len(data))
            elif out.tracks and depth >= 2:
                t = out.tracks[-1]
                if kind == b"tkhd":
                    (t.number,) = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))
                elif kind == b"mdhd":
                    t.timescale, t.duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
                elif kind == b"hdlr":
                    t.kind = bytes(data[at + 8 : at + 12]).decode("latin-1")
                elif kind == b"stsd" and end - at >= 16:
                    t.codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
                    if t.kind == "vide" and end - at >= 44:
                        t.width, t.height = struct.unpack_from(">HH", data, at + 40)
                elif kind == b"stts":
                    (n,) = struct.unpack_from(">I", data, at + 4)
                    deltas = _ints(data, at + 8, 2 * n, ">u4", end).reshape(-1, 2)
                    t.duration = int((deltas[:, 0] * deltas[:, 1]).sum())
                elif kind == b"stss":
                    (n,) = struct.unpack_from(">I", data, at + 4)
                    tables[b"stss"] = _ints(data, at + 8, n, ">u4", end)
                elif kind == b"stsc":
                    (n,) = struct.unpack_from(">I", data, at + 4)
                    tables[b"stsc"] = _ints(data, at + 8, 3 * n, ">u4", end)
                elif kind == b"stsz":
                    fixed, n = struct.unpack_from(">II", data, at + 4)
                    if fixed and n * fixed > len(data):
                        raise ValueError("stsz has more samples than the file holds")
                    tables[b"size"] = np.full(n, fixed, np.int64) if fixed else _ints(data, at + 12, n, ">u4", end)
                elif kind in (b"stco", b"co64"):
                    (n,) = struct.unpack_from(">I", data, at + 4)
                    tables[b"chunk"] = _ints(data, at + 8, n, ">u4" if kind == b"stco" else ">u8", end)
        close()
    except struct.error as e:
        raise ValueError("a box is cut short") from e
    if not out.n_boxes:
        raise ValueError("no boxes")
    return out


def demux(media: bytes, track: Track) -> bytes:
    """The bytes of all samples of a track in order."""
    view, parts, i = memoryview(media), [], 0
    new = np.flatnonzero(np.concatenate([[True], track.offsets[1:] != track.offsets[:-1] + track.sizes[:-1]])) if len(track.offsets) else []
    for i, j in zip(new, [*new[1:], len(track.offsets)], strict=True):
        parts.append(view[track.offsets[i] : track.offsets[j - 1] + track.sizes[j - 1]])
    return b"".join(parts)


def _mux_batch(text: pa.Array) -> pa.Array:
    return pa.array([mux((x.as_py() or "").encode()) for x in text], pa.binary())


def mux_column(text: Column) -> Column:
    """A container of each text's UTF-8 bytes; null counts as empty."""
    return F.arrow_udf(_mux_batch, "binary")(text)


PROBED = (
    "brand string, codec string, track_kind string, width int, height int, timescale long, duration long, n_samples long,"
    " keyframes long, keyframe_ranges array<struct<offset:long,length:long>>, n_bytes long, payload_bytes long, payload_sha256 string,"
    " tail_crc32 long, head_crc32 long, media_sha256 string, error string,"
    " tracks array<struct<codec:string,track_kind:string,timescale:long,duration:long,n_samples:long,keyframes:long,keyframe_ranges:array<struct<offset:long,length:long>>,payload_bytes:long,payload_sha256:string>>"
)


def _probe_row(media: bytes | None) -> dict | None:
    if media is None:
        return None
    row: dict = {"media_sha256": hashlib.sha256(media).hexdigest()}
    try:
        found = probe(media)
    except ValueError as e:
        return row | {"error": str(e)}
    row |= {"brand": found.brand, "n_bytes": found.unpadded, "tracks": []}
    for k, t in enumerate(found.tracks):
        payload = demux(media, t)
        one = {"codec": t.codec, "track_kind": t.kind, "timescale": t.timescale, "duration": t.duration, "n_samples": len(t.sizes), "keyframes": len(t.keyframes)}
        one |= {"keyframe_ranges": [{"offset": a, "length": n} for a, n in t.ranges()], "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest()}
        row["tracks"].append(one)
        if not k:
            first = payload[: int(t.sizes[0])] if len(t.sizes) else b""
            row |= one | {"width": t.width, "height": t.height, "tail_crc32": zlib.crc32(payload[-32:]), "head_crc32": zlib.crc32(first)}
    return row


_RANGE = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
_TRACK = pa.struct(
    [("codec", pa.string()), ("track_kind", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", pa.int64()), ("keyframe_ranges", _RANGE), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string())]
)
_PROBED = pa.struct(
    [("brand", pa.string()), ("codec", pa.string()), ("track_kind", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", pa.int64()), ("keyframe_ranges", _RANGE), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("head_crc32", pa.int64()), ("media_sha256", pa.string()), ("error", pa.string()), ("tracks", pa.list_(_TRACK))]
)


def _probe_batch(media: pa.Array) -> pa.Array:
    return pa.array([_probe_row(x.as_py()) for x in media], _PROBED)


def probe_column(media: Column) -> Column:
    """Codec, duration, keyframe ranges and digests of each container's first track, and of every track in ``tracks``.

    Null gives null.  What isn't a readable container has ``error`` and its own digest only.
    """
    return F.arrow_udf(_probe_batch, PROBED)(media)


def document_media(docs: DataFrame) -> DataFrame:
    """Each whole text (null: empty) stored as a container and read back by its sample tables.

    One row per input row, repeated rows included; equal texts have equal values; a null doc_id is kept and other columns are ignored.
    """
    stored = docs.select("doc_id", mux_column(F.col("text")).alias("media"))
    seen = stored.select("doc_id", F.octet_length("media").cast("long").alias("media_bytes"), probe_column(F.col("media")).alias("p"))
    first = F.col("p.keyframe_ranges")[0]
    feature = F.concat_ws(
        ";",
        F.concat_ws(":", F.lit("codec"), F.trim("p.codec")),
        F.concat(F.lit("size:"), F.col("p.width"), F.lit("x"), F.col("p.height")),
        F.concat(F.lit("duration:"), F.col("p.duration"), F.lit("/"), F.col("p.timescale")),
        F.concat(F.lit("keyframes:"), F.col("p.keyframes")),
        F.concat(F.lit("ranges:"), F.size("p.keyframe_ranges"), F.lit("@"), first["offset"], F.lit("+"), first["length"]),
        F.concat(F.lit("first:"), F.lpad(F.lower(F.hex("p.head_crc32")), 8, "0")),
    )
    return seen.select(
        "doc_id", "p.n_bytes", "p.payload_bytes", "p.payload_sha256", "p.tail_crc32", "media_bytes", "p.media_sha256", feature.alias("feature"),
        "p.codec", "p.timescale", "p.duration", "p.keyframe_ranges",
    )
