import hashlib
import struct
import zlib

import pytest

from tarnspark.llm import media


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 64, 576 * 64 + 1, 576 * 200])
def test_round_trip(n):
    raw = bytes(i % 251 for i in range(n))
    stored = media.mux(raw)
    found = media.probe(stored)
    (t,) = found.tracks
    payload = media.demux(stored, t)
    assert payload == media.pad(raw) and len(payload) % 576 == 0 and payload[:n] == raw and found.unpadded == n
    assert (t.codec, t.kind, t.width, t.height, t.duration) == ("raw ", "vide", 24, 24, len(payload) // 576)
    assert len(t.keyframes) == len(t.sizes) and sum(x for _, x in t.ranges()) == len(payload)
    (a, length), *rest = t.ranges()
    assert not rest and stored[a : a + length] == payload


def test_keyframes_variable_sizes_and_scattered_chunks():
    """Two chunks out of order, sizes from a table, one sync sample."""
    parts = media.box(b"mdat", b"CCCC", b"AAABB")

    def table(kind, *ints):
        return media.full(kind, 0, 0, struct.pack(f">{len(ints)}I", *ints))

    def moov(base):
        stbl = media.box(b"stbl", table(b"stsd", 1, 16, 0x61766331, 0, 0), table(b"stts", 2, 2, 3, 1, 4), table(b"stss", 1, 2), table(b"stsc", 2, 1, 2, 1, 2, 1, 1), table(b"stsz", 0, 3, 3, 2, 4), table(b"stco", 2, base + 12, base + 8))
        return media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"minf", stbl))))

    stored = moov(len(moov(0))) + parts
    (t,) = media.probe(stored).tracks
    assert t.codec == "avc1" and t.duration == 10
    assert media.demux(stored, t) == b"AAABBCCCC"
    assert [stored[a : a + n] for a, n in t.ranges()] == [b"BB"]


@pytest.mark.parametrize("bad", [b"", b"abc", b"\0\0\0\4moov", b"\0\0\0\x10stsz\0\0\0\0\0\0\0\0", media.mux(b"x")[:200]])
def test_damage_is_an_error_or_has_no_samples(bad):
    try:
        assert all(not len(t.sizes) for t in media.probe(bad).tracks)
    except ValueError:
        pass


def test_documents(spark):
    rows = [(1, "héllo", 7), (2, None, 7), (2, "", 7), (None, "héllo", 7), (3, "x" * 100_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media int")
    got = media.document_media(df).collect()
    assert len(got) == len(rows)
    for r, (i, t, _) in zip(got, rows, strict=True):
        raw = (t or "").encode()
        p = media.pad(raw)
        m = media.mux(raw)
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len(raw), len(p))
        assert (r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest())
    assert got[0].feature == got[3].feature and got[0].media_sha256 == got[3].media_sha256
    assert media.document_media(df.limit(0)).count() == 0


def test_fragments_and_every_track():
    """Two tracks; the samples of the second lie in two fragments, with sizes by table and by default."""

    def table(kind, flags, *ints):
        return media.full(kind, 0, flags, struct.pack(f">{len(ints)}I", *ints))

    def trak(number, kind, stbl):
        return media.box(b"trak", table(b"tkhd", 3, 0, 0, number), media.box(b"mdia", media.full(b"hdlr", 0, 0, struct.pack(">I4s", 0, kind)), media.box(b"minf", stbl)))

    empty = media.box(b"stbl", table(b"stsd", 0, 1, 16, 0x6D703461, 0, 0), table(b"stts", 0, 0), table(b"stsc", 0, 0), table(b"stsz", 0, 0, 0), table(b"stco", 0, 0))
    whole = lambda base: media.box(b"stbl", table(b"stsd", 0, 1, 16, 0x61766331, 0, 0), table(b"stts", 0, 1, 1, 5), table(b"stsc", 0, 1, 1, 1, 1), table(b"stsz", 0, 5, 1), table(b"stco", 0, 1, base))
    moov = lambda base: media.box(b"moov", trak(1, b"vide", whole(base)), trak(2, b"soun", empty), media.box(b"mvex", table(b"trex", 0, 2, 1, 7, 4, 0x10000)))
    head = len(moov(0))

    def moof(first):  # two runs: sizes and flags by table, then two samples of 4 bytes by default, the first a keyframe
        runs = lambda at: (table(b"trun", 0x601, 2, at, 3, 0, 2, 0x10000), table(b"trun", 0x4, 2, 0))
        size = len(media.box(b"moof", media.box(b"traf", table(b"tfhd", 0x20000, 2), *runs(0))))
        return media.box(b"moof", media.box(b"traf", table(b"tfhd", 0x20000, 2), *runs(size + 8 + first)))

    stored = moov(head + 8) + media.box(b"mdat", b"VIDEO") + moof(0) + media.box(b"mdat", b"AAABBCCCCDDDD") + moof(2) + media.box(b"mdat", b"..EEEFFGGGGHHHH")
    one, two = media.probe(stored).tracks
    assert (one.codec, one.kind, media.demux(stored, one)) == ("avc1", "vide", b"VIDEO")
    assert (two.codec, two.kind, media.demux(stored, two)) == ("mp4a", "soun", b"AAABBCCCCDDDDEEEFFGGGGHHHH")
    assert two.duration == 8 * 7 and [stored[two.offsets[k] :][: two.sizes[k]] for k in two.keyframes] == [b"AAA", b"CCCC", b"EEE", b"GGGG"]
    row = media._probe_row(stored)
    assert [t["payload_sha256"] for t in row["tracks"]] == [hashlib.sha256(x).hexdigest() for x in (b"VIDEO", b"AAABBCCCCDDDDEEEFFGGGGHHHH")]


def test_the_feature_is_read_from_the_samples(spark):
    df = spark.createDataFrame([(1, "aaaa"), (2, "bbbb"), (3, "aaaa")], "doc_id long, text string")
    a, b, c = (r.feature for r in media.document_media(df).collect())
    assert a == c != b
