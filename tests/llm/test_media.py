import hashlib
import struct
import zlib

import pytest

from atomweave.llm import media


@pytest.mark.parametrize("content", [b"", b"a", b"x" * 575, b"x" * 576, b"y" * 577, bytes(range(256)) * 200, b"q" * (576 * 16), b"q" * (576 * 49 + 5)])
def test_round_trip(content):
    f = media.mux(content)
    assert media.payload(f) == media.pad(content) and len(media.pad(content)) % 576 == 0 and media.pad(content)
    d = media.describe(f)
    n = len(media.pad(content)) // 576
    assert d["error"] is None and d["codec"] == "raw " and d["n_samples"] == n and d["duration"] == n * 24 and len(d["key_offset"]) == -(-n // 12)
    assert all(f[o : o + s] == media.pad(content)[576 * 12 * k : 576 * 12 * k + s] for k, (o, s) in enumerate(zip(d["key_offset"], d["key_size"], strict=True)))


def test_damaged():
    f = media.mux(b"hello" * 500)
    for cut in range(0, len(f), 37):
        media.describe(f[:cut])  # never raises
    for at in range(0, 700, 11):
        media.describe(f[:at] + b"\xff\xff\xff\xff" + f[at + 4 :])
    assert media.describe(None)["error"] and media.describe(b"junkjunkjunk")["error"]


def test_other_layouts():
    def box(kind, body):
        return struct.pack(">I", len(body) + 8) + kind + body

    full = lambda kind, body: box(kind, bytes(4) + body)
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1) + box(b"avc1", bytes(78))) + full(b"stsz", struct.pack(">5I", 0, 3, 10, 20, 30)) + full(b"stsc", struct.pack(">7I", 2, 1, 2, 1, 2, 1, 1)) + full(b"co64", struct.pack(">I2Q", 2, 0, 100)) + full(b"stss", struct.pack(">2I", 1, 3)))
    mdhd = box(b"mdhd", bytes([1, 0, 0, 0]) + struct.pack(">QQIQ", 0, 0, 90000, 1 << 33))
    moov = box(b"moov", box(b"trak", box(b"mdia", mdhd + full(b"hdlr", bytes(4) + b"vide") + box(b"minf", stbl))))
    d = media.describe(moov + struct.pack(">I", 0) + b"mdat" + bytes(400))
    assert d == {"codec": "avc1", "timescale": 90000, "duration": 1 << 33, "n_samples": 3, "key_offset": [100], "key_size": [30], "error": None}


def test_fragments():
    """A movie without samples and two fragments: sizes by sample and by default, offsets from the fragment and one after another."""

    def box(kind, body):
        return struct.pack(">I", len(body) + 8) + kind + body

    full = lambda kind, flags, body: box(kind, struct.pack(">I", flags) + body)
    tables = box(b"stbl", full(b"stsd", 0, struct.pack(">I", 1) + box(b"hvc1", bytes(78))) + full(b"stsz", 0, bytes(8)) + full(b"stsc", 0, bytes(4)) + full(b"stco", 0, bytes(4)))
    mdia = box(b"mdia", full(b"mdhd", 0, struct.pack(">4I", 0, 0, 1000, 0)) + full(b"hdlr", 0, bytes(4) + b"vide") + box(b"minf", tables))
    moov = box(b"moov", box(b"trak", full(b"tkhd", 0, struct.pack(">3I", 0, 0, 7)) + mdia) + box(b"mvex", full(b"trex", 0, struct.pack(">5I", 7, 1, 40, 5, 0x10000))))
    runs = lambda offset: box(b"traf", full(b"tfhd", 0x20000, struct.pack(">I", 7)) + full(b"trun", 0x205, struct.pack(">IiI", 2, offset, 0) + struct.pack(">2I", 3, 4)) + full(b"trun", 0, struct.pack(">I", 2)))
    moof = box(b"moof", full(b"mfhd", 0, bytes(4)) + runs(len(box(b"moof", full(b"mfhd", 0, bytes(4)) + runs(0))) + 8))
    data = moov + moof + box(b"mdat", b"aaabbbbcccccddddd") + moof + box(b"mdat", b"AAABBBBCCCCCDDDDD")
    d = media.describe(data)
    first = [len(moov) + len(moof) + 8, len(moov) + 2 * len(moof) + 33]
    assert d == {"codec": "hvc1", "timescale": 1000, "duration": 320, "n_samples": 8, "key_offset": first, "key_size": [3, 3], "error": None}
    assert media.payload(data) == b"aaabbbbcccccdddddAAABBBBCCCCCDDDDD"
    for cut in range(0, len(data), 5):
        media.describe(data[:cut])
    for at in range(0, len(data) - 4, 3):
        media.describe(data[:at] + b"\xff\xff\xff\xff" + data[at + 4 :])


def test_query(spark, odd, odd_rows, empty):
    got = media.store_and_read(odd).collect()
    assert len(got) == len(odd_rows)
    for r, (i, t) in zip(got, odd_rows, strict=True):
        raw = (t or "").encode()
        data = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
    assert media.store_and_read(empty).count() == 0
    files = spark.createDataFrame([(1, bytearray(media.mux(b"abc")), 5), (2, None, 5)], "doc_id long, media binary, codec int")
    assert [(r.codec, r.error) for r in media.index(files).orderBy("doc_id").collect()] == [("raw ", None), (None, "no track")]
