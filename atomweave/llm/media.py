"""Media columns: ISO base media files as a binary column.

``mux`` stores bytes losslessly as the frames of one raw 8-bit video track, ``index`` walks the
nested boxes of any such file, decodes the sample tables (of movie fragments too) and returns codec, duration and the byte
ranges of the key frames, without touching the payload. ``payload`` reads the stored bytes back
through the sample tables.

Defined results: a null or empty content is one frame of filler; a file whose boxes are cut short or
contradict each other gives a row with ``error`` set and nulls elsewhere, never a failed job; repeated
rows give repeated results; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes in one stored frame (24 x 24 samples of 8 bits), the filler, frames in a chunk and from one key frame to the next.
FRAME, FILL, PER_CHUNK, GOP = 576, b"\xff", 16, 12
TIMESCALE, TICKS = 600, 24

#: Boxes whose content is boxes.
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"))

_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(content: bytes) -> bytes:
    """Filled up to a positive multiple of FRAME."""
    return content + FILL * (-len(content) % FRAME if content else FRAME)


def mux(content: bytes) -> bytes:
    """An ISO media file whose samples are ``pad(content)``; equal contents give equal files."""
    data = pad(content)
    n = len(data) // FRAME
    length = n * TICKS
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    chunks = -(-n // PER_CHUNK)
    runs = [(1, PER_CHUNK)] if chunks > 1 or n == PER_CHUNK else []
    if n % PER_CHUNK:
        runs.append((chunks, n % PER_CHUNK))
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", 24, 24), struct.pack(">IIIH", 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    keys = np.arange(1, n + 1, GOP, dtype=">u4")

    def moov(base: int) -> bytes:
        at = base + np.arange(chunks, dtype=np.int64) * (PER_CHUNK * FRAME)
        wide = len(data) + base > 0xFFFFFFFF
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, TICKS)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", first, per, 1) for first, per in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, length & 0xFFFFFFFF, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, length & 0xFFFFFFFF), bytes(8), struct.pack(">4H", 0, 0, 0, 0), _MATRIX, struct.pack(">II", 24 << 16, 24 << 16), flags=7)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, length & 0xFFFFFFFF, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = len(ftyp) + len(moov(0))
    return ftyp + moov(head + 8) + _box(b"mdat", data)


def walk(buf: memoryview, start: int, end: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int, int]]:
    """(path, first byte, first byte of the content, end) of every box, depth first, without recursion."""
    todo = [(start, end, path)]
    while todo:
        at, stop, up = todo.pop()
        if at + 8 > stop:
            continue
        size, kind = struct.unpack_from(">I4s", buf, at)
        head = 8
        if size == 1:
            if at + 16 > stop:
                raise ValueError("short box")
            (size,), head = struct.unpack_from(">Q", buf, at + 8), 16
        elif size == 0:
            size = stop - at
        if size < head or at + size > stop:
            raise ValueError(f"box {kind!r} leaves its parent")
        if kind == b"uuid":
            head += 16
        yield (*up, kind), at, at + head, at + size
        todo.append((at + size, stop, up))
        if kind in CONTAINERS:
            todo.append((at + head, at + size, (*up, kind)))


def _numbers(buf: memoryview, at: int, end: int, dtype: str, n: int) -> np.ndarray:
    if n * np.dtype(dtype).itemsize > end - at:
        raise ValueError("table is longer than its box")
    return np.frombuffer(buf, dtype, n, at).astype(np.int64)


#: Flags of a sample that isn't a key frame.
_NO_KEY = 0x10000


class Fragments:
    """Samples of movie fragments, by track: runs of (offset, size, key, duration)."""

    def __init__(self) -> None:
        self.defaults: dict[int, tuple[int, int, int]] = {}  # duration, size, flags
        self.runs: dict[int, list[tuple[np.ndarray, ...]]] = {}
        self.moof = self.next = self.base = self.track = 0
        self.own: list[int] = [0, 0, 0]

    def take(self, buf: memoryview, path: tuple[bytes, ...], start: int, at: int, end: int) -> None:
        kind, flags = path[-1], 0
        if kind in (b"trex", b"tfhd", b"trun"):
            flags = struct.unpack_from(">I", buf, at)[0] & 0xFFFFFF
        if kind == b"trex":
            track, _, *values = struct.unpack_from(">5I", buf, at + 4)
            self.defaults[track] = tuple(values)
        elif kind == b"moof":
            self.moof = self.next = start
        elif kind == b"tfhd":
            (self.track,) = struct.unpack_from(">I", buf, at + 4)
            self.own, at = list(self.defaults.get(self.track, (0, 0, 0))), at + 8
            self.base = self.moof if flags & 0x20000 else self.next
            if flags & 1:
                (self.base,), at = struct.unpack_from(">Q", buf, at), at + 8
            at += 4 * bool(flags & 2)
            for k, bit in enumerate((8, 16, 32)):
                if flags & bit:
                    (self.own[k],), at = struct.unpack_from(">I", buf, at), at + 4
            self.next = self.base
        elif kind == b"trun":
            (n,), at = struct.unpack_from(">I", buf, at + 4), at + 8
            if flags & 1:
                self.next, at = self.base + struct.unpack_from(">i", buf, at)[0], at + 4
            first = None
            if flags & 4:
                (first,), at = struct.unpack_from(">I", buf, at), at + 4
            given = [bool(flags & bit) for bit in (0x100, 0x200, 0x400, 0x800)]
            if not given[1] and (not self.own[1] or n * self.own[1] > len(buf)):
                raise ValueError("samples are longer than the file")
            table = _numbers(buf, at, end, ">u4", n * sum(given)).reshape(n, sum(given))
            duration, size, marks = (table[:, sum(given[:k])] if given[k] else np.full(n, self.own[k], np.int64) for k in range(3))
            if n and first is not None:
                marks = np.concatenate(([first], marks[1:]))
            self.runs.setdefault(self.track, []).append((self.next + np.cumsum(size) - size, size, marks & _NO_KEY == 0, duration))
            self.next += int(size.sum())

    def join(self, t: dict, length: int) -> None:
        """Adds a track's samples to those of its tables."""
        found = self.runs.get(t.get("id"))
        if not found:
            return
        offset, size, key, duration = (np.concatenate(p) for p in zip(*found, strict=True))
        if len(size) and (offset.min() < 0 or (offset + size).max() > length):
            raise ValueError("a sample lies beyond the file")
        t["key"] = np.concatenate((t["key"], np.flatnonzero(key) + len(t["size"])))
        t["offset"], t["size"] = np.concatenate((t["offset"], offset)), np.concatenate((t["size"], size))
        t["duration"] = t.get("duration", 0) or int(duration.sum())


def tracks(media: bytes) -> list[dict]:
    """Per track: codec, timescale, duration, and arrays offset, size, key (sample numbers from 0) of its samples, those of fragments too."""
    buf, out, fragments = memoryview(media), [], Fragments()
    for path, start, at, end in walk(buf, 0, len(buf)):
        kind = path[-1]
        if kind == b"moof" or path[0] == b"moof" or kind == b"trex":
            fragments.take(buf, path, start, at, end)
            continue
        if kind == b"trak":
            out.append({})
        if b"trak" not in path or len(path) < 3:
            continue
        t = out[-1]
        if kind == b"tkhd":
            (t["id"],) = struct.unpack_from(">I", buf, at + (20 if buf[at] == 1 else 12))
        elif kind == b"mdhd":
            wide = buf[at] == 1
            t["timescale"], t["duration"] = struct.unpack_from(">IQ" if wide else ">II", buf, at + (20 if wide else 12))
        elif kind == b"hdlr":
            t["handler"] = bytes(buf[at + 8 : at + 12]).decode("latin-1")
        elif kind == b"stsd" and end - at >= 16:
            t["codec"] = bytes(buf[at + 12 : at + 16]).decode("latin-1")
        elif kind == b"stts":
            (n,) = struct.unpack_from(">I", buf, at + 4)
            t["stts"] = _numbers(buf, at + 8, end, ">u4", 2 * n).reshape(-1, 2)
        elif kind == b"stsc":
            (n,) = struct.unpack_from(">I", buf, at + 4)
            t["stsc"] = _numbers(buf, at + 8, end, ">u4", 3 * n).reshape(-1, 3)
        elif kind == b"stss":
            (n,) = struct.unpack_from(">I", buf, at + 4)
            t["stss"] = _numbers(buf, at + 8, end, ">u4", n) - 1
        elif kind in (b"stco", b"co64"):
            (n,) = struct.unpack_from(">I", buf, at + 4)
            t["chunks"] = _numbers(buf, at + 8, end, ">u4" if kind == b"stco" else ">u8", n)
        elif kind == b"stsz":
            one, n = struct.unpack_from(">II", buf, at + 4)
            if one and one * n > len(buf):
                raise ValueError("samples are longer than the file")
            t["size"] = np.full(n, one, np.int64) if one else _numbers(buf, at + 12, end, ">u4", n)
    for t in out:
        size, chunks, runs = t.get("size", np.zeros(0, np.int64)), t.get("chunks", np.zeros(0, np.int64)), t.get("stsc", np.zeros((0, 3), np.int64))
        if len(runs) and len(chunks):
            until = np.append(runs[1:, 0], len(chunks) + 1)
            if (until < runs[:, 0]).any() or runs[0, 0] != 1:
                raise ValueError("chunk runs are out of order")
            per = np.repeat(runs[:, 1], until - runs[:, 0])
        else:
            per = np.zeros(0, np.int64)
        if per.sum() != len(size) or len(per) != len(chunks):
            raise ValueError("sample tables disagree")
        before = np.concatenate(([0], np.cumsum(size)))[: len(size)]
        first = np.cumsum(per) - per
        t["offset"] = np.repeat(chunks, per) + before - np.repeat(before[np.minimum(first, max(len(size) - 1, 0))], per) if len(size) else size
        if len(size) and (t["offset"] + size).max() > len(buf):
            raise ValueError("a sample lies beyond the file")
        t["key"] = t["stss"] if "stss" in t else np.arange(len(size))
        if len(t["key"]) and not 0 <= t["key"].min() <= t["key"].max() < len(size):
            raise ValueError("a key frame is no sample")
        t["size"] = size
        fragments.join(t, len(buf))
    return out


def payload(media: bytes, track: int = 0) -> bytes:
    """The samples of a track in order, read through its tables; neighbouring ranges are read at once."""
    t = tracks(media)[track]
    at, size = t["offset"], t["size"]
    if not len(at):
        return b""
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1] + size[:-1]))
    last = np.append(first[1:], len(at)) - 1
    return b"".join(media[a:b] for a, b in zip(at[first].tolist(), (at[last] + size[last]).tolist(), strict=True))


INDEX = pa.schema(
    [
        ("doc_id", pa.int64()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()),
        ("key_offset", pa.list_(pa.int64())), ("key_size", pa.list_(pa.int64())), ("error", pa.string()),
    ]
)
_INDEX_DDL = "doc_id long, codec string, timescale long, duration long, n_samples long, key_offset array<long>, key_size array<long>, error string"


def describe(media: bytes | None) -> dict:
    """One row of ``index``: the first video track, else the first track."""
    none = dict.fromkeys(("codec", "timescale", "duration", "n_samples", "key_offset", "key_size"))
    try:
        found = tracks(media or b"")
        if not found:
            return none | {"error": "no track"}
        t = next((x for x in found if x.get("handler") == "vide"), found[0])
        return {
            "codec": t.get("codec"), "timescale": t.get("timescale"), "duration": t.get("duration"), "n_samples": len(t["size"]),
            "key_offset": t["offset"][t["key"]].tolist(), "key_size": t["size"][t["key"]].tolist(), "error": None,
        }
    except (ValueError, struct.error, IndexError) as e:
        return none | {"error": str(e)[:200]}


def index(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Codec, duration and key-frame byte ranges of a binary column; one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([{"doc_id": i.as_py(), **describe(m.as_py())} for i, m in zip(b.column(0), b.column(1), strict=True)], schema=INDEX)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, _INDEX_DDL)


def feature(row: dict) -> str:
    """The index as one line; the key-frame ranges as count, first, last and a checksum of all."""
    ranges = list(zip(row["key_offset"] or [], row["key_size"] or [], strict=True))
    crc = zlib.crc32(",".join(f"{a}+{b}" for a, b in ranges).encode())
    ends = ";".join(f"{a}+{b}" for a, b in (ranges[:1] + ranges[-1:]))
    return f"codec={row['codec']};timescale={row['timescale']};duration={row['duration']};samples={row['n_samples']};keys={len(ranges)};{ends};crc={crc}"


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as a media file and describes what is read back from it, one file in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text in zip(b.column(0), b.column(1), strict=True):
                content = (text.as_py() or "").encode("utf-8")
                media = mux(content)
                data = payload(media)
                rows.append(
                    {
                        "doc_id": i.as_py(), "n_bytes": len(content), "payload_bytes": len(data), "payload_sha256": hashlib.sha256(data).hexdigest(), "tail_crc32": zlib.crc32(data[-32:]),
                        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(describe(media)),
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=_DIGEST)

    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ddl)
