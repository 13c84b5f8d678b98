"""Binary trajectories: TRR, XTC, DCD and AMBER NetCDF (classic). Lengths become nm, times ps."""

from __future__ import annotations

import io
import itertools
import struct
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO, NamedTuple

import numpy as np

from ..functions.geometry import check_box, from_lengths_angles
from .model import FormatError, Frame, Structure


def _box(v: np.ndarray) -> list[float] | None:
    return check_box(v.ravel().tolist()) if np.any(v) else None


# -- TRR: XDR, big-endian, single or double precision --------------------------------------------------------------

_TRR_MAGIC, _TRR_NAME = 1993, b"GMX_trn_file"


def trr_frames(data: bytes, parts: str = "xvf"):
    """Frames one after another; only the parts asked for are decoded (coordinates always)."""
    at = 0
    while at + 24 <= len(data):
        magic, _, n = struct.unpack_from(">3i", data, at)
        if magic != _TRR_MAGIC or data[at + 12 : at + 12 + n] != _TRR_NAME:
            raise FormatError("not a TRR frame")
        at += 12 + (n + 3 & ~3)
        ir, e, box, vir, pres, top, sym, x, v, f, natoms, step, nre = struct.unpack_from(">13i", data, at)
        at += 52
        width = box // 9 if box else (x or v or f) // (3 * max(1, natoms))
        if width not in (4, 8):
            raise FormatError("TRR numbers have 4 or 8 bytes")
        kind = f">f{width}"
        time = struct.unpack_from(">d" if width == 8 else ">f", data, at)[0]
        at += 2 * width
        if at + box + vir + pres + x + v + f > len(data):
            raise FormatError("a TRR frame is cut short")
        frame = Frame(time)
        if box:
            frame.box = _box(np.frombuffer(data, kind, 9, at).astype(float))
        at += box + ir + e + vir + pres + top + sym
        for name, size, part in (("xyz", x, "x"), ("velocity", v, "v"), ("force", f, "f")):
            if size and (part in parts or part == "x"):
                setattr(frame, name, np.frombuffer(data, kind, 3 * natoms, at).astype(float).reshape(-1, 3))
            at += size
        if frame.xyz is None:
            frame.xyz = np.full((natoms, 3), np.nan)
        yield frame


def read_trr(data: bytes) -> Structure:
    return Structure(frames=list(trr_frames(data)))


def write_trr(frames: list[Frame], first_step: int = 0) -> bytes:
    """Single precision, with the velocities and forces that frames hold."""
    out = []
    for k, f in enumerate(frames):
        n = len(f.xyz)
        arrays = [np.asarray(a, ">f4").tobytes() if a is not None else b"" for a in (f.xyz, f.velocity, f.force)]
        box = np.asarray(f.box if f.box is not None else np.zeros(9), ">f4").tobytes()
        head = struct.pack(">3i", _TRR_MAGIC, 13, 12) + _TRR_NAME + struct.pack(">13i", 0, 0, 36, 0, 0, 0, 0, *map(len, arrays), n, first_step + k, 0)
        out += [head, struct.pack(">2f", f.time, 0.0), box, *arrays]
    return b"".join(out)


# -- XTC: coordinates as packed integers ----------------------------------------------------------------------------

_XTC_MAGIC, _XTC_LONG, _FIRST_SMALL = 1995, 2023, 9
# Ranges that small differences are packed in, floor(2 ** (i / 3)) but for three entries.
_RANGES = [0] * _FIRST_SMALL + [{37: 5060, 57: 524287, 69: 8388607}.get(i, int(2 ** (i // 3) * (1, 2 ** (1 / 3), 4 ** (1 / 3))[i % 3])) for i in range(_FIRST_SMALL, 73)]


class _Bits:
    """Numbers from a stream of bits, the highest first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        self.at += n
        if last > len(self.data):
            raise FormatError("an XTC frame is cut short")
        return (int.from_bytes(self.data[first:last], "big") >> (8 * last - self.at)) & ((1 << n) - 1)

    def triple(self, n: int, sizes: tuple[int, int, int]) -> tuple[int, int, int]:
        """Three numbers below sizes in n bits, whose whole bytes stand lowest first."""
        whole, rest = divmod(n, 8)
        value = int.from_bytes(self.take(8 * whole).to_bytes(whole, "big"), "little") if whole else 0
        if rest:
            value |= self.take(rest) << (8 * whole)
        value, z = divmod(value, sizes[2])
        x, y = divmod(value, sizes[1])
        return x, y, z


def _unpacked(bits: _Bits, natoms: int, low: tuple, high: tuple, small: int) -> np.ndarray:
    """The integer coordinates of a frame: whole triples, each with a run of differences from its neighbours behind it."""
    sizes = tuple(b - a + 1 for a, b in zip(low, high, strict=True))
    apart = max(sizes) > 0xFFFFFF
    each, joint = [s.bit_length() for s in sizes], (sizes[0] * sizes[1] * sizes[2]).bit_length()
    out: list[tuple[int, int, int]] = []
    run = 0
    while len(out) < natoms:
        p = tuple(map(bits.take, each)) if apart else bits.triple(joint, sizes)
        last = (p[0] + low[0], p[1] + low[1], p[2] + low[2])
        change = 0
        if bits.take(1):
            run = bits.take(5)
            change = run % 3 - 1
            run -= run % 3
        if not run:
            out.append(last)
        width, half = _RANGES[small], _RANGES[small] // 2
        for k in range(0, run, 3):
            d = bits.triple(small, (width, width, width))
            now = tuple(a + b - half for a, b in zip(last, d, strict=True))
            out += [now] if k else [now, last]  # the first of a run stands before the whole triple
            last = now
        small += change
    if len(out) != natoms:
        raise FormatError("an XTC frame holds another number of atoms")
    return np.array(out, np.int64).reshape(-1, 3)


def xtc_frames(data: bytes) -> Iterator[Frame]:
    at = 0

    def take(kind: str) -> tuple:
        nonlocal at
        size = struct.calcsize(">" + kind)
        if at + size > len(data):
            raise FormatError("an XTC file is cut short")
        at += size
        return struct.unpack_from(">" + kind, data, at - size)

    while at < len(data):
        magic, natoms, _ = take("3i")
        if magic not in (_XTC_MAGIC, _XTC_LONG):
            raise FormatError("not an XTC frame")
        (time,) = take("f")
        frame = Frame(time, _box(np.array(take("9f"), float)))
        if take("i")[0] != natoms:
            raise FormatError("an XTC frame holds another number of atoms")
        if natoms <= 9:
            frame.xyz = np.array(take(f"{3 * natoms}f"), float).reshape(-1, 3)
        else:
            (precision,) = take("f")
            low, high, (small,), (size,) = take("3i"), take("3i"), take("i"), take("q" if magic == _XTC_LONG else "i")
            (body,) = take(f"{size}s")
            at += -size % 4
            frame.xyz = _unpacked(_Bits(body), natoms, low, high, small) / precision
        yield frame


def read_xtc(data: bytes) -> Structure:
    return Structure(frames=list(xtc_frames(data)))


def write_xtc(frames: list[Frame], first_step: int = 0, precision: float = 1000.0) -> bytes:
    """Whole triples only, without runs of differences: larger than need be, read by every reader."""
    out = []
    for k, f in enumerate(frames):
        n = len(f.xyz)
        box = np.asarray(f.box if f.box is not None else np.zeros(9), ">f4").tobytes()
        out += [struct.pack(">3if", _XTC_MAGIC, n, first_step + k, f.time), box, struct.pack(">i", n)]
        if n <= 9:
            out.append(np.asarray(f.xyz, ">f4").tobytes())
            continue
        whole = np.rint(np.asarray(f.xyz, float) * precision).astype(np.int64)
        low, high = whole.min(axis=0), whole.max(axis=0)
        if np.abs(whole).max() > 2**31 - 3:
            raise FormatError("coordinates are too large for this precision")
        sizes = [int(s) for s in high - low + 1]
        apart = max(sizes) > 0xFFFFFF
        widths = [s.bit_length() for s in sizes] if apart else [(sizes[0] * sizes[1] * sizes[2]).bit_length()]
        total, length = 0, 0
        pieces: list[bytes] = []
        for x, y, z in (whole - low).tolist():
            if apart:
                for v, w in zip((x, y, z), widths, strict=True):
                    total, length = total << w | v, length + w
            else:
                (w,) = widths
                value, rest = (x * sizes[1] + y) * sizes[2] + z, w % 8
                raw = value & ((1 << (w - rest)) - 1)
                packed = int.from_bytes(raw.to_bytes(w // 8, "little"), "big") << rest | value >> (w - rest)
                total, length = total << w | packed, length + w
            total, length = total << 1, length + 1
            if length > 4096:
                keep = length % 8
                pieces.append((total >> keep).to_bytes(length // 8, "big"))
                total, length = total & ((1 << keep) - 1), keep
        pieces.append((total << (-length % 8)).to_bytes(-(-length // 8), "big"))
        body = b"".join(pieces)
        out += [struct.pack(">f", precision), low.astype(">i4").tobytes(), high.astype(">i4").tobytes(), struct.pack(">2i", _FIRST_SMALL, len(body)), body, bytes(-len(body) % 4)]
    return b"".join(out)


# -- DCD: records of a Fortran program, either byte order ----------------------------------------------------------


class _DcdHead(NamedTuple):
    """What the head of a DCD file says; size: its bytes."""

    order: str
    start: int
    every: int
    delta: float
    natoms: int
    free: np.ndarray | None  # of later frames, where other atoms stay as in the first
    cell: bool
    fourth: bool
    size: int

    def frame_bytes(self, first: bool) -> int:
        n = self.natoms if first or self.free is None else len(self.free)
        return 56 * self.cell + (3 + self.fourth) * (4 * n + 8)


class CutShortError(FormatError):
    """The bytes end within a record."""


def _dcd_record(data: bytes, at: int, order: str) -> tuple[bytes, int]:
    """The record at a place, and the place behind it."""
    (n,) = struct.unpack_from(order + "i", data, at)
    body = data[at + 4 : at + 4 + n]
    if len(body) < n:
        raise CutShortError("a DCD record is cut short")
    if n < 0 or struct.unpack_from(order + "i", data, at + 4 + n)[0] != n:
        raise FormatError("a DCD record is damaged")
    return body, at + n + 8


def _dcd_head(data: bytes) -> _DcdHead:
    order = "<" if data[:4] == struct.pack("<i", 84) else ">"
    if struct.unpack_from(order + "i", data, 0)[0] != 84 or data[4:8] != b"CORD":
        raise FormatError("not a DCD file")
    head, at = _dcd_record(data, 0, order)
    number = lambda k: struct.unpack_from(order + "i", head, 4 + 4 * k)[0]
    charmm = number(19)
    delta = struct.unpack_from(order + ("f" if charmm else "d"), head, 40)[0]
    _, at = _dcd_record(data, at, order)
    count, at = _dcd_record(data, at, order)
    free = None
    if number(8):
        listed, at = _dcd_record(data, at, order)
        free = np.frombuffer(listed, order + "i4") - 1
    return _DcdHead(order, number(1), number(2), delta, struct.unpack(order + "i", count)[0], free, bool(charmm and number(10)), bool(charmm and number(11)), at)


#: DCD and NetCDF give every frame as many places. In the place of an atom that a frame lacks stand NaNs of these bits, which no arithmetic makes.
_ABSENT = 0x7FC0A70A


def _marked(xyz: np.ndarray, absent: np.ndarray | None, order: str) -> np.ndarray:
    """Coordinates in angstrom as 4-byte numbers, absent atoms marked."""
    out = (xyz * 10).astype(order + "f4")
    if absent is not None:
        out.view(order + "u4")[absent] = _ABSENT
    return out


def _absent(packed: np.ndarray) -> np.ndarray | None:
    """Which rows of three numbers as they stand in the file are marked, None if none is."""
    if packed.dtype.itemsize != 4:
        return None
    found = (packed.view(packed.dtype.str.replace("f", "u")) == _ABSENT).all(axis=1)
    return found if found.any() else None


def read_dcd(data: bytes) -> Structure:
    head = _dcd_head(data)
    at = head.size

    def record() -> bytes:
        nonlocal at
        body, at = _dcd_record(data, at, head.order)
        return body

    out, base = Structure(), None
    while at < len(data):
        box = None
        if head.cell:
            a, g, b, bt, al, c = struct.unpack(head.order + "6d", record())
            if a:
                angles = [np.degrees(np.arccos(v)) if abs(v) <= 1 else v for v in (al, bt, g)]
                box = from_lengths_angles(a * 0.1, b * 0.1, c * 0.1, *(round(float(v), 9) for v in angles))
        packed = np.ascontiguousarray(np.array([np.frombuffer(record(), head.order + "f4") for _ in range(3)], head.order + "f4").T)
        xyz, absent = packed.astype(float) * 0.1, _absent(packed)
        if head.fourth:
            record()
        if head.free is not None and base is not None:
            whole = base.copy()
            whole[head.free] = xyz
            xyz = whole
            if absent is not None:
                absent = np.isin(np.arange(len(whole)), head.free[absent])
        elif base is None:
            base = xyz
        if len(xyz) != head.natoms:
            raise FormatError("a DCD frame has another number of atoms")
        out.frames.append(Frame((head.start + len(out.frames) * head.every) * head.delta, box, xyz, absent=absent))
    return out


def stream_dcd(frames: Iterable[Frame], out: BinaryIO) -> int:
    """Little-endian, with a unit cell in every frame; one frame is held, their number and step go into the head at the end."""
    record = lambda b: struct.pack("<i", len(b)) + b + struct.pack("<i", len(b))

    def head(n: int, step: float, natoms: int) -> bytes:
        first = b"CORD" + struct.pack("<9i", n, 0, 1, 0, 0, 0, 0, 0, 0) + struct.pack("<f", step) + struct.pack("<10i", 1, 0, 0, 0, 0, 0, 0, 0, 0, 24)
        return record(first) + record(struct.pack("<i", 1) + b" " * 80) + record(struct.pack("<i", natoms))

    n, natoms, began, step = 0, 0, 0.0, 0.0
    for n, f in enumerate(frames, 1):
        if n == 1:
            natoms, began = len(f.xyz), f.time
            out.write(head(0, 0.0, natoms))
        elif n == 2:
            step = f.time - began
        if len(f.xyz) != natoms:
            raise FormatError("all frames of a DCD file have one number of atoms")
        cell = [0.0] * 6
        if f.box is not None:
            v = np.array(f.box).reshape(3, 3)
            m = np.linalg.norm(v, axis=1)
            cos = lambda i, j: float(v[i] @ v[j] / m[i] / m[j])  # noqa: B023, E731
            cell = [m[0] * 10, cos(0, 1), m[1] * 10, cos(0, 2), cos(1, 2), m[2] * 10]
        out.write(record(struct.pack("<6d", *cell)))
        packed = _marked(f.xyz, f.absent, "<")
        for k in range(3):
            out.write(record(packed[:, k].tobytes()))
    out.seek(0)
    out.write(head(n, step, natoms))
    out.seek(0, io.SEEK_END)
    return n


def write_dcd(frames: list[Frame]) -> bytes:
    out = io.BytesIO()
    stream_dcd(frames, out)
    return out.getvalue()


# -- NetCDF classic, AMBER convention ------------------------------------------------------------------------------

_NC_TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


class _NcLayout(NamedTuple):
    """Variables (dimensions, type, bytes a record, place), number and bytes of records, and where the first begins."""

    variables: dict
    records: int
    record: int
    first: int


def _netcdf_layout(data: bytes) -> _NcLayout:
    if data[:3] != b"CDF" or data[3] not in (1, 2):
        raise FormatError("not a classic NetCDF file")
    at, offset = 4, ">q" if data[3] == 2 else ">i"

    def number(kind: str = ">i") -> int:
        nonlocal at
        (v,) = struct.unpack_from(kind, data, at)
        at += struct.calcsize(kind)
        return v

    def name() -> str:
        nonlocal at
        n = number()
        v = data[at : at + n].decode()
        at += n + 3 & ~3
        return v

    def attributes() -> dict:
        nonlocal at
        number()
        out = {}
        for _ in range(number()):
            key, kind, n = name(), number(), number()
            size = np.dtype(_NC_TYPES[kind]).itemsize * n
            out[key] = data[at : at + size]
            at += size + 3 & ~3
        return out

    records = number()
    number()
    dims = [(name(), number()) for _ in range(number())]
    attributes()
    number()
    variables = {}
    for _ in range(number()):
        key = name()
        shape = [dims[number()] for _ in range(number())]
        attributes()
        kind, size = number(), number()
        variables[key] = (shape, np.dtype(_NC_TYPES[kind]), size, number(offset))
    moving = [v for v in variables.values() if v[0] and v[0][0][1] == 0]
    return _NcLayout(variables, records, sum(v[2] for v in moving), min((v[3] for v in moving), default=len(data)))


def read_netcdf(data: bytes) -> Structure:
    variables, records, record, _ = _netcdf_layout(data)

    def packed(key: str, k: int) -> np.ndarray | None:
        if key not in variables:
            return None
        shape, kind, _, begin = variables[key]
        per = [n for _, n in shape]
        moving = bool(per) and per[0] == 0
        per = per[1:] if moving else per
        return np.frombuffer(data, kind, int(np.prod(per, dtype=int)), begin + k * record * moving).reshape(per)

    def value(key: str, k: int) -> np.ndarray | None:
        found = packed(key, k)
        return None if found is None else found.astype(float)

    out = Structure()
    for k in range(records):
        lengths, angles, time = value("cell_lengths", k), value("cell_angles", k), value("time", k)
        box = from_lengths_angles(*(lengths * 0.1), *angles) if lengths is not None and lengths.any() else None
        velocity, force, xyz = value("velocities", k), value("forces", k), packed("coordinates", k)
        out.frames.append(Frame(float(time) if time is not None else float(k), box, xyz.astype(float) * 0.1, None if velocity is None else velocity * 0.1, force, _absent(xyz)))
    return out


def stream_netcdf(frames: Iterable[Frame], out: BinaryIO, boxed: bool) -> int:
    """One frame is held, their number goes into the head at the end; boxed: every frame has a box, and boxes are written."""
    frames = iter(frames)
    first = next(frames, None)
    n = len(first.xyz) if first else 0
    pad = lambda b: b + bytes(-len(b) % 4)
    name = lambda s: struct.pack(">i", len(s)) + pad(s.encode())
    text = lambda k, v: name(k) + struct.pack(">2i", 2, len(v)) + pad(v.encode())
    dims = [("frame", 0), ("atom", n), ("spatial", 3), ("cell_spatial", 3), ("cell_angular", 3)]
    items = [("time", [0], ">f4", [("units", "picosecond")]), ("coordinates", [0, 1, 2], ">f4", [("units", "angstrom")])]
    if boxed:
        items += [("cell_lengths", [0, 3], ">f8", [("units", "angstrom")]), ("cell_angles", [0, 4], ">f8", [("units", "degree")])]
    sizes = {"time": 4, "coordinates": 12 * n, "cell_lengths": 24, "cell_angles": 24}
    globals_ = [("Conventions", "AMBER"), ("ConventionVersion", "1.0"), ("program", "atomweave"), ("programVersion", "0.1")]

    def head(begin: int) -> bytes:
        out = [b"CDF\x02", struct.pack(">i", 0), struct.pack(">2i", 10, len(dims)), *[name(d) + struct.pack(">i", k) for d, k in dims]]
        out += [struct.pack(">2i", 12, len(globals_)), *[text(*g) for g in globals_], struct.pack(">2i", 11, len(items))]
        for key, shape, kind, attrs in items:
            code = {">f4": 5, ">f8": 6}[kind]
            out.append(name(key) + struct.pack(f">i{len(shape)}i", len(shape), *shape) + struct.pack(">2i", 12, len(attrs)) + b"".join(text(*a) for a in attrs) + struct.pack(">2iq", code, sizes[key], begin))
            begin += sizes[key]
        return b"".join(out)

    out.write(head(len(head(0))))
    k = 0
    for k, f in enumerate(itertools.chain([first], frames) if first else (), 1):
        if len(f.xyz) != n:
            raise FormatError("all frames of a NetCDF file have one number of atoms")
        out.write(np.array(f.time, ">f4").tobytes() + _marked(f.xyz, f.absent, ">").tobytes())
        if boxed:
            v = np.array(f.box).reshape(3, 3)
            m = np.linalg.norm(v, axis=1)
            out.write((m * 10).astype(">f8").tobytes())
            out.write(np.array([np.degrees(np.arccos(v[i] @ v[j] / m[i] / m[j])) for i, j in ((1, 2), (0, 2), (0, 1))], ">f8").tobytes())
    out.seek(4)
    out.write(struct.pack(">i", k))
    out.seek(0, io.SEEK_END)
    return k


def write_netcdf(frames: list[Frame]) -> bytes:
    out = io.BytesIO()
    stream_netcdf(frames, out, bool(frames) and all(f.box is not None for f in frames))
    return out.getvalue()


# -- where frames stand, from heads alone --------------------------------------------------------------------------

#: Time, place and bytes of a frame.
Place = tuple[float, int, int]


def _first(f: BinaryIO, parse: Callable[[bytes], NamedTuple], size: int) -> NamedTuple:
    """parse over as much of the beginning of a file as it needs."""
    n = 1 << 16
    while True:
        f.seek(0)
        data = f.read(n)
        try:
            return parse(data)
        except (struct.error, IndexError, UnicodeDecodeError, CutShortError):
            if n >= size:
                raise
            n *= 8


def _whole(place: Place, size: int) -> Place:
    if place[1] + place[2] > size:
        raise FormatError("a frame is cut short")
    return place


def _index_trr(f: BinaryIO, size: int) -> Iterator[Place]:
    at = 0
    while at < size:
        f.seek(at)
        head = f.read(12)
        if len(head) < 12 or struct.unpack_from(">i", head)[0] != _TRR_MAGIC:
            raise FormatError("not a TRR frame")
        n = struct.unpack_from(">3i", head)[2] + 3 & ~3
        head = f.read(n + 68)
        if len(head) < n + 60:
            raise FormatError("a frame is cut short")
        ir, e, box, vir, pres, top, sym, x, v, w, natoms, _, _ = struct.unpack_from(">13i", head, n)
        width = box // 9 if box else (x or v or w) // (3 * max(1, natoms))
        if width not in (4, 8) or len(head) < n + 52 + width:
            raise FormatError("TRR numbers have 4 or 8 bytes")
        time = struct.unpack_from(">d" if width == 8 else ">f", head, n + 52)[0]
        here = _whole((time, at, 64 + n + 2 * width + box + ir + e + vir + pres + top + sym + x + v + w), size)
        yield here
        at += here[2]


def _index_xtc(f: BinaryIO, size: int) -> Iterator[Place]:
    at = 0
    while at < size:
        f.seek(at)
        head = f.read(100)
        if len(head) < 56:
            raise FormatError("a frame is cut short")
        magic, natoms, _, time = struct.unpack_from(">3if", head)
        if magic not in (_XTC_MAGIC, _XTC_LONG):
            raise FormatError("not an XTC frame")
        if natoms <= 9:
            length = 56 + 12 * natoms
        else:
            kind = ">q" if magic == _XTC_LONG else ">i"
            if len(head) < 88 + struct.calcsize(kind):
                raise FormatError("a frame is cut short")
            (packed,) = struct.unpack_from(kind, head, 88)
            length = 88 + struct.calcsize(kind) + packed + -packed % 4
        here = _whole((time, at, length), size)
        yield here
        at += length


def _index_dcd(f: BinaryIO, size: int) -> Iterator[Place]:
    head: _DcdHead = _first(f, _dcd_head, size)
    at, k = head.size, 0
    while at < size:
        length = head.frame_bytes(k == 0)
        yield _whole(((head.start + k * head.every) * head.delta, at, length), size)
        at, k = at + length, k + 1


def _index_netcdf(f: BinaryIO, size: int) -> Iterator[Place]:
    layout: _NcLayout = _first(f, _netcdf_layout, size)
    for k in range(layout.records):
        at, time = layout.first + k * layout.record, float(k)
        here = _whole((time, at, layout.record), size)
        if "time" in layout.variables:
            _, kind, _, begin = layout.variables["time"]
            f.seek(begin + k * layout.record)
            time = float(np.frombuffer(f.read(kind.itemsize), kind)[0])
        yield (time, *here[1:])


INDEXES: dict[str, Callable[[BinaryIO, int], Iterator[Place]]] = {"trr": _index_trr, "xtc": _index_xtc, "dcd": _index_dcd, "nc": _index_netcdf, "ncdf": _index_netcdf}


def opening(f: BinaryIO, kind: str, size: int) -> bytes:
    """What decode needs of a file besides a frame's own bytes."""
    if kind in ("trr", "xtc"):
        return b""
    if kind == "dcd":
        head: _DcdHead = _first(f, _dcd_head, size)
        n = head.size + (head.frame_bytes(True) if head.free is not None else 0)
    else:
        n = _first(f, _netcdf_layout, size).first
    f.seek(0)
    return f.read(n)


def decode(kind: str, before: bytes, body: bytes, parts: str = "xvf") -> Frame:
    """The frame that body is, in a file that begins with before (see opening)."""
    if kind == "trr":
        return next(trr_frames(body, parts))
    if kind == "xtc":
        return next(xtc_frames(body))
    if kind == "dcd":
        head = _dcd_head(before)
        first = before[head.size :]  # with atoms that stay: the first frame, which later ones build on
        return read_dcd(before if first == body else before + body).frames[-1]
    return read_netcdf(before[:4] + struct.pack(">i", 1) + before[8:] + body).frames[0]
