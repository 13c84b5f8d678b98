"""Text formats: PDB, GRO, XYZ, SDF and MOL, ITP, NDX. Lengths become nm."""

from __future__ import annotations

import numpy as np

from ..functions.elements import MASSES, NUMBER, SYMBOLS, guess_name
from ..functions.geometry import check_box, from_lengths_angles
from .model import FormatError, Frame, Structure, real, whole


def _atom(name: str, resname: str, resid: int, chain: str = " ", symbol: str = "", **more) -> dict:
    z = NUMBER.get(symbol.strip().upper(), 0) if symbol.strip() else 0
    z = z or guess_name(name, resname)
    return {"name": name, "resname": resname, "resid": resid, "chain": chain, "atomic_number": z, "mass": MASSES[z], **more}


def read_pdb(text: str) -> Structure:
    """All models; atoms and CONECT bonds by serial numbers; a box from CRYST1; numbers that can't be read get defaults."""
    out, xyz, box, serials, pairs, first = Structure(), [], None, {}, set(), True

    def close() -> None:
        nonlocal xyz, first
        if xyz:
            out.frames.append(Frame(float(len(out.frames)), box, np.array(xyz) * 0.1))
            xyz, first = [], False

    for line in text.splitlines():
        head = line[:6]
        if head in ("ATOM  ", "HETATM"):
            xyz.append([real(line[a : a + 8]) for a in (30, 38, 46)])
            if first:
                if (serial := whole(line[6:11], -1)) >= 0:
                    serials[serial] = len(out.atoms)
                out.atoms.append(_atom(line[12:16].strip(), line[17:20].strip(), whole(line[22:26]), line[21:22] or " ", line[76:78], occupancy=real(line[54:60], 1.0), bfactor=real(line[60:66])))
        elif head == "CRYST1":
            a, b, c = (real(line[i:j]) * 0.1 for i, j in ((6, 15), (15, 24), (24, 33)))
            try:
                box = from_lengths_angles(a, b, c, *(real(line[i:j], 90.0) for i, j in ((33, 40), (40, 47), (47, 54))))
            except ValueError:
                box = None
        elif head == "CONECT":
            own = whole(line[6:11], -1)
            pairs |= {tuple(sorted((own, whole(line[i : i + 5], -1)))) for i in (11, 16, 21, 26) if line[i : i + 5].strip()}
        elif line.startswith(("MODEL", "ENDMDL", "END")):
            close()
    close()
    if not out.atoms:
        raise FormatError("no atoms in the PDB file")
    out.bonds = [(i, j, 0) for i, j in sorted({tuple(sorted((serials[a], serials[b]))) for a, b in pairs if a != b and a in serials and b in serials})]
    return out.number_residues()


def write_pdb(s: Structure) -> str:
    lines = []
    for f in s.frames:
        if f.box is not None:
            v = np.array(f.box).reshape(3, 3)
            n = np.linalg.norm(v, axis=1)
            angle = [np.degrees(np.arccos(v[i] @ v[j] / n[i] / n[j])) for i, j in ((1, 2), (0, 2), (0, 1))]
            lines.append("CRYST1{:9.3f}{:9.3f}{:9.3f}{:7.2f}{:7.2f}{:7.2f} P 1           1".format(*(n * 10), *angle))
        for i, (a, (x, y, z)) in enumerate(zip(s.atoms, f.xyz * 10, strict=True)):
            name = a["name"] if len(a["name"]) > 3 else f" {a['name']:<3}"
            z_ = a.get("atomic_number") or 0
            lines.append(f"ATOM  {i % 99999 + 1:5d} {name:<4} {a['resname']:<4.4}{a.get('chain', ' '):1}{a['resid'] % 9999:4d}    {x:8.3f}{y:8.3f}{z:8.3f}{a.get('occupancy', 1.0):6.2f}{a.get('bfactor', 0.0):6.2f}          {SYMBOLS[z_].upper() if z_ else '':>2}")
        lines.append("END")
    return "\n".join(lines) + "\n"


def read_gro(text: str) -> Structure:
    """All frames; velocities where lines hold them; a box of 3 or 9 numbers, of zeros: none."""
    out, lines, at = Structure(), text.splitlines(), 0
    while at + 1 < len(lines) and lines[at + 1].strip():
        title, n = lines[at], whole(lines[at + 1].strip(), -1)
        if n < 0 or at + 2 + n >= len(lines):
            raise FormatError("a GRO frame is cut short")
        body = lines[at + 2 : at + 2 + n]
        time = real(title.rpartition("t=")[2].split()[0]) if "t=" in title and title.rpartition("t=")[2].split() else 0.0
        if not out.atoms:
            out.atoms = [_atom(b[10:15].strip(), b[5:10].strip(), whole(b[:5])) for b in body]
        xyz = np.array([[real(b[k : k + 8]) for k in (20, 28, 36)] for b in body]).reshape(-1, 3)
        moving = bool(body) and all(len(b) >= 68 for b in body)
        velocity = np.array([[real(b[k : k + 8]) for k in (44, 52, 60)] for b in body]) if moving else None
        v = [real(x) for x in lines[at + 2 + n].split()]
        if len(v) not in (3, 9):
            raise FormatError("a GRO box has 3 or 9 numbers")
        v += [0.0] * (9 - len(v))
        box = [v[0], v[3], v[4], v[5], v[1], v[6], v[7], v[8], v[2]]
        out.frames.append(Frame(time, check_box(box) if any(v[:3]) else None, xyz, velocity))
        at += n + 3
    return out.number_residues()


def write_gro(s: Structure) -> str:
    lines = []
    for f in s.frames:
        lines += [f"frame t= {f.time:.3f}", str(len(s.atoms))]
        for i, (a, p) in enumerate(zip(s.atoms, f.xyz, strict=True)):
            v = "" if f.velocity is None else "{:8.4f}{:8.4f}{:8.4f}".format(*f.velocity[i])
            lines.append(f"{a['resid'] % 99999:5d}{a['resname']:<5.5}{a['name']:>5.5}{i % 99999 + 1:5d}{p[0]:8.3f}{p[1]:8.3f}{p[2]:8.3f}{v}")
        b = f.box or [0.0] * 9
        numbers = [b[0], b[4], b[8]] + ([b[1], b[2], b[3], b[5], b[6], b[7]] if any(b[k] for k in (1, 2, 3, 5, 6, 7)) else [])
        lines.append("".join(f"{x:10.4f}" for x in numbers))
    return "\n".join(lines) + "\n"


def read_xyz(text: str) -> Structure:
    out, lines, at = Structure(), text.splitlines(), 0
    while at < len(lines) and lines[at].strip():
        n = whole(lines[at].strip(), -1)
        if n < 0 or at + 2 + n > len(lines):
            raise FormatError("an XYZ frame is cut short")
        body = [b.split() for b in lines[at + 2 : at + 2 + n]]
        if not out.atoms:
            out.atoms = [_atom(b[0], "MOL", 1, "A", b[0]) for b in body]
        out.frames.append(Frame(float(len(out.frames)), None, np.array([[float(x) for x in b[1:4]] for b in body]).reshape(-1, 3) * 0.1))
        at += n + 2
    return out.number_residues()


def write_xyz(s: Structure) -> str:
    lines = []
    for f in s.frames:
        lines += [str(len(s.atoms)), ""]
        lines += ["{} {:.6f} {:.6f} {:.6f}".format(SYMBOLS[a.get("atomic_number") or 0] if a.get("atomic_number") else a["name"], *p) for a, p in zip(s.atoms, f.xyz * 10, strict=True)]
    return "\n".join(lines) + "\n"


def read_sdf(text: str) -> list[Structure]:
    """Every molecule of a V2000 file; bond orders 1 to 4 are kept, query orders become single."""
    return [_read_mol(part) for part in text.replace("\r\n", "\n").split("$$$$\n") if part.strip()]


def _read_mol(text: str) -> Structure:
    lines = text.split("\n")
    if len(lines) < 4 or "V3000" in lines[3]:
        raise FormatError("only V2000 molecules can be read")
    n, m = whole(lines[3][:3]), whole(lines[3][3:6])
    if len(lines) < 4 + n + m:
        raise FormatError("a molecule is cut short")
    out, xyz = Structure(), []
    for b in lines[4 : 4 + n]:
        xyz.append([real(b[k : k + 10]) for k in (0, 10, 20)])
        symbol = b[31:34].strip()
        out.atoms.append(_atom(symbol, "MOL", 1, "A", symbol))
    for b in lines[4 + n : 4 + n + m]:
        i, j, order = whole(b[:3]) - 1, whole(b[3:6]) - 1, whole(b[6:9], 1)
        out.bonds.append((i, j, order if 1 <= order <= 4 else 1))
    for b in lines[4 + n + m :]:
        if b.startswith("M  CHG"):
            f = b.split()[3:]
            for k, q in zip(f[::2], f[1::2], strict=False):
                out.atoms[int(k) - 1]["formal_charge"] = int(q)
        elif b.startswith("M  END"):
            break
    out.frames.append(Frame(0.0, None, np.array(xyz).reshape(-1, 3) * 0.1))
    return out.number_residues()


def write_sdf(s: Structure, close: bool = True) -> str:
    """close: with the mark that ends a molecule (SDF), without it for MOL."""
    lines = ["", "  atomweave", "", f"{len(s.atoms):3d}{len(s.bonds):3d}  0  0  0  0  0  0  0  0999 V2000"]
    for a, p in zip(s.atoms, s.frames[0].xyz * 10, strict=True):
        z = a.get("atomic_number") or 0
        lines.append("{:10.4f}{:10.4f}{:10.4f} {:<3} 0  0  0  0  0  0  0  0  0  0  0  0".format(*p, SYMBOLS[z]))
    lines += [f"{i + 1:3d}{j + 1:3d}{order or 1:3d}  0" for i, j, order in s.bonds]
    charged = [(i + 1, a["formal_charge"]) for i, a in enumerate(s.atoms) if a.get("formal_charge")]
    for k in range(0, len(charged), 8):
        part = charged[k : k + 8]
        lines.append(f"M  CHG{len(part):3d}" + "".join(f" {i:3d} {q:3d}" for i, q in part))
    return "\n".join([*lines, "M  END", *(["$$$$"] if close else [])]) + "\n"


def read_itp(text: str) -> Structure:
    """The atoms of the first molecule type; the section ends at its first short line."""
    out, section = Structure(), ""
    for line in text.splitlines():
        line = line.split(";")[0].strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("["):
            if section == "atoms":
                break
            section = line.strip("[] \t")
        elif section == "atoms":
            f = line.split()
            if len(f) < 8:
                break
            z = guess_name(f[4], f[3])
            out.atoms.append({"type_name": f[1], "resid": whole(f[2]), "resname": f[3], "name": f[4], "charge": real(f[6]), "mass": real(f[7]), "atomic_number": z})
    return out


def read_ndx(text: str) -> dict[str, list[int]]:
    """Groups of atom indices from 0; empty ones are dropped, of equal names the last counts."""
    out: dict[str, list[int]] = {}
    name = None
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("["):
            name = line.strip("[] \t")
            out[name] = []
        elif line and name is not None:
            out[name] += [int(x) - 1 for x in line.split()]
    return {k: sorted(set(v)) for k, v in out.items() if v}
