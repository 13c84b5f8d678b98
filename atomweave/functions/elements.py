"""Chemical elements, and guessing one from an atom name."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Symbols by atomic number (0 is unknown).
SYMBOLS = (
    "X H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc "
    "Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po "
    "At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg"
).split()

# Standard atomic masses in amu by atomic number.
MASSES = tuple(
    map(
        float,
        "0 1.00794 4.00260 6.941 9.012182 10.811 12.0107 14.0067 15.9994 18.9984032 20.1797 22.989770 24.3050 26.981538 28.0855 "
        "30.973761 32.065 35.453 39.948 39.0983 40.078 44.955910 47.867 50.9415 51.9961 54.938049 55.845 58.9332 58.6934 63.546 "
        "65.409 69.723 72.64 74.92160 78.96 79.904 83.798 85.4678 87.62 88.90585 91.224 92.90638 95.94 98.0 101.07 102.90550 "
        "106.42 107.8682 112.411 114.818 118.710 121.760 127.60 126.90447 131.293 132.90545 137.327 138.9055 140.116 140.90765 "
        "144.24 145.0 150.36 151.964 157.25 158.92534 162.500 164.93032 167.259 168.93421 173.04 174.967 178.49 180.9479 183.84 "
        "186.207 190.23 192.217 195.078 196.96655 200.59 204.3833 207.2 208.98038 209.0 210.0 222.0 223.0 226.0 227.0 232.0381 "
        "231.03588 238.02891 237.0 244.0 243.0 247.0 247.0 251.0 252.0 257.0 258.0 259.0 262.0 261.0 262.0 266.0 264.0 269.0 268.0 "
        "271.0 272.0".split(),
    )
)

# Van der Waals radii in angstrom where they differ from 2.0, by symbol.
VDW_DEFAULT = 2.0
VDW = {
    "X": 1.5, "H": 1.2, "He": 1.4, "Li": 1.82, "C": 1.7, "N": 1.55, "O": 1.52, "F": 1.47, "Ne": 1.54, "Na": 1.36, "Mg": 1.18, "Si": 2.1, "P": 1.8, "S": 1.8,
    "Cl": 2.27, "Ar": 1.88, "K": 1.76, "Ca": 1.37, "Ni": 1.63, "Cu": 1.4, "Zn": 1.39, "Ga": 1.07, "As": 1.85, "Se": 1.9, "Br": 1.85, "Kr": 2.02, "Pd": 1.63,
    "Ag": 1.72, "Cd": 1.58, "In": 1.93, "Sn": 2.17, "Te": 2.06, "I": 1.98, "Xe": 2.16, "Cs": 2.1, "Pt": 1.72, "Au": 1.66, "Hg": 1.55, "Tl": 1.96, "Pb": 2.02, "U": 1.86,
}

NUMBER = {s.upper(): z for z, s in enumerate(SYMBOLS)}


def vdw_nm(z: int) -> float:
    return VDW.get(SYMBOLS[z], VDW_DEFAULT) * 0.1 if 0 <= z < len(SYMBOLS) else 0.15


def elements(spark: SparkSession) -> DataFrame:
    """z, symbol, mass, vdw_nm: 112 rows."""
    rows = [(z, s, MASSES[z], vdw_nm(z)) for z, s in enumerate(SYMBOLS)]
    return spark.createDataFrame(rows, "z short, symbol string, mass double, vdw_nm double")


def _lookup(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def from_symbol(symbol: Column) -> Column:
    """Atomic number of an explicit symbol, any case; 0 if blank or unknown."""
    return F.coalesce(F.try_element_at(_lookup({s: z for s, z in NUMBER.items() if z}), F.upper(F.trim(symbol))), F.lit(0)).cast("short")


def guess(name: Column, resname: Column) -> Column:
    """Atomic number from an atom name: special ions, then two letters, then one."""
    letters = F.regexp_extract(name, "[A-Za-z].*", 0)
    two = {s.upper(): z for z, s in enumerate(SYMBOLS) if len(s) == 2}
    one = {s: z for z, s in enumerate(SYMBOLS) if len(s) == 1 and z}
    pair = F.upper(F.substring(letters, 1, 2))
    by_two = F.try_element_at(_lookup(two), F.when(F.length(pair) == 2, pair))
    careful = F.substring(pair, 1, 1).isin(*"CNOHP")
    found = F.coalesce(F.when(~careful | (name == resname), by_two), F.try_element_at(_lookup(one), F.substring(letters, 1, 1)), F.lit(0))
    return F.when(name == "SOD", 11).when(name == "POT", 19).otherwise(found).cast("short")


def mass_of(z: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MASSES]), z.cast("int") + 1)


def vdw_of(z: Column) -> Column:
    return F.element_at(F.array(*[F.lit(vdw_nm(i)) for i in range(len(SYMBOLS))]), z.cast("int") + 1)


def guess_name(name: str, resname: str = "") -> int:
    """guess for one name, for readers."""
    if name in ("SOD", "POT"):
        return {"SOD": 11, "POT": 19}[name]
    at = next((i for i, c in enumerate(name) if c.isascii() and c.isalpha()), None)
    if at is None:
        return 0
    pair = name[at : at + 2].upper()
    z = NUMBER.get(pair, 0) if len(pair) == 2 else 0
    if z and (pair[0] not in "CNOHP" or name == resname):
        return z
    return next((i for i, s in enumerate(SYMBOLS) if i and s == name[at]), 0)
