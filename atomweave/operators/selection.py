"""The atom selection language: text to syntax tree to a plan of DataFrames.

``and`` and ``or`` share one level and group from the left; ``and`` evaluates its right side only on what the left side
kept, so centres and positions in it see those atoms alone; the sets inside ``within``, ``same`` and ``all`` are global.
Row predicates fold into one filter; spatial, bonded and ``same`` terms become semi-joins, centres become one row per
frame joined back. Lengths are in nm.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.elements import vdw_of
from . import spatial

# Residue names of proteins and waters, atom names of the backbone, heavy partners of polar hydrogens.
PROTEIN = "GLY ALA VAL PHE PRO MET ILE LEU ASP GLU LYS ARG SER THR TYR HIS CYS ASN GLN TRP HSE HSD HSP CYX".split()
WATER = "SOL HOH TIP3 TIP4 TIP5 OPC".split()
BACKBONE = "C N O CA".split()
POLAR = (7, 8, 9, 16)

ATTRIBUTES = {a: a for a in "x y z vx vy vz fx fy fz mass charge occupancy bfactor".split()} | {"occ": "occupancy", "beta": "bfactor", "vdw": "vdw"}
FUNCTIONS = ("abs", "sqrt", "sin", "cos")
CHEMICAL = ("protein", "backbone", "sidechain", "water", "now", "hydrogen", "noh", "polh", "apolh")
ALIASES = {"not_water": "now", "not_hydrogen": "noh"}
KEYWORDS = {"and", "or", "not", "of", "same", "within", "dist", "as", "pbc", "nopbc", "self", "all", *CHEMICAL, *ALIASES, "name", "resname", "resid", "resindex", "index", "chain"}


class SelectionSyntaxError(ValueError):
    """Where a text stops being a selection, what stands there, and what could."""

    def __init__(self, text: str, start: int, end: int, expected: Sequence[str]):
        self.text, self.start, self.end, self.token, self.expected = text, start, end, text[start:end], tuple(expected)
        super().__init__(f"syntax error at {start} ({self.token!r}), expected {' or '.join(self.expected)}\n{text}\n{' ' * start}{'^' * max(1, end - start)}")


class EmptySelectionError(ValueError):
    """A selection that must not be empty is."""


# -- syntax tree ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class All:
    pass


@dataclass(frozen=True)
class Ints:
    column: str
    ranges: tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class Strings:
    column: str
    values: tuple[str, ...]
    patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Chemical:
    kind: str


@dataclass(frozen=True)
class Not:
    arg: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Same:
    column: str
    arg: object


@dataclass(frozen=True)
class Within:
    cutoff: float
    dims: tuple[int, int, int] | None
    with_self: bool
    target: object


@dataclass(frozen=True)
class Compare:
    parts: tuple  # expression, operator, expression [, operator, expression]


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Attribute:
    name: str


@dataclass(frozen=True)
class Arithmetic:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Call:
    name: str
    arg: object


@dataclass(frozen=True)
class Component:
    axis: int
    vector: object


@dataclass(frozen=True)
class Distance:
    kind: str  # point, line, plane
    vectors: tuple
    direction: bool
    dims: tuple[int, int, int] | None


@dataclass(frozen=True)
class Point:
    xyz: tuple[float, float, float]


@dataclass(frozen=True)
class Centre:
    kind: str  # com, cog
    dims: tuple[int, int, int] | None
    arg: object


@dataclass(frozen=True)
class Position:
    n: int
    arg: object


# -- parser -----------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\s*(?:(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![A-Za-z_]))|(?P<regex>/[^/]*/)|(?P<word>[A-Za-z0-9_]+)|(?P<op>==|!=|<=|>=|[<>+\-*/^():,\[\]]))")
_COMPARE = ("==", "!=", "<=", ">=", "<", ">")


class Parser:
    def __init__(self, text: str, docs_precedence: bool = False):
        self.text, self.at, self.docs_precedence = text, 0, docs_precedence

    def peek(self, names: bool = False) -> tuple[str, str, int, int]:
        """(kind, token, start, end) of the next token; names: words may begin with digits."""
        if names:
            m = re.compile(r"\s*(?:(?P<regex>/[^/]*/)|(?P<word>[A-Za-z0-9_'*\"+\-.]+))").match(self.text, self.at)
            if m:
                return m.lastgroup, m[m.lastgroup], m.start(m.lastgroup), m.end()
        m = _TOKEN.match(self.text, self.at)
        if not m:
            rest = re.compile(r"\s*(\S*)").match(self.text, self.at)
            return ("end" if not rest[1] else "bad"), rest[1], rest.start(1), rest.end()
        return m.lastgroup, m[m.lastgroup], m.start(m.lastgroup), m.end()

    def fail(self, *expected: str):
        _, _, a, b = self.peek()
        word = re.compile(r"\S+").match(self.text, a)
        raise SelectionSyntaxError(self.text, a, word.end() if word else b, expected)

    def take(self, *tokens: str) -> str | None:
        _, token, _, end = self.peek()
        if token in tokens:
            self.at = end
            return token
        return None

    def need(self, *tokens: str) -> str:
        return self.take(*tokens) or self.fail(*tokens)

    def parse(self):
        node = self.logical()
        if self.peek()[0] != "end":
            self.fail("and", "or", "end of text")
        return node

    def logical(self):
        if self.docs_precedence:
            return self._chain("or", lambda: self._chain("and", self.operand))
        node = self.operand()
        while op := self.take("and", "or"):
            node = Binary(op, node, self.operand())
        return node

    def _chain(self, op: str, inner):
        node = inner()
        while self.take(op):
            node = Binary(op, node, inner())
        return node

    def operand(self):
        kind, token, _, end = self.peek()
        token = ALIASES.get(token, token)
        if token == "not":
            self.at = end
            return Not(self.operand())
        if token == "same":
            self.at = end
            column = {"residue": "resindex", "chain": "chain"}[self.need("residue", "chain")]
            self.need("as")
            return Same(column, self.operand())
        if token == "within":
            self.at = end
            cutoff, dims = self.number(), self.dims()
            with_self = bool(self.take("self"))
            self.need("of")
            target = self.vector(optional=True)
            return Within(cutoff, dims, with_self, target if target is not None else self.operand())
        if token == "all":
            self.at = end
            return All()
        if token in CHEMICAL:
            self.at = end
            return Chemical(token)
        if token in ("name", "resname"):
            self.at = end
            return self.strings(token)
        if token == "chain":
            self.at = end
            return self.chains()
        if token in ("resid", "resindex", "index"):
            mark, self.at = self.at, end
            if self.peek()[1] not in (*_COMPARE, "+", "*", "/", "^"):
                return self.ints({"index": "atom_idx"}.get(token, token))
            self.at = mark
        if token == "(":
            mark, self.at = self.at, end
            try:
                node = self.logical()
                self.need(")")
                if self.peek()[1] not in (*_COMPARE, "+", "-", "*", "/", "^"):
                    return node
            except SelectionSyntaxError as e:
                self.at = mark
                try:
                    return self.comparison()
                except SelectionSyntaxError as other:  # the reading that came farther tells more
                    raise max(e, other, key=lambda x: x.start) from None
            self.at = mark
        return self.comparison()

    def strings(self, column: str):
        values, patterns = [], []
        while True:
            kind, token, _, end = self.peek(names=True)
            if kind == "regex":
                patterns.append(token[1:-1])
            elif kind == "word" and token not in ("and", "or", "not"):
                values.append(token)
            else:
                break
            self.at = end
        if not values and not patterns:
            self.fail("a name", "/regex/")
        return Strings(column, tuple(values), tuple(patterns))

    def chains(self):
        values = []
        while (t := self.peek(names=True))[0] == "word" and t[1] not in ("and", "or", "not"):
            if len(t[1]) != 1 or not t[1].isalnum():
                break
            values.append(t[1])
            self.at = t[3]
        if not values:
            self.fail("a chain letter")
        return Strings("chain", tuple(values))

    def integer(self) -> int | None:
        m = re.compile(r"\s*([+-]?\d+)(?![\w.])").match(self.text, self.at)
        if not m:
            return None
        self.at = m.end()
        return int(m[1])

    def ints(self, column: str):
        ranges = []
        while (a := self.integer()) is not None:
            b = a
            if self.take(":"):
                b = self.integer()
                if b is None:
                    self.fail("an integer")
            ranges.append((a, b))
        if not ranges:
            self.fail("an integer", "a range")
        return Ints(column, tuple(ranges))

    def number(self) -> float:
        m = re.compile(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)").match(self.text, self.at)
        if not m:
            self.fail("a number")
        self.at = m.end()
        return float(m[1])

    def dims(self) -> tuple[int, int, int] | None:
        if self.take("nopbc"):
            return None
        if not self.take("pbc"):
            return None
        m = re.compile(r"\s+([01yn])\s?([01yn])\s?([01yn])(?!\w)").match(self.text, self.at)
        if not m:
            return (1, 1, 1)
        self.at = m.end()
        return tuple(int(c in "1y") for c in m.groups())

    def comparison(self):
        parts = [self.math()]
        while len(parts) < 5 and (op := self.peek()[1]) in _COMPARE:
            if len(parts) == 3 and (op[0] not in "<>" or op[0] != parts[1][0]):
                self.fail("a comparison in the same direction")
            self.take(op)
            parts += [op, self.math()]
        if len(parts) == 1:
            self.fail(*_COMPARE)
        return Compare(tuple(parts))

    def math(self):
        node = self.product()
        while op := self.take("+", "-"):
            node = Arithmetic(op, node, self.product())
        return node

    def product(self):
        node = self.power()
        while op := self.take("*", "/"):
            node = Arithmetic(op, node, self.power())
        return node

    def power(self):
        node = self.unary()
        return Arithmetic("^", node, self.power()) if self.take("^") else node

    def unary(self):
        if self.take("-"):
            return Call("neg", self.unary())
        if self.take("+"):
            return self.unary()
        return self.atom()

    def atom(self):
        kind, token, _, end = self.peek()
        if kind == "num":
            self.at = end
            return Number(float(token))
        if token == "(":
            self.at = end
            node = self.math()
            self.need(")")
            return node
        if token in FUNCTIONS:
            self.at = end
            self.need("(")
            node = Call(token, self.math())
            self.need(")")
            return node
        if token == "dist":
            self.at = end
            return self.distance()
        if token in ("resid", "resindex", "index"):
            self.at = end
            return Attribute({"index": "atom_idx"}.get(token, token))
        if token in ATTRIBUTES:
            self.at = end
            if token in "xyz" and self.take("of"):
                return Component("xyz".index(token), self.vector())
            return Attribute(ATTRIBUTES[token])
        return self.fail("a selection", "a number", "an attribute")

    def distance(self):
        dims = self.dims()
        kind = self.need("point", "line", "plane")
        dims = dims or self.dims()
        if kind == "point":
            return Distance(kind, (self.vector(),), False, dims)
        first = self.vector()
        if self.take("dir" if kind == "line" else "normal"):
            return Distance(kind, (first, self.vector()), True, dims)
        return Distance(kind, (first, self.vector(), *((self.vector(),) if kind == "plane" else ())), False, dims)

    def vector(self, optional: bool = False):
        if kind := self.take("com", "cog"):
            dims = self.dims()
            self.need("of")
            return Centre(kind, dims, self.operand())
        if self.take("pos"):
            n = self.integer()
            self.need("of")
            return Position(n, self.operand())
        if self.take("["):
            x = [self.number()]
            while self.take(","):
                x.append(self.number())
            self.need("]")
            return Point(tuple(x)) if len(x) == 3 else self.fail("three numbers")
        if optional and not re.compile(r"\s*[+-]?[\d.]").match(self.text, self.at):
            return None
        return Point((self.number(), self.number(), self.number()))


def parse(text: str, docs_precedence: bool = False):
    """The syntax tree of a selection, or SelectionSyntaxError."""
    return Parser(text, docs_precedence).parse()


# -- compiler ---------------------------------------------------------------------------------------------------


@dataclass
class Compiler:
    """Atoms (one row each, per combination of keys) filtered by syntax trees.

    keys: columns that tell frames or systems apart; box: nine numbers or the name of an array column; bonds: i1, i2
    (and the keys that are among its columns), for polar hydrogens.
    """

    atoms: DataFrame
    keys: tuple[str, ...] = ()
    box: object = None
    bonds: DataFrame | None = None
    vectors: dict = field(default_factory=dict)

    def run(self, node, cur: DataFrame | None = None) -> DataFrame:
        cur = self.atoms if cur is None else cur
        pure = self.predicate(node)
        if pure is not None:
            return cur.where(pure)
        id_ = [*self.keys, "atom_idx"]
        if isinstance(node, Binary):
            if node.op == "and":
                return self.run(node.right, self.run(node.left, cur))
            both = self.run(node.left, cur).select(*id_).union(self.run(node.right, cur).select(*id_)).distinct()
            return cur.join(both, id_, "left_semi")
        if isinstance(node, Not):
            return cur.join(self.run(node.arg, cur).select(*id_), id_, "left_anti")
        if isinstance(node, Same):
            on = [*self.keys, node.column]
            return cur.join(self.run(node.arg).select(*on), on, "left_semi")
        if isinstance(node, Within):
            return self.within(node, cur)
        if isinstance(node, Chemical):
            return self.hydrogens(node.kind == "polh", cur)
        if isinstance(node, Compare):
            with_vectors, names = self.attach(node, cur)
            kept = with_vectors.where(self.compare(node, names))
            return kept.select(*cur.columns)
        raise TypeError(node)

    def predicate(self, node) -> Column | None:
        """The column of a node that needs nothing but its row."""
        if isinstance(node, All):
            return F.lit(True)
        if isinstance(node, Ints):
            c = F.col(node.column)
            single = [a for a, b in node.ranges if a == b]
            tests = ([c.isin(*single)] if single else []) + [c.between(a, b) for a, b in node.ranges if a != b]
            return _any(tests)
        if isinstance(node, Strings):
            c = F.col(node.column)
            return _any(([c.isin(*node.values)] if node.values else []) + [c.rlike(f"^{p}$") for p in node.patterns])
        if isinstance(node, Chemical) and node.kind not in ("polh", "apolh"):
            protein, backbone, water = F.col("resname").isin(*PROTEIN), F.col("name").isin(*BACKBONE), F.col("resname").isin(*WATER)
            hydrogen = F.regexp_extract("name", "[A-Za-z]", 0) == "H"
            return {"protein": protein, "backbone": protein & backbone, "sidechain": protein & ~backbone, "water": water, "now": ~water, "hydrogen": hydrogen, "noh": ~hydrogen}[node.kind]
        if isinstance(node, Not):
            inner = self.predicate(node.arg)
            return None if inner is None else ~inner
        if isinstance(node, Binary):
            left, right = self.predicate(node.left), self.predicate(node.right)
            return None if left is None or right is None else (left & right if node.op == "and" else left | right)
        if isinstance(node, Within) and isinstance(node.target, Point):
            return g.distance(g.point(), g.vec(node.target.xyz), self.pbc(node.dims), node.dims or (1, 1, 1)) <= node.cutoff
        if isinstance(node, Compare) and not list(_vectors(node)):
            return self.compare(node, {})
        return None

    def pbc(self, dims):
        if dims is None:
            return None
        if self.box is None:
            raise ValueError("the selection is periodic but there is no box")
        return self.box

    def within(self, node: Within, cur: DataFrame) -> DataFrame:
        box, dims = self.pbc(node.dims), node.dims or (1, 1, 1)
        if isinstance(node.target, (Centre, Position)):
            joined, names = self.attach(node.target, cur)
            return joined.where(g.distance(g.point(), self.place(node.target, names), box, dims) <= node.cutoff).select(*cur.columns)
        inner = self.run(node.target)
        near = spatial.within(cur, inner, node.cutoff, box, dims, self.keys)
        if node.with_self:
            near = near.unionByName(inner.select(*cur.columns)).dropDuplicates([*self.keys, "atom_idx"])
        return near

    def hydrogens(self, polar: bool, cur: DataFrame) -> DataFrame:
        if self.bonds is None:
            return cur.where(F.lit(False))
        both = self.bonds.select(*[k for k in self.keys if k in self.bonds.columns], F.col("i1").alias("atom_idx"), F.col("i2").alias("_to")).union(self.bonds.select(*[k for k in self.keys if k in self.bonds.columns], F.col("i2"), F.col("i1")))
        shared = [k for k in self.keys if k in self.bonds.columns]
        ends = self.atoms.select(*shared, F.col("atom_idx").alias("_to"), F.col("atomic_number").alias("_z")).distinct()
        z = F.col("_z")
        heavy = both.join(ends, [*shared, "_to"]).where(z.isin(*POLAR) if polar else ~z.isin(1, *POLAR))
        return cur.where(F.col("atomic_number") == 1).join(heavy.select(*shared, "atom_idx"), [*shared, "atom_idx"], "left_semi")

    # vectors of a frame: computed once, joined to its atoms

    def attach(self, node, cur: DataFrame) -> tuple[DataFrame, dict]:
        names: dict = {}
        for v in _vectors(node):
            if v in names:
                continue
            at = f"_v{len(names)}"
            row = self.vector(v, cur).select(*self.keys, F.struct("x", "y", "z").alias(at))
            cur = cur.join(row, list(self.keys)) if self.keys else cur.crossJoin(F.broadcast(row))
            names[v] = at
        return cur, names

    def vector(self, v, cur: DataFrame) -> DataFrame:
        """x, y, z per frame. Centres and positions are of atoms of the current set."""
        inner = self.run(v.arg, cur)
        keys = list(self.keys)
        if isinstance(v, Position):
            from pyspark.sql import Window

            nth = F.row_number().over(Window.partitionBy(*keys).orderBy("atom_idx") if keys else Window.partitionBy(F.lit(0)).orderBy("atom_idx"))
            return inner.withColumn("_n", nth).where(F.col("_n") == v.n + 1).select(*keys, "x", "y", "z")
        from .measure import center

        return center(inner, keys, weighted=v.kind == "com", box=self.pbc(v.dims), dims=v.dims or (1, 1, 1))

    def place(self, v, names: dict) -> g.Vec:
        if isinstance(v, Point):
            return g.vec(v.xyz)
        c = F.col(names[v])
        return c["x"], c["y"], c["z"]

    def compare(self, node: Compare, names: dict) -> Column:
        p = node.parts
        ops = {"==": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
        out = None
        for k in range(1, len(p), 2):
            test = getattr(self.number(p[k - 1], names), ops[p[k]])(self.number(p[k + 1], names))
            out = test if out is None else out & test
        return out

    def number(self, node, names: dict) -> Column:
        if isinstance(node, Number):
            return F.lit(node.value)
        if isinstance(node, Attribute):
            if node.name == "vdw":
                return F.col("vdw") if "vdw" in self.atoms.columns else vdw_of(F.col("atomic_number"))
            if node.name not in self.atoms.columns:
                raise ValueError(f"the atoms have no {node.name}")
            return F.col(node.name)
        if isinstance(node, Call):
            x = self.number(node.arg, names)
            if node.name == "neg":
                return -x
            if node.name == "sqrt":
                return F.when(x < 0, F.raise_error(F.lit("square root of a negative number"))).otherwise(F.sqrt(x))
            return getattr(F, node.name)(x)
        if isinstance(node, Arithmetic):
            a, b = self.number(node.left, names), self.number(node.right, names)
            if node.op == "/":
                return F.when(b == 0, F.raise_error(F.lit("division by zero"))).otherwise(a / b)
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "^": lambda: F.pow(a, b)}[node.op]()
        if isinstance(node, Component):
            return self.place(node.vector, names)[node.axis]
        if isinstance(node, Distance):
            return self.distance(node, names)
        raise TypeError(node)

    def distance(self, node: Distance, names: dict) -> Column:
        at = [self.place(v, names) for v in node.vectors]
        box, dims = self.pbc(node.dims), node.dims or (1, 1, 1)
        d = g.sub(g.point(), at[0])
        if box is not None:
            d = g.shortest(d, g.box(box), dims, g.skewed(box))
        if node.kind == "point":
            return g.norm(d)
        if node.kind == "line":
            along = at[1] if node.direction else g.sub(at[1], at[0])
            return g.norm(g.cross(d, g.unit(along)))
        normal = at[1] if node.direction else g.cross(g.sub(at[1], at[0]), g.sub(at[2], at[0]))
        return F.abs(g.dot(d, g.unit(normal)))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _vectors(node):
    """Centres and positions inside a comparison, a distance or the node itself."""
    if isinstance(node, (Centre, Position)):
        yield node
    elif isinstance(node, Compare):
        for p in node.parts[::2]:
            yield from _vectors(p)
    elif isinstance(node, Arithmetic):
        yield from _vectors(node.left)
        yield from _vectors(node.right)
    elif isinstance(node, Call):
        yield from _vectors(node.arg)
    elif isinstance(node, Component):
        yield from _vectors(node.vector)
    elif isinstance(node, Distance):
        for v in node.vectors:
            yield from _vectors(v)


def select(atoms: DataFrame, what, keys: Sequence[str] = (), box=None, bonds: DataFrame | None = None, strict: bool = False, docs_precedence: bool = False) -> DataFrame:
    """Atoms that a definition names: text, tree, column, range, indices (of the atoms given) or a DataFrame of atom_idx.

    Ranges are half open; strict: an empty result is an error (runs a job).
    """
    if isinstance(what, str):
        what = parse(what, docs_precedence)
    if isinstance(what, DataFrame):
        out = atoms.join(what.select("atom_idx").distinct(), "atom_idx", "left_semi")
    elif isinstance(what, Column):
        out = atoms.where(what)
    elif isinstance(what, range):
        out = atoms.where(F.col("atom_idx").between(what.start, what.stop - 1))
    elif isinstance(what, (list, tuple, set)) and all(isinstance(i, int) for i in what):
        out = atoms.where(F.col("atom_idx").isin(*sorted(set(what))))
    else:
        out = Compiler(atoms, tuple(keys), box, bonds).run(what)
    if strict and out.isEmpty():
        raise EmptySelectionError(str(what))
    return out


__all__ = ["Compiler", "EmptySelectionError", "SelectionSyntaxError", "parse", "select"]
