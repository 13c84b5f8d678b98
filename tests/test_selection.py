import pytest
from pyspark.sql import functions as F

from atomweave.operators.selection import EmptySelectionError, SelectionSyntaxError, parse, select

ACCEPTED = [
    "backbone and x<4", "name android orbital", "within 0.5 pbc yyy of resid 555", "dist point 1.9 2.9 3.8 > 0.4", "within 0.5 of com pbc 101 of protein", "x < x of com of name CA",
    "x < x of pos 3 of name CA", "0<=x<=5", "(x+1)*2<3 and (name CA or resid 5:7 -3)", "not protein", "within 0.3 self of [1,2,3]", "-x^2 < 4", "resid > 5 and chain A B",
    "within 0.4 pbc 1 0 1 of water", "dist plane 0 0 0 normal 0 0 1 < 2", "dist line 0 0 0 1 1 1 < .5", "not_water or not_hydrogen",
]


@pytest.mark.parametrize("text", ACCEPTED)
def test_accepted(text):
    parse(text)


@pytest.mark.parametrize(("text", "token"), [("backboneand x<4", "backboneand"), ("name CAand x<4", "<4"), ("proteinor water", "proteinor"), ("notprotein", "notprotein"), ("chain A an resid 5", "an"), ("", ""), ("(chain A", ""), ("1 < x > 2", ">")])
def test_rejected(text, token):
    with pytest.raises(SelectionSyntaxError) as e:
        parse(text)
    assert e.value.token == token and e.value.expected


@pytest.fixture(scope="module")
def atoms(spark):
    rows = [(0, "O", "SOL", 1, 0, "A", 8, 0.0), (1, "H1", "SOL", 1, 0, "A", 1, 1.0), (2, "H2", "SOL", 1, 0, "A", 1, 2.0), (3, "C", "ALA", 2, 1, "B", 6, 3.0), (4, "HC", "ALA", 2, 1, "B", 1, 4.0), (5, "CA", "ALA", 3, 2, "B", 6, 5.0)]
    return spark.createDataFrame([(*r[:7], r[7], 0.0, 0.0, 1.0) for r in rows], "atom_idx long, name string, resname string, resid int, resindex long, chain string, atomic_number int, x double, y double, z double, mass double")


@pytest.fixture(scope="module")
def bonds(spark):
    return spark.createDataFrame([(0, 1), (0, 2), (3, 4)], "i1 long, i2 long")


def ids(df):
    return sorted(r.atom_idx for r in df.collect())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("polh", [1, 2]), ("apolh", [4]), ("water", [0, 1, 2]), ("now", [3, 4, 5]), ("hydrogen", [1, 2, 4]), ("backbone", [3, 5]), ("sidechain", [4]), ("chain A or chain B and x > 4", [5]),
        ("same residue as name HC", [3, 4]), ("within 1 of name C", [2, 3, 4]), ("chain A and within 1 self of name C", [2, 3]), ("x > x of com of chain A", [2, 3, 4, 5]), ("x == x of pos 1 of chain B", [4]),
        ("chain B and x > x of cog of all", [5]), ("not chain A", [3, 4, 5]), ("resid 1 3", [0, 1, 2, 5]), ("name /H./", [1, 2, 4]), ("vdw > 0.15", [0, 3, 5]),
    ],
)
def test_results(atoms, bonds, text, want):
    assert ids(select(atoms, text, bonds=bonds)) == want


def test_docs_precedence(atoms):
    assert ids(select(atoms, "chain A or chain B and x > 4", docs_precedence=True)) == [0, 1, 2, 5]


def test_definitions(atoms, spark):
    assert ids(select(atoms, range(1, 3))) == [1, 2]
    assert ids(select(atoms, [4, 4, 0])) == [0, 4]
    assert ids(select(atoms, F.col("x") > 4)) == [5]
    assert ids(select(atoms, spark.createDataFrame([(2,)], "atom_idx long"))) == [2]
    with pytest.raises(EmptySelectionError):
        select(atoms, "x > 99", strict=True)


def test_guards(atoms):
    with pytest.raises(Exception, match="division by zero"):
        select(atoms, "1 / x > 0").collect()
    with pytest.raises(ValueError, match="no vx"):
        select(atoms, "vx > 0")
    with pytest.raises(ValueError, match="no box"):
        select(atoms, "within 1 pbc of name C")
