import pytest

from atomweave.facade import System
from atomweave.operators.selection import EmptySelectionError

GRO = "t= 1.000\n4\n    1SOL     OW    1   0.100   0.100   0.100\n    1SOL    HW1    2   0.200   0.100   0.100\n    2SOL     OW    3   1.900   0.100   0.100\n    2SOL    HW1    4   1.000   1.000   1.000\n   2.00000   2.00000   2.00000\n"


def test_system(spark, tmp_path):
    path = str(tmp_path / "w.gro")
    with open(path, "w") as f:
        f.write(GRO)
    s = System.open(spark, path)
    ids = lambda sel: sorted(r.atom_idx for r in sel.rows.collect())
    assert s.check_sizes() and ids(s()) == [0, 1, 2, 3] and ids(s((1, 3))) == [1, 2] and ids(s("name OW")) == [0, 2]
    o, h = s("name OW"), s("name HW1")
    assert ids(o | h) == [0, 1, 2, 3] and ids(o & s("resid 1")) == [0] and ids(o - s("resid 1")) == [2] and ids(~o) == [1, 3] and ids(o("resid 2")) == [2] and ids(s()((1, 2))) == [1, 2]
    assert [(r.i, r.j) for r in o.neighbours(None, 0.3, pbc=True).collect()] == [(0, 2)] and o.neighbours(None, 0.3).count() == 0
    assert abs(o.cog(pbc=True).first().x) < 1e-9 and ids(s("resid 2 and name OW").whole_residues()) == [2, 3]
    with pytest.raises(EmptySelectionError):
        s("resid 99").checked()
