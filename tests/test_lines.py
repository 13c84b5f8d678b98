import pytest

from atomweave.sources import files, lines, text
from test_uneven import same

ITP = """; a molecule
[ moleculetype ]
M 3
#ifdef X
[ atoms ] ; nr type resnr
;[ bonds ]
1 CT  1 ALA CA 1 -0.1250 12.011 ; own
   2\tHC 1 ALA HA 2 0.5 1.008 0 extra fields\r

#include "x.itp"
3 OW +7 SOL OW 3 .25 1_5
4 OW 0x1 SOL OW 3 1e-3 x
{end}6 CT 1 ALA CA 1 0.0 12.0
[ atoms ]
7 CT 1 ALA CA 1 0.0 12.0
"""


@pytest.mark.parametrize("size", [7, 40, 1 << 20])
def test_itp_by_ranges(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(lines, "RANGE_BYTES", size)
    made = [ITP.format(end=""), ITP.format(end="[ bonds ]\n1 2\n"), ITP.format(end="1 2 short\n"), ITP.format(end="").rstrip("\n"), "[ atoms ]\n", "no section\n", ""]
    for k, t in enumerate(made):
        (tmp_path / f"{k}.itp").write_bytes(t.encode())
    got = files.read(spark, str(tmp_path / "*.itp"))
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    rows = sorted((r.path.rpartition("/")[2], *r[1:]) for r in got.collect())
    assert rows == sorted((f"{k}.itp", 0, *r) for k, t in enumerate(made) for r in text.read_itp(t).rows("atoms"))
    assert len(rows) == 5 + 4 + 4 + 5


def test_itp_of_a_table(spark, sf_dir, monkeypatch):
    """6000 lines, written in parts of 1000 and read by ranges of 5000 bytes."""
    monkeypatch.setattr(lines, "PART_LINES", 1000)
    monkeypatch.setattr(lines, "RANGE_BYTES", 5000)
    same(spark, sf_dir, "file_itp")
