import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_without_the_optional_subpackage(tmp_path):
    """The entry file and the rest work where llm and the pipeline are gone."""
    for name in ("__spark_entry__.py", "docforensics"):
        os.symlink(ROOT / name, tmp_path / name)
    os.remove(tmp_path / "docforensics")
    os.mkdir(tmp_path / "docforensics")
    for p in (ROOT / "docforensics").iterdir():
        if p.name not in ("llm", "__pycache__"):
            os.symlink(p, tmp_path / "docforensics" / p.name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'assemble_report' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
def test_flagship(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and {"scan_id", "global_score", "verdict"} <= set(out.columns)
