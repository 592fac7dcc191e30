import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SHOWN = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(k for k in e.queries() if k.startswith('op1') or k == 'pipeline'))"


@pytest.mark.parametrize("gone", [["arbora/llm"], ["arbora/llm", "corpus_pipeline.py"]])
def test_entry_without_the_subpackage(tmp_path, gone):
    """A copy of the repository without the subpackage, with and without the pipeline's file, has all other queries."""
    for part in ("arbora", "__spark_entry__.py", "corpus_pipeline.py"):
        if part not in gone and (ROOT / part).exists():
            (shutil.copytree if (ROOT / part).is_dir() else shutil.copy)(ROOT / part, tmp_path / part)
    shutil.rmtree(tmp_path / "arbora/llm", ignore_errors=True)
    (tmp_path / "arbora/llm/__pycache__").mkdir(parents=True)  # as a deleted package may leave it
    said = subprocess.run([sys.executable, "-B", "-c", SHOWN], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, sql, names = said.stdout.strip().split(" ", 2)
    assert int(n) > 70 and int(sql) > 70 and names == "[]"
