"""The driver's entry with and without the optional parts."""
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(len(e.queries()), sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline'), set(e.oracle_sql()) <= set(e.queries()))"


def names(folder) -> str:
    run = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return run.stdout


@pytest.mark.parametrize("left_out", [("cohortwave/llm", "corpus_pipeline.py"), ("cohortwave/llm",), ("corpus_pipeline.py",)])
def test_entry_without_optional_parts(tmp_path, left_out):
    skip = lambda d, fs: [f for f in fs if f == "__pycache__" or os.path.relpath(os.path.join(d, f), ROOT) in left_out]
    shutil.copytree(os.path.join(ROOT, "cohortwave"), tmp_path / "cohortwave", ignore=skip)
    for f in ("__spark_entry__.py", "corpus_pipeline.py"):
        if f not in left_out and os.path.exists(os.path.join(ROOT, f)):
            shutil.copy(os.path.join(ROOT, f), tmp_path / f)
    out = names(tmp_path)
    assert "pipeline" not in out and out.strip().endswith("True")
    if "cohortwave/llm" in left_out:
        assert " [] " in out
    (tmp_path / "cohortwave/llm/__pycache__").mkdir(parents=True, exist_ok=True)  # a folder with no modules is no package
    names(tmp_path)
