"""The driver's contract."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), *q)"


def run(folder) -> list[str]:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-B", "-c", CODE], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()[1:]


def test_import_without_session():
    assert "topk_multi" in run(ROOT)


def test_import_without_training_data_operators(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "termloom", tmp_path / "termloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    names = run(tmp_path)
    assert "topk_multi" in names and "pipeline" not in names and not any(n.startswith("op") for n in names)


def test_flagship(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 10 and rows == sorted(rows, key=lambda r: (-r.score, r.doc_id))
