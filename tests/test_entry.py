from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 10 and df.columns[0] == "pano"
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_alone(tmp_path):
    """Without the folders of the training-data operators the entry file still imports."""
    import shutil

    shutil.copytree(ROOT / "streetlens", tmp_path / "streetlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), [n for n in e.queries() if n.startswith('op')])"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and said.stdout.split()[0] == said.stdout.split()[1] and said.stdout.rstrip().endswith("[]"), said.stderr
