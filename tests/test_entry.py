"""The entry points import and run with and without the text operators."""

import os
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_without_the_text_operators(tmp_path):
    """As after deleting the text folders and the pipeline."""
    for name in ("framewright", "__spark_entry__.py"):
        os.symlink(f"{ROOT}/{name}", tmp_path / name) if name.endswith(".py") else _copy(f"{ROOT}/{name}", tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, check=True)


def _copy(source, target):
    import shutil

    shutil.copytree(source, target, ignore=shutil.ignore_patterns("llm", "__pycache__"))
