"""The driver's contract, with and without the training-data subpackage."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_works_without_the_subpackage(tmp_path):
    """A copy without the two folders and the pipeline imports, and its own tests of text and batches pass."""
    for source in [ROOT / "__spark_entry__.py", *(ROOT / "opinarium").rglob("*.py"), *(ROOT / "tests").rglob("*.py")]:
        to = tmp_path / source.relative_to(ROOT)
        if "llm" not in to.relative_to(tmp_path).parts:
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(source.read_bytes())
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    code = "import __spark_entry__ as e, opinarium; assert opinarium.__file__.startswith(e.HERE); q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op1') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
    subprocess.run([sys.executable, "-m", "pytest", "-x", "-q", "-p", "no:cacheprovider", "tests/test_text.py", "tests/test_operators.py", "-k", "row_ids or retries or fuzzy or profiles"], cwd=tmp_path, env=env, check=True)
