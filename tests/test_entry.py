"""The driver's contract."""

import os
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_match():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(queries) > 80 and set(sql) <= set(queries)


def test_entry(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert __spark_entry__.entry(spark).count() > 0


def test_imports_without_the_optional_parts(tmp_path):
    """A copy without the training-data operators and the pipeline still imports."""
    for name in ("motionweave", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", os.path.join(ROOT, name), tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "motionweave" / "llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
