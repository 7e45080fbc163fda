import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "turn_no" in out.columns


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_training_operators(tmp_path):
    """The rest stands on its own."""
    code = "import __spark_entry__ as e; assert 'turn_rollup' in e.queries() and not [n for n in e.queries() if n[:2] == 'op' and n[2].isdigit() or n == 'pipeline']"
    for name in ("__spark_entry__.py", "quern"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    (tmp_path / "quern").mkdir()
    for p in (ROOT / "quern").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "quern" / p.name).symlink_to(p)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": f"{tmp_path}:{':'.join(x for x in sys.path if 'site-packages' in x)}"})


def test_workers_get_the_package(tmp_path):
    """From another folder, without a PYTHONPATH: the package is sent to the workers."""
    import os

    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
assert e.queries()["stream_turns"](spark, "/root/testdata/sf0.001").count() == 1000
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env, timeout=200)
