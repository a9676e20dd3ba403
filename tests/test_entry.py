import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))


def test_flagship(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(r.recall == 1.0 for r in rows)


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)


def test_without_the_training_data_package(tmp_path):
    """With the folders and the pipeline gone, the rest imports and registers its queries; other errors aren't hidden."""
    copy = tmp_path / "copy"
    copy.mkdir()
    shutil.copytree(os.path.join(ROOT, "lodestar"), copy / "lodestar", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), copy)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flat_ip' in q and 'pipeline' not in q and not any(n.startswith('op3_') for n in q); e.oracle_sql()"
    env = os.environ | {"PYTHONPATH": ""}
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=env)


def test_nothing_else_imports_it():
    for folder, _, names in os.walk(os.path.join(ROOT, "lodestar")):
        if "llm" in folder.split(os.sep):
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n), encoding="utf-8") as f:
                    assert "llm" not in f.read(), n
