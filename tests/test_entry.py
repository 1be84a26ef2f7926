"""The driver contract: what is listed with and without the training-data package, and from any folder."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parent.parent
BARE = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}


def run(code, repo, cwd):
    said = subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {str(repo)!r})\n{code}"], cwd=cwd, env=BARE, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr[-2000:]
    return said.stdout.split()


def test_queries_without_the_training_data_package(tmp_path):
    skip = lambda folder, names: [n for n in names if n in (".git", "__pycache__") or n == "llm" and Path(folder).name in ("plumbline", "tests")]
    shutil.copytree(HERE, tmp_path / "repo", ignore=skip)
    list_all = "import __spark_entry__ as e; print(*e.queries(), '|', *e.oracle_sql())"
    names = run(list_all, tmp_path / "repo", tmp_path)
    from plumbline.plans.catalogue import QUERIES

    assert set(names[: names.index("|")]) == set(QUERIES)
    (tmp_path / "repo" / "corpus_pipeline.py").unlink()
    assert run(list_all, tmp_path / "repo", tmp_path) == names
    if (HERE / "plumbline" / "llm").exists():
        both = run(list_all, HERE, tmp_path)
        assert set(both[: both.index("|")]) > set(QUERIES)


def test_workers_get_the_package(tmp_path):
    """A query with Python workers, called from another folder without PYTHONPATH."""
    code = """
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", e.queries()["mth04_feature_hashing"](spark, "/root/testdata/sf0.001").count())
"""
    assert "rows" in run(code, HERE, tmp_path)


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    import pytest

    from plumbline import session

    class Unset:
        def __getattr__(self, name):
            return lambda *a: Unset()

        def isDefined(self):
            return False

    class Context:
        master, _jsc = "spark://host:7077", Unset()

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="checkpoint.dir"):
        session.shared_folder(Session())
    assert session.shared_folder(spark)
