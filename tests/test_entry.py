import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; from sandhi.plans import catalog as c; q = set(e.queries()); assert set(c.queries()) <= q and set(e.oracle_sql()) <= q; print(len(q) - len(c.queries()))"


def run(at, code=COUNT):
    return subprocess.run([sys.executable, "-c", code], cwd=at, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(at)})


def copied(tmp_path):
    at = tmp_path / "repo"
    shutil.copytree(os.path.join(REPO, "sandhi"), at / "sandhi", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(os.path.join(REPO, "__spark_entry__.py"), at)
    return at


def test_without_the_subpackage(tmp_path):
    at = copied(tmp_path)
    shutil.rmtree(at / "sandhi" / "llm", ignore_errors=True)
    r = run(at)
    assert r.returncode == 0 and r.stdout.strip() == "0", r.stderr
    (at / "sandhi" / "llm" / "__pycache__").mkdir(parents=True)  # what is left when only tracked files are removed
    r = run(at)
    assert r.returncode == 0 and r.stdout.strip() == "0", r.stderr


def test_without_a_library_of_the_subpackage(tmp_path):
    at = copied(tmp_path)
    r = run(at, "import sys; sys.modules['sandhi.llm.catalog'] = None; " + COUNT)
    assert r.returncode == 0 and r.stdout.strip() == "0", r.stderr


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from sandhi.runtime import shared_dir

    class Conf(dict):
        def get(self, key, default=None):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077", "getConf": lambda self: Conf()})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_intermediate_tables_are_removed(tmp_path):
    """By clean at once, and when the driver ends, whether or not the session was stopped."""
    code = """
import os, sys
from sandhi.runtime import build_session, clean, materialize
spark = build_session('local[1]', 'end', spark_checkpoint_dir='file://' + sys.argv[1])
assert materialize(spark.range(3), 'x').count() == 3 and len(os.listdir(sys.argv[1] + '/sandhi')) == 1
clean(spark)
assert os.listdir(sys.argv[1] + '/sandhi') == []
assert materialize(spark.range(3), 'y').count() == 3
if sys.argv[2] == 'stop':
    spark.stop()
print(len(os.listdir(sys.argv[1] + '/sandhi')))
"""
    for end in ("stop", "leave"):
        r = subprocess.run([sys.executable, "-c", code, str(tmp_path), end], cwd=REPO, capture_output=True, text=True, timeout=180, env={**os.environ, "PYTHONPATH": REPO})
        assert r.returncode == 0 and r.stdout.strip().endswith("1"), r.stderr[-2000:]
        assert os.listdir(tmp_path / "sandhi") == []
