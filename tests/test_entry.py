"""The driver's contract, also where the optional subpackage is gone."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_and_twins():
    sys.path.insert(0, REPO)
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80


def test_entry_runs(spark):
    import __spark_entry__ as e

    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).count() > 0


def test_imports_without_the_subpackage(tmp_path):
    for name in ("quillspark", "__spark_entry__.py"):
        src = os.path.join(REPO, name)
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(src) else shutil.copy(src, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_subpackage():
    for top, _, names in os.walk(os.path.join(REPO, "quillspark")):
        if os.path.basename(top) in ("llm", "__pycache__"):
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(top, n), encoding="utf-8") as f:
                    assert "llm" not in [w.strip(".,") for line in f if line.lstrip().startswith(("import ", "from ")) for w in line.replace(".", " ").split()], n
