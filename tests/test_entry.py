"""The entry points, with and without the corpus package."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_corpus_package(tmp_path):
    for name in ("__spark_entry__.py", "tesserae"):
        src = os.path.join(ROOT, name)
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(src) else shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'j1_ratio_match' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_nothing_else_imports_the_corpus_package():
    for top, dirs, files in os.walk(os.path.join(ROOT, "tesserae")):
        dirs[:] = [d for d in dirs if d not in ("llm", "__pycache__")]
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(top, f)) as fh:
                    assert "tesserae.llm" not in fh.read(), f


def test_flagship_has_rows(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert __spark_entry__.entry(spark).count() > 0
