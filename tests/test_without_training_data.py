"""The library without its training-data operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and set(e.oracle_sql()) <= set(e.queries()); assert not [k for k in e.queries() if k.startswith('op') or k == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    os.makedirs(tmp_path / "copy/linkrisk/llm/__pycache__")  # a folder without code counts as taken out
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_entry_imports_where_a_package_of_theirs_is_missing():
    code = "import sys; sys.modules['xxhash'] = sys.modules['tokenizers'] = sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; assert len(e.queries()) > 50 and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_the_other_tests_can_be_run_without_them(tmp_path):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    os.remove(tmp_path / "copy/corpus_pipeline.py")
    run = [sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests", "-k", "meets_box or coverage or registry"]
    done = subprocess.run(run, cwd=tmp_path / "copy", capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0 and " passed" in done.stdout and "error" not in done.stdout, done.stdout[-2000:]
