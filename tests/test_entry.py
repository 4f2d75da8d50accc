"""The entry module with and without the operators for training data."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

LISTED = """
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
assert set(s) <= set(q), set(s) - set(q)
print(len(q), sum(k.startswith("op") for k in q), "pipeline" in q)
"""


def listed(folder: str) -> list[str]:
    out = subprocess.run([sys.executable, "-c", LISTED], cwd=folder, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def copy(tmp_path, *without: str) -> str:
    folder = str(tmp_path / "-".join(["copy", *(x.replace("/", "_") for x in without)]))
    shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for x in without:
        path = os.path.join(folder, x)
        shutil.rmtree(path) if os.path.isdir(path) else os.path.exists(path) and os.remove(path)
    return folder


def test_entry_survives_without_training_data_operators(tmp_path):
    bare = listed(copy(tmp_path, "textloom/llm", "tests/llm"))
    assert bare[1:] == ["0", "False"]
    assert listed(copy(tmp_path, "textloom/llm", "tests/llm", "corpus_pipeline.py")) == bare


def test_other_import_errors_are_not_hidden(tmp_path):
    folder = copy(tmp_path)
    if not os.path.isdir(os.path.join(folder, "textloom/llm")):
        return
    with open(os.path.join(folder, "textloom/llm/common.py"), "a") as f:
        f.write("\nimport no_such_module_at_all\n")
    out = subprocess.run([sys.executable, "-c", LISTED], cwd=folder, capture_output=True, text=True, timeout=120)
    assert out.returncode != 0 and "no_such_module_at_all" in out.stderr
