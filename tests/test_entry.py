"""The entry module, whole and without the subpackage for training data."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_queries_and_sql_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    from lacework import queries

    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).first()["triangles"] == 830


@pytest.mark.parametrize("empty_folder", [False, True])
@pytest.mark.parametrize("pipeline", [False, True])
def test_without_the_subpackage(tmp_path, empty_folder, pipeline):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "lacework", tmp_path / "lacework", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    if empty_folder:
        (tmp_path / "lacework/llm").mkdir()
    code = "import __spark_entry__ as e; print(len(e.queries()), 'triangle_count' in e.oracle_sql(), any(n.startswith('op1_') for n in e.queries()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert run.returncode == 0, run.stderr
    said = run.stdout.split()
    assert int(said[0]) > 40 and said[1:] == ["True", "False"]


def test_other_import_errors_are_not_hidden(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "lacework", tmp_path / "lacework", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module_anywhere\n")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert run.returncode and "no_such_module_anywhere" in run.stderr
