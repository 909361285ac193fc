import json
import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from spanloom.plans import catalog

ROOT = Path(__file__).resolve().parent.parent


def test_every_query_of_the_catalogue_is_registered():
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(catalog.ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    if not os.path.isdir(entry.FLAGSHIP_DIR):
        return
    found = entry.entry(spark)
    assert found.count() > 0 and "n_shifts" in found.columns


def test_imports_without_the_text_subpackage(tmp_path):
    """The entry works in a copy of the repository that lacks the subpackage and the pipeline."""
    import shutil

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e, json; print(json.dumps(sorted(e.queries())))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True)
    names = json.loads(out.stdout.splitlines()[-1])
    assert set(names) == set(catalog.QUERIES)


def test_nothing_else_imports_the_text_subpackage():
    for path in (ROOT / "spanloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
