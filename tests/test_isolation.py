"""The library without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q = e.queries(); assert 'length' in q and 'pipeline' not in q and not [n for n in q if n[:2] == 'op' and n[2].isdigit()]; assert set(e.oracle_sql()) <= set(q)"


def test_queries_without_the_subpackage(tmp_path):
    for keep_folder in (False, True):  # an empty folder may stay
        copy = tmp_path / str(keep_folder)
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json"))
        if keep_folder:
            (copy / "seriesloom" / "llm").mkdir()
        subprocess.run([sys.executable, "-c", ASK], cwd=copy, check=True)
