"""The driver's entry on a copy of the library without its optional part."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_studies_import_without_the_text_operators(tmp_path):
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm", "*.json", "*.md")
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    # A folder that lost its files but not itself is no package with queries either.
    for left_over in (False, True):
        if left_over:
            (copy / "steadypace" / "llm").mkdir()
        code = ("import __spark_entry__ as e; from steadypace.plans.registered import QUERIES; "
                "assert set(e.queries()) == set(QUERIES), set(e.queries()) ^ set(QUERIES); "
                "assert set(e.oracle_sql()) == set(QUERIES)")
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
