"""The text-pipeline subpackage may be absent; nothing else imports it."""

import pathlib
import re
import subprocess
import sys

REPO = pathlib.Path(__file__).resolve().parent.parent


def test_entry_module_without_it():
    code = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name.startswith('tidewell.llm') or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as e
assert len(e.queries()) > 60 and set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_nothing_else_imports_it():
    for path in REPO.glob("tidewell/**/*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"tidewell\.llm|import llm", path.read_text())
