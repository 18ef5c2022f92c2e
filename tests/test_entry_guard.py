"""Without the training-data subpackage the entry point still imports and has the other queries."""

import subprocess
import sys
from pathlib import Path

CODE = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("sluice.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
names = set(e.queries())
assert "weekly_cumulative" in names and "pipeline" not in names and not any(n.startswith("op") for n in names)
assert set(e.oracle_sql()) <= names
"""


def test_entry_without_the_subpackage():
    subprocess.run([sys.executable, "-c", CODE], cwd=Path(__file__).parents[1], check=True)
