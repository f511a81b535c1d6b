"""The entry module works where the optional text subpackage is not there."""

import subprocess
import sys
from pathlib import Path

ALONE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name == "tallywind.llm" or name.startswith("tallywind.llm."):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 180 and not any(k.startswith("op") and k[2].isdigit() for k in e.queries()) and "pipeline" not in e.queries()
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry_without_the_text_subpackage():
    root = Path(__file__).parent.parent
    done = subprocess.run([sys.executable, "-c", ALONE], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
