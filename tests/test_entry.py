"""The entry module works without the training-data subpackage, or without a library that it needs."""
import subprocess
import sys

import pytest

ROOT = __file__.rsplit("/tests/", 1)[0]
HIDE = """
import sys, importlib.abc
class Hide(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name in {hidden!r} or any(name.startswith(h + ".") for h in {hidden!r}):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hide())
sys.path.insert(0, {root!r})
import __spark_entry__ as e
print(len([q for q in e.queries() if q.startswith("op") or q == "pipeline"]), len(e.queries()) > 90, set(e.oracle_sql()) <= set(e.queries()))
"""


@pytest.mark.parametrize("hidden", [["tunekiln.llm", "corpus_pipeline"], ["xxhash"]])
def test_entry_without_the_subpackage(hidden):
    out = subprocess.run([sys.executable, "-c", HIDE.format(hidden=hidden, root=ROOT)], capture_output=True, text=True, timeout=300)
    assert out.stdout.split() == ["0", "True", "True"], out.stderr[-500:]
