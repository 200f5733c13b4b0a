"""The driver's entry point with packages missing."""

import subprocess
import sys
from pathlib import Path

import pytest

from keyspan.plans import ORACLES, QUERIES

ROOT = Path(__file__).parents[1]
BLOCK = """
import sys, warnings
warnings.simplefilter("ignore")
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {names!r} or name in {names!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as entry
print(len(entry.queries()), len(entry.oracle_sql()), "pipeline" in entry.queries())
"""


@pytest.mark.parametrize("names", [("xxhash",), ("public_tokenizers",), ("keyspan.llm", "corpus_pipeline"), ("xxhash", "public_tokenizers", "tokenizers")])
def test_the_other_queries_are_there_without(names):
    out = subprocess.run([sys.executable, "-c", BLOCK.format(names=names)], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= len(QUERIES) and int(out[1]) >= len(ORACLES)
    assert set(names) & {"xxhash", "keyspan.llm", "public_tokenizers"} and out[2] == "False"
