"""The entry point with and without the optional part."""

import subprocess
import sys

import __spark_entry__
from corpusmill import queries as base


def test_base_queries_need_no_optional_package():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "ahocorasick":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print("N", len(e.queries()), len(e.oracle_sql()))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__spark_entry__.__file__.rsplit("/", 1)[0])
    assert out.stdout.split()[-2:] == [str(len(base.QUERIES)), str(len(base.ORACLES))], out.stderr[-500:]


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
