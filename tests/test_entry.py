import os
import subprocess
import sys

import __spark_entry__ as entry

REPO = os.path.dirname(os.path.abspath(entry.__file__))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_subpackage(tmp_path):
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("reedbed.llm"):
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "p1_found" in e.queries() and "p2_found" not in e.queries()
"""
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(REPO, "reedbed")):
        if f"{os.sep}llm" in folder:
            continue
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "reedbed.llm" not in f.read()


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
