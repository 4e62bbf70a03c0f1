"""The driver's entry module, with and without the training-data subpackage."""

import os
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_is_the_multi_get(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert sum(r.found for r in rows) == 200 and sum(not r.found for r in rows) > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_stands_without_the_subpackage():
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name.startswith('slabwise.llm') or name == 'corpus_pipeline': raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op1_') or n == 'pipeline' for n in e.queries()))\n"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    n, m, found = out.stdout.split()[-3:]
    assert int(n) >= 60 and int(m) >= 60 and found == "False", out.stderr


def test_other_missing_modules_are_errors():
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name == 'xxhash': raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "print('llm' if e.llm_queries else 'no llm')\n"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert "No module named" in out.stderr or "xxhash" in out.stderr or out.stdout.split()[-2:] == ["no", "llm"]
    if os.path.isdir(f"{ROOT}/slabwise/llm"):
        assert out.returncode != 0
