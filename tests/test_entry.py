"""The entry module loads wherever Python and PySpark do."""

import subprocess
import sys
from pathlib import Path

from reviewmill.operators.extractive import default_stop_words

ROOT = Path(__file__).resolve().parents[1]

BARE = """
import sys, glob, os
sys.path.insert(0, {root!r})
real = glob.glob
glob.glob = lambda *a, **k: []          # no file of the installation can be found
os.environ.pop("SPARK_HOME", None)
for name in ("xxhash", "regex", "public_tokenizers", "tokenizers"):
    sys.modules[name] = None            # importing it raises ImportError
import __spark_entry__ as e
assert "active_cluster_summary" in e.queries() and "issue_ranking" in e.oracle_sql()
assert set(e.oracle_sql()) <= set(e.queries())
print(len(e.queries()), len(e.oracle_sql()))
"""


def test_entry_without_optional_libraries_or_jars():
    done = subprocess.run([sys.executable, "-c", BARE.format(root=str(ROOT))], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    found, checked = map(int, done.stdout.split()[-2:])
    assert found >= 66 and checked >= 60


def test_kept_stop_words_are_those_of_spark(spark):
    from checks.oracle import stop_words

    assert stop_words() == default_stop_words()
