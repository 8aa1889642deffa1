import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_and_sql_load_without_a_session():
    """The driver may list them before it starts Spark."""
    run = subprocess.run([sys.executable, "-c", (
        "import __spark_entry__ as e\n"
        "q, s = e.queries(), e.oracle_sql()\n"
        "from driftline.catalog import load_all\n"
        "own, sql = load_all()\n"
        "assert set(own) == set(sql) and set(s) <= set(q) and len(own) >= 150, len(own)\n")],
        cwd=REPO, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr[-2000:]
