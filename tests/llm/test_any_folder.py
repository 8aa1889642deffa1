"""Jobs run from any folder: the workers cannot import the package."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from driftline.llm.queries import QUERIES
from driftline.session import build_session
spark = build_session(master="local[4]", **{{"spark.sql.shuffle.partitions": "4",
                                            "spark.ui.showConsoleProgress": "false"}})
def importable(batches):
    for batch in batches:
        try:
            import driftline
            yield batch
        except ImportError:
            pass
assert spark.range(3).mapInPandas(importable, "id long").count() == 0
for name, build in QUERIES.items():
    assert build(spark, "/root/testdata/sf0.001").count() > 0, name
    print("done", name)
"""


def test_queries_run_where_the_package_is_not_installed(tmp_path):
    from driftline.llm.queries import QUERIES

    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path,
                         env=environment, capture_output=True, text=True, timeout=600)
    done = [line.split()[1] for line in run.stdout.splitlines() if line.startswith("done")]
    assert done == list(QUERIES), run.stderr[-3000:]
