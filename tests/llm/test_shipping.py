"""Task functions travel with the job: the workers of these runs can't import the repository."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"

RUN = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as driver
from lakeloom.session import build_session

spark = build_session("ship", **{"spark.master": "local[4]", "spark.sql.shuffle.partitions": "2", "spark.ui.showConsoleProgress": "false"})
spark.sparkContext.setLogLevel("OFF")

def importable(batches):
    import importlib.util
    for b in batches:
        yield b.assign(id=int(importlib.util.find_spec("lakeloom") is not None))

assert spark.range(1).mapInPandas(importable, "id long").first()[0] == 0, "the workers see the package"
for name, run in driver.queries().items():
    if name.startswith("op"):
        assert run(spark, sys.argv[2]).count() > 0, name
        print("ran", name, flush=True)
"""


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
def test_queries_run_where_workers_lack_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    env |= {"PYSPARK_PYTHON": sys.executable, "PYTHONSAFEPATH": "1"}
    done = subprocess.run([sys.executable, "-c", RUN, str(REPO), SF], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert "ran op3_minhash_near_dedup" in done.stdout
