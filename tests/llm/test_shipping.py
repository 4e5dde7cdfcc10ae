"""Workers have no copy of the package: what they run is sent to them by value."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
assert spark.range(1).mapInPandas(there, "found boolean").first()[0] is False
import corpus_pipeline
from strataline.llm import registry
folder = "/root/testdata/sf0.001"
for name, query in registry.queries().items():
    assert query(spark, folder).count() > 0, name
    print("ran", name)
assert corpus_pipeline.run(spark, folder).count() > 0
print("ran pipeline")
"""
THERE = """
def there(batches):
    import importlib.util
    import pandas as pd
    for b in batches:
        yield pd.DataFrame({"found": [importlib.util.find_spec("strataline") is not None]})
"""


def test_workers_outside_of_the_repository(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(THERE + SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script), str(Path(__file__).parents[2])], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1500)
    assert done.returncode == 0, done.stdout + done.stderr[-3000:]
    assert done.stdout.count("ran ") == 14
