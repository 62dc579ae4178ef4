import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for p in (ROOT, os.path.dirname(os.path.abspath(__file__))):
    if p not in sys.path:
        sys.path.insert(0, p)
# workers find the library and the functions of test modules
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "6g", "spark.log.level": "ERROR", "spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="spark-test-"),
    }
    s = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    yield s
    s.stop()
