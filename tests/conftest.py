import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from shopcast.session import DEFAULTS, ensure_checkpoint_dir

    builder = SparkSession.builder.master("local[4]").appName("shopcast-tests") \
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "4g")
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="shopcast-test-ckpt-"))
    s = builder.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()
