import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]")
        .appName("tessera-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from tessera.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="tessera-test-ckpt-"))
    yield s


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "store")


@pytest.fixture(scope="session")
def sf():
    return SF
