import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from boxlens import checkpoint_dir, get_spark
    s = get_spark("local[4]", 4, extra={"spark.driver.memory": "4g"})
    checkpoint_dir(s)
    yield s


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)


SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
