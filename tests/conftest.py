import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from paperloom import get_spark

    s = get_spark("local[4]", shuffle_partitions=4, **{"spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    return s
