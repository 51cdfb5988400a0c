import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plumbline.session import get_spark


@pytest.fixture(scope="session")
def spark():
    os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])
    s = get_spark("tests", 8, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.sql.streaming.stateStore.stateSchemaCheck": "true"})
    s.sparkContext.setLogLevel("ERROR")
    return s
