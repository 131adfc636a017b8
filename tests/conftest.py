import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from ledgerloom.session import get_session
    extra = {"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"}
    s = get_session("local[4]", app="ledgerloom-tests", shuffle_partitions=4, extra=extra)
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():  # only when the environment names none
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-test-ckpt-"))
    yield s
    s.stop()


SF_SMALL = "/root/testdata/sf0.001"
