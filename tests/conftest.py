import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from postmetrics.session import build_session
    scratch = tempfile.mkdtemp(prefix="postmetrics-test-")
    s = build_session("local[8]", 8, app_name="postmetrics-tests",
                      extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                             "spark.local.dir": scratch, "spark.driver.memory": "8g"})
    yield s
    s.stop()
