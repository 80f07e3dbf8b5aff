import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from qoeflow.session import build_session
    ckpt = tempfile.mkdtemp(prefix="qoeflow-test-ckpt-")
    s = build_session("local[*]", 8, extra={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()
