import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from proselens.session import local

    base = tempfile.mkdtemp(prefix="proselens-tests-")
    s = local(2, **{"spark.sql.warehouse.dir": f"{base}/warehouse", "spark.checkpoint.dir": f"file://{base}/shared", "spark.driver.memory": "3g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    return SF
