import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
# workers import the package too
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from assize.session import local_session

    session = local_session(4, 4, spark__ui__showConsoleProgress="false", spark__driver__memory="4g", spark__sql__execution__arrow__maxRecordsPerBatch="1000")
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
