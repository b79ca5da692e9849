import os
from pathlib import Path

import pytest

from skerry.session import local_session

os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).parent.parent), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    yield local_session("4", "4g")
