from __future__ import annotations

import pytest

from recollect.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("4", "tests", **{"spark__sql__shuffle__partitions": "4"})
    yield s
    s.stop()
