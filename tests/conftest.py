from __future__ import annotations

import pytest

from termloom.session import local


@pytest.fixture(scope="session")
def spark():
    s = local("4", partitions=4, memory="4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
