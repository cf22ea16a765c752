"""One local session for all tests."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from helixframe.session import local_session

    return local_session(8, 8, "6g")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
