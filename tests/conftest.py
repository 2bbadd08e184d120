import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pagelake.session import local

    return local("8")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def make_pages(spark):
    def make(*rows):
        return spark.createDataFrame(list(rows), "page_id long, url string, html string")

    return make
