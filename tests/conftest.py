import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from mediaweave.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tests")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def one_page(spark):
    """Node table of one page with the given markup in its body."""
    from mediaweave.operators.nodes import nodes

    def build(html, url="https://site.example/a/b.html"):
        return nodes(spark.createDataFrame([(1, url, html)], "page_id long, url string, html string"))

    return build
