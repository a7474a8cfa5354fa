import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from corpuscope.session import build_session

    s = build_session(master="local[4]", shuffle_partitions=8, app="corpuscope-tests")
    yield s
    s.stop()


@pytest.fixture
def corpus(spark):
    """Build a (file, text[, lang]) corpus from (file, text) or (file, text, lang) tuples."""

    def make(rows, with_lang=False):
        schema = "file string, text string, lang string" if with_lang else "file string, text string"
        return spark.createDataFrame(rows, schema)

    return make
