import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tonekit.session import build_session, ensure_checkpoint_dir  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", shuffle_partitions=8)
    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="tonekit-test-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def lexicon(spark):
    from tonekit.sources.lexicon import fixture_lexicon
    return fixture_lexicon(spark)
