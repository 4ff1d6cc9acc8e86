import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from checks.compare import session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session()
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def folder():
    return SMALL


@pytest.fixture(scope="session")
def rng():
    import numpy as np

    return np.random.default_rng(7)


@pytest.fixture(scope="session")
def members(spark, rng):
    """Three clusters of unequal size with random vectors; the first holds most rows."""
    sizes = {0: 40, 1: 12, 2: 3}
    rows, rid = [], 0
    for cid, n in sizes.items():
        for _ in range(n):
            rows.append((rid, cid, [float(x) for x in rng.normal(size=8) + cid]))
            rid += 1
    return spark.createDataFrame(
        rows, "review_id bigint, cluster_id int, embedding array<float>"
    ).repartition(3)
