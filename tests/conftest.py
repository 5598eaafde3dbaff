from __future__ import annotations

import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
# Python workers import the package too
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")]).rstrip(os.pathsep)

from tidemark import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tidemark-tests-"),
    }
    return local_session("tests", "4", **conf)


@pytest.fixture(scope="session")
def random_pairs(spark):
    """50 users x 80 items, popular items first, 10 to 29 items per user."""
    import numpy as np

    rng = np.random.default_rng(0)
    p = 1 / np.arange(1, 81) ** 0.8
    rows = []
    for u in range(50):
        n = int(rng.integers(10, 30))
        for t, i in enumerate(rng.choice(80, n, replace=False, p=p / p.sum())):
            rows.append((u, int(i), int(rng.integers(0, 50))))
    return spark.createDataFrame(rows, "user long, item long, ts long").cache()
