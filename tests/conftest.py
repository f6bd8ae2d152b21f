import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mixloom.model import Mixture  # noqa: E402
from mixloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        app="mixloom-tests", master="local[4]", shuffle_partitions=4, **{"spark.driver.memory": "6g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def blob_array(n=600, seed=3):
    """Three separated clouds with unlike shapes."""
    rng = np.random.default_rng(seed)
    shapes = [
        ([0.2, 0.2], [[0.004, 0.001], [0.001, 0.002]]),
        ([0.8, 0.3], [[0.002, -0.001], [-0.001, 0.006]]),
        ([0.5, 0.8], [[0.006, 0.0], [0.0, 0.001]]),
    ]
    counts = [n // 2, n // 3, n - n // 2 - n // 3]
    return np.vstack(
        [rng.multivariate_normal(m, c, size) for (m, c), size in zip(shapes, counts)]
    )


@pytest.fixture(scope="session")
def blob_points():
    return blob_array()


@pytest.fixture(scope="session")
def blobs(spark, blob_points):
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(blob_points)]
    return spark.createDataFrame(rows, "point_id bigint, x double, y double").repartition(3).cache()


@pytest.fixture(scope="session")
def start():
    return Mixture.at_points([[0.1, 0.1], [0.9, 0.2], [0.5, 0.9]])


def plain_em_step(points, weights, means, covs, reg=0.0):
    """Textbook step on an in-memory array, for comparison."""
    n, d = points.shape
    dens = np.empty((n, len(weights)))
    for k, (w, m, c) in enumerate(zip(weights, means, covs)):
        diff = points - m
        q = np.einsum("ni,ij,nj->n", diff, np.linalg.inv(c), diff)
        dens[:, k] = w * np.exp(-0.5 * q) / np.sqrt((2 * np.pi) ** d * np.linalg.det(c))
    total = dens.sum(axis=1)
    r = dens / total[:, None]
    size = r.sum(axis=0)
    new_means = (r.T @ points) / size[:, None]
    new_covs = np.stack(
        [
            ((points - m).T * r[:, k]) @ (points - m) / size[k] + reg * np.eye(d)
            for k, m in enumerate(new_means)
        ]
    )
    return size / n, new_means, new_covs, np.log(total).sum(), r
