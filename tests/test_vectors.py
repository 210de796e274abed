"""The queries over the vectors view use every component of an embedding."""

import numpy as np
import pytest

from netloom.operators import learners, scaling
from netloom.plans import model_queries
from netloom.plans import views as V
from tests.test_operators import plain_dbscan


@pytest.fixture(scope="module")
def points(spark, sf_dir):
    t = V.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").orderBy("vec_id").toPandas()
    return t.vec_id.to_numpy(), np.stack(t.embedding.to_numpy()).astype(float)


def test_every_component(points):
    assert points[1].shape[1] == len(model_queries.XS) == V.DIMENSIONS == 64


def test_pca_of_all_components(spark, sf_dir, points):
    got = model_queries.ml2_pca(spark, sf_dir).orderBy("vec_id").toPandas()[["x", "y"]].to_numpy()
    x = points[1] - points[1].mean(0)
    _, _, v = np.linalg.svd(x, full_matrices=False)
    assert np.abs(got) == pytest.approx(np.abs(x @ v[:2].T), abs=1e-6)


def test_moments_with_nulls(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(None if rng.random() < 0.2 else float(v) for v in rng.normal(size=3) + 1e6) for _ in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    x = np.ma.masked_invalid(np.array(rows, float))
    mean = np.array(x.mean(0))
    n, one, two = scaling._moments(df, ["a", "b", "c"], mean)
    sql = df.selectExpr(*(f"covar_samp({p}, {q})" for p in "abc" for q in "abc")).first()
    assert ((two - one * one.T / n) / (n - 1)).ravel() == pytest.approx(np.array(sql), abs=1e-6)


def test_clusters_have_distances_over_all_components(spark, sf_dir, points):
    x = (points[1] - points[1].min(0)) / (points[1].max(0) - points[1].min(0))
    got = model_queries.det5_kmeans(spark, sf_dir).orderBy("vec_id").toPandas()
    inner = [x[got.cluster == c].mean(0) for c in sorted(set(got.cluster))]
    # no distance over 8 of 64 components comes near these
    assert got.distance.mean() > 0.8 * np.mean(np.sqrt(((x - np.stack(inner)[np.searchsorted(sorted(set(got.cluster)), got.cluster)]) ** 2).sum(1)))


def test_dbscan_over_64_columns(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.uniform(size=(60, 64)), np.repeat(rng.uniform(size=(4, 64)), 15, axis=0)])
    x[60:] += rng.normal(scale=0.02, size=(60, 64))
    # copies that agree but in the last columns
    x[75:90] = x[60]
    x[75:90, 63] += np.linspace(0.1, 3, 15)
    names = [f"x{i}" for i in range(64)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "idx long, " + ", ".join(f"{n} double" for n in names))
    got = [r.cluster for r in learners.dbscan(df, names, 0.25, 5).orderBy("idx").collect()]
    assert got == plain_dbscan(x, 0.25, 5) and len(set(got)) > 2
