"""Annulus search and clustering against plain loops in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tallyflow.llm import centroids


def brute(rows, k, rounds, dims, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cs = [v for _, v in named[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        cs = [[sum(col) // len(m) for col in zip(*m)] if (m := [v for (_, v), o in zip(kept, of) if o == j]) else c for j, c in enumerate(cs)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    each = {j: sum(d for _, o, d in out if o == j) for j in range(len(cs))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return [(i, j, d, each[j], sum(each.values()), digest[j]) for i, j, d in out]


def got(df, **kw):
    return sorted((tuple(r) for r in centroids.clustered(df, **kw).collect()), key=str)


def test_given_table(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert got(df) == sorted(brute(rows, 8, 10, 64), key=str)


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice((-1.0, -0.5, 0.0, 0.5, 1.0)) for _ in range(3)]) for i in range(300)]  # many ties
    rows += [(7, [0.25, 0.0, -0.25]), (None, [1.0, 1.0, 1.0]), (400, None), (401, []), (402, [1.0, 2.0]), (403, [1.0, None, 2.0]), (404, [float("nan"), 1.0, 1.0]), (405, [float("-inf"), 0.0, 0.0]), (406, [1.0] * 4)]
    rows += [(500, [0.1, 0.1, 0.1])] * 50
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, v string, cluster int")
    plain = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    for k in (1, 5, 40):
        assert got(df, k=k, rounds=4, dims=3) == sorted(brute(plain, k, 4, 3), key=str)
    assert got(df.where("vec_id < 3"), k=8, dims=3) == sorted(brute(plain[:3], 8, 10, 3), key=str)  # fewer vectors than centroids
    empty = centroids.clustered(df.limit(0), dims=3)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="too large"):
        got(spark.createDataFrame([(1, [1e30, 0.0, 0.0])], "vec_id long, embedding array<float>"), dims=3)


def test_annulus_has_every_nearest_centroid_and_prunes():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(4000, 16)) * rng.uniform(1, 2000, size=(4000, 1))).astype(np.int64)
    c = x[:200].copy()
    c[50:60] = c[40:50]  # equal centroids: the smaller number wins
    number, distance, done = centroids.nearest(x, c)
    d = ((x[:, None, :] - c[None]) ** 2).sum(2)
    assert (distance == d.min(1)).all() and (number == d.argmin(1)).all()
    assert done < 0.6 * d.size
    on_axis = np.array([[0, 0], [10, 0], [-10, 0], [5, 0]])  # on the annulus' edge: as far from 0 and 10 as from each other
    number, distance, _ = centroids.nearest(np.array([[5, 0], [0, 0], [0, 10]]), on_axis[:3])
    assert number.tolist() == [0, 0, 0] and distance.tolist() == [25, 0, 100]
