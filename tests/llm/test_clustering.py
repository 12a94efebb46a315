"""Orchard's search and clustering, against plain comparison with every centroid."""

import hashlib
import math

import compare
import numpy as np
import pytest

from gleanbox.llm import clustering as C
from gleanbox.llm import queries

VEC = "vec_id long, embedding array<float>"


def plain_nearest(vectors, centroids):
    far = ((vectors[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    return far.argmin(axis=1), far.min(axis=1)


def plain_clusters(rows, k=16, rounds=3):
    """Rows (vec_id, components): whole numbers, first centroids, rounds, and the figures."""
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    sha = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    mids = [list(v) for _, v in sorted(kept, key=lambda x: (x[0] is None, sha(x[0]), x[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(mids))
    for _ in range(rounds):
        own = [[] for _ in mids]
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        mids = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else m for o, m in zip(own, mids, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = {c: sum(d for _, d, e in found if e == c) for c in range(k)}
    return sorted([(i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, mids[c])).encode()).hexdigest()) for i, d, c in found], key=repr)


def clusters(spark, rows):
    return sorted([tuple(r) for r in C.cluster_vectors(spark.createDataFrame(rows, VEC)).collect()], key=repr)


@pytest.mark.parametrize("seed", range(8))
def test_search_finds_the_nearest_and_the_smallest_of_equals(seed):
    r = np.random.default_rng(seed)
    size, k, most = int(r.choice([1, 2, 8])), int(r.choice([1, 2, 5, 16])), int(r.choice([2, 5, 1000]))  # few values: many ties and equal centroids
    vectors, centroids = r.integers(-most, most, (400, size)), r.integers(-most, most, (k, size))
    best, far = C.orchard(vectors, centroids, C.neighbour_lists(centroids))
    want = plain_nearest(vectors, centroids)
    assert (best == want[0]).all() and (far == want[1]).all()


def test_search_passes_over_what_is_too_far():
    """With clusters far apart a walk ends long before the end of its list."""
    centroids = np.array([[1000 * k] for k in range(16)])
    lists = C.neighbour_lists(centroids)
    calls = []

    class Counted(np.ndarray):
        def __getitem__(self, k):
            calls.append(np.size(k) if not isinstance(k, slice) else 1)
            return super().__getitem__(k)

    C.orchard(np.zeros((10, 1), dtype=np.int64), centroids.view(Counted), lists)
    assert sum(calls) < 10 * 16


def test_clusters(spark):
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=64) / 5 + (i % 5)).tolist()) for i in range(300)]
    assert clusters(spark, rows) == plain_clusters(rows)


def test_defined_cases(spark):
    r = np.random.default_rng(4)
    v = [(r.normal(size=64)).tolist() for _ in range(30)]
    rows = list(enumerate(v)) + [(None, v[0]), (None, None), (7, v[7]), (7, v[7]), (7, v[8]), (90, []), (91, v[1][:63]), (92, v[1] + [0.0]), (93, [None] + v[1][1:]), (94, [float("nan")] + v[1][1:]), (95, [float("-inf")] + v[1][1:])]
    rows += [(200 + k, v[2]) for k in range(40)]  # one very common vector
    assert clusters(spark, rows) == plain_clusters(rows)
    assert clusters(spark, rows[:5]) == plain_clusters(rows[:5])
    same = [(k, v[3]) for k in range(20)]  # equal centroids: all go to the first, the others stay empty
    got = clusters(spark, same)
    assert got == plain_clusters(same) and {x[1] for x in got} == {0}
    assert clusters(spark, []) == [] and clusters(spark, [(1, None), (2, [1.0])]) == []
    clash = spark.createDataFrame(rows, VEC).selectExpr("*", "1 as v", "2 as cluster", "3 as h", "4 as distance")
    assert sorted([tuple(x) for x in C.cluster_vectors(clash).collect()], key=repr) == plain_clusters(rows)


def test_components_beyond_exact_squares_raise(spark):
    with pytest.raises(Exception, match="beyond 2\\^26"):
        clusters(spark, [(1, [1e9] * 64)])


def test_query_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare.differences(queries.op12_orchard_search(spark, sf), compare.connection(sf), queries.oracle_sql()["op12_orchard_search"]) == ""
