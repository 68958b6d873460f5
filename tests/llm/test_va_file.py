"""Clusters over approximations against plain rounds, and how few vectors are fetched."""

import hashlib
import io
import math

import numpy as np
import pytest

from cohortloom.llm import va_file

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, distance string, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 7, "d", "x") for i, v in rows], SCHEMA)


def plain(rows, k, dimensions, rounds):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    first = sorted((i is None, digest(f"2:{i}"), v) for i, v in kept)[:k]
    centroids = [v for *_, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    place = lambda: [min((far(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        own = place()
        for n in range(len(centroids)):
            if members := [v for (_, v), (_, m) in zip(kept, own) if m == n]:
                centroids[n] = [sum(c) // len(members) for c in zip(*members)]
    own = place()
    inertia = [sum(d for d, m in own if m == n) for n in range(len(centroids))]
    return sorted(((i, m, d, inertia[m], sum(inertia), digest(",".join(map(str, centroids[m])))) for (i, _), (d, m) in zip(kept, own)),
                  key=str)


def vectors(seed, n, dimensions):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 0.6, (6, dimensions))
    rows = [(i, (middles[rng.integers(6)] + rng.normal(0, 0.3, dimensions)).tolist()) for i in range(n)]
    rows += [(n + i, [0.25] * dimensions) for i in range(8)]  # ties and copies
    rows += [rows[0], rows[1], (None, rows[2][1]), (None, rows[3][1]), (5, rows[9][1])]
    rows += [(n + 20, None), (n + 21, []), (n + 22, [0.1] * (dimensions + 1)), (n + 23, [None] + [0.1] * (dimensions - 1)),
             (n + 24, [math.nan] + [0.1] * (dimensions - 1)), (n + 25, [math.inf] + [0.1] * (dimensions - 1)),
             (n + 26, [1000.0] * dimensions)]
    return rows


@pytest.mark.parametrize("dimensions, k, rounds", [(8, 12, 5), (7, 5, 2), (8, 400, 1), (8, 3, 0)])
def test_clusters_equal_plain_rounds(spark, monkeypatch, dimensions, k, rounds):
    monkeypatch.setattr(va_file, "FILE_VECTORS", 50)
    monkeypatch.setattr(va_file, "BLOCK", 16)
    rows = vectors(dimensions + k, 230, dimensions)
    got = va_file.cluster(table(spark, rows).repartition(3), k=k, dimensions=dimensions, rounds=rounds)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, k, dimensions, rounds)
    assert va_file.cluster(table(spark, rows[-7:-1]), k=k, dimensions=dimensions, rounds=rounds).collect() == []
    assert va_file.cluster(table(spark, []), k=k, dimensions=dimensions).collect() == []


class Source(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


def test_only_contested_vectors_are_fetched():
    rng = np.random.default_rng(3)
    centroids = rng.integers(-200, 200, (20, 64))
    v = centroids[rng.integers(0, 20, 5000)] + rng.integers(-20, 20, (5000, 64))
    borders = np.sort(rng.integers(-200, 200, (64, va_file.CELLS - 1)), axis=1)
    lo, hi = v.min(axis=0), v.max(axis=0)
    least, most = va_file.distance_tables(centroids, lo, hi, borders)
    exact = ((v[:, None] - centroids) ** 2).sum(axis=-1)
    cells = va_file.pack_cells(v, borders)
    low, high = (sum(t[p][cells[:, p]] for p in range(32)) for t in (least, most))
    assert (low <= exact).all() and (exact <= high).all()
    file = va_file.VaFile(Source(va_file.VaFile.content(np.arange(5000), np.ones(5000), v, borders)), 5000, 64)
    own, fetched = va_file.nearest(file, centroids, (least, most))
    assert (own == exact.argmin(axis=1)).all() and fetched < 2500
    assert (file.vectors(np.array([0, 3, 40, 4999])) == v[[0, 3, 40, 4999]]).all()
    assert (file.ids()[0] == np.arange(5000)).all() and file.ids()[1].all()
