import numpy as np
import pytest

from quern.llm import embedding_dedup as E


def brute(rows):
    good = []
    for v, x, label in rows:
        ok = x is not None and label is not None and len(x) > 0 and None not in x and np.isfinite(x).all() and any(x)
        good.append(bool(ok) and np.asarray(x, float) / np.linalg.norm(x))
    n = len(rows)
    link = [[i != j and rows[i][2] == rows[j][2] and good[i] is not False and good[j] is not False and len(good[i]) == len(good[j]) and float(good[i] @ good[j]) >= 0.93 for j in range(n)] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if link[i][j]:
                    root[i] = root[j] = min(root[i], root[j])
    least = {}
    for i in range(n):
        least.setdefault(root[i], []).append(rows[i][0])
    return [(rows[i][0], sum(link[i]), min(least[root[i]])) for i in range(n)]


def vectors(seed=0, n=60, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = rng.standard_normal(dim)
        for _ in range(rng.integers(1, 4)):
            rows.append((len(rows) * 7 % 1009, (x + rng.standard_normal(dim) * rng.choice([0.05, 0.2, 0.3])).astype(np.float32).tolist(), int(i % 2)))
    rows += [(2000, rows[0][1], rows[0][2]), (2001, rows[0][1], None), (2002, None, 1), (2003, [0.0] * dim, 1), (2004, [float("nan")] * dim, 1), (2005, [float("inf")] + [1.0] * (dim - 1), 1)]
    rows += [(2006, [None] + [1.0] * (dim - 1), 0), (2007, [], 0), (2008, rows[0][1], rows[0][2]), (2009, [2 * v for v in rows[0][1]], rows[0][2])]
    rows += [(2010, [1.0, 2.0, 3.0], 0), (2011, [1.0, 2.0, 3.1], 0), (2012, [-1.0, 2.0, 3.0], 0), (2013, [5.0], 1), (2014, [7.0], 1), (2015, [-7.0], 1)]
    return rows


def test_every_link_with_exhaustive_radius(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in E.near_duplicates(df, recall=1.0, block=16).collect())
    assert got == sorted(brute(rows))


def test_lengths_without_a_codebook_are_exact(spark, monkeypatch):
    monkeypatch.setattr(E, "LENGTHS", 1)
    rows = vectors(seed=3, n=30)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in E.near_duplicates(df, recall=1.0, block=16).collect())
    assert got == sorted(brute(rows))


def at_threshold(rng, n, dim, rank):
    """Vectors and partners at exactly the threshold, all in `rank` random directions."""
    span = rng.standard_normal((rank, dim))
    x = E.unit_rows(rng.standard_normal((n, rank)) @ span)
    noise = rng.standard_normal((n, rank)) @ span
    noise -= (noise * x).sum(1, keepdims=True) * x
    return x, 0.93 * x + np.sqrt(1 - 0.93**2) * E.unit_rows(noise)


@pytest.mark.parametrize("rank,k", [(64, 16), (8, 16), (4, 16), (4, 64)])
def test_recall_at_the_threshold(rank, k):
    """Pairs at exactly the threshold, the hardest there are: at least 0.9 are found from either side, also where vectors lie in few directions."""
    x, y = at_threshold(np.random.default_rng(5), 4000, 64, rank)
    index = E.MultiIndex(x[:2000], k, 0.93, E.RECALL)
    found = 0
    for p, q in ((x, y), (y, x)):
        _, _, a, b = index.places(p)
        i, j, _, _ = index.places(q)
        one = a[np.arange(len(p)), i] + b[np.arange(len(p)), j] <= index.radius
        found = one if p is x else found | one
        assert one.mean() > 0.95
    assert found.mean() > 0.98


@pytest.mark.parametrize("rank", [64, 6])
def test_recall_of_the_operator(spark, rank):
    """The whole operator with its own recall setting, in clusters of vectors near the threshold, against brute force."""
    rng = np.random.default_rng(rank)
    x, y = at_threshold(rng, 900, 64, rank)
    y = E.unit_rows(y + 0.002 * x)
    rows = [(i, v.tolist(), i % 900 % 2) for i, v in enumerate(np.concatenate([x, y]))]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, label int, node int, root string").repartition(3)
    got = {r["vec_id"]: r["n_links"] for r in E.near_duplicates(df).collect()}
    v = E.unit_rows(np.array([r[1] for r in rows]))
    label = np.array([r[2] for r in rows])
    want = ((v @ v.T >= 0.93) & (label[:, None] == label)).sum(axis=1) - 1
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.98 * want.sum() and want.sum() >= 1800


def test_traversal_is_in_order_and_complete():
    rng = np.random.default_rng(2)
    index = E.MultiIndex(rng.standard_normal((300, 8)), 6, 0.93, 0.9)
    _, _, a, b = index.places(E.unit_rows(rng.standard_normal((5, 8))))
    for r in range(5):
        cells = list(index.traverse(a[r], b[r]))
        bounds = [a[r][i] + b[r][j] for i, j in cells]
        assert bounds == sorted(bounds)
        assert set(cells) == {(i, j) for i in range(6) for j in range(6) if a[r][i] + b[r][j] <= index.radius}


def test_empty(spark):
    df = spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in E.near_duplicates(df).collect()] == [(1, 0, 1, True)]
    assert E.near_duplicates(df.limit(0)).count() == 0
