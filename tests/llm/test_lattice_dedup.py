from __future__ import annotations

import itertools

import numpy as np
import pytest

from corvane.llm import lattice_dedup as lattice

SCHEMA = "vec_id long, embedding array<double>, label int, row string, key string, v string, weight string, component_id string"


def frame(spark, rows):
    plain = [(i, v if v is None else [x if x is None else float(x) for x in v]) for i, v in rows]
    return spark.createDataFrame([(i, v, 0, "r", "k", "v", "w", "c") for i, v in plain], SCHEMA)


def brute(rows, least=0.95):
    """Links, components and kept rows, by comparing all pairs."""
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v in rows]
    u = [None if not g else (a := np.array(v) / max(map(abs, v))) / np.sqrt((a * a).sum()) for g, (_, v) in zip(good, rows, strict=True)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if good[a] and good[b] and len(u[a]) == len(u[b]) and float(u[a] @ u[b]) >= least:
            links[a] += 1
            links[b] += 1
            root[top(a)] = top(b)
    names = {}
    for x, (i, _) in enumerate(rows):
        names[top(x)] = min((n for n in (names.get(top(x)), i) if n is not None), default=None)
    return sorted([(i, links[x], names[top(x)], i == names[top(x)]) for x, (i, _) in enumerate(rows)], key=repr)


def ours(df):
    return sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(df).collect()], key=repr)


def turned(rng, x, cosine):
    z = rng.normal(size=x.shape)
    z -= (z @ x) / (x @ x) * x
    return cosine * x / np.linalg.norm(x) + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


def test_decoding_gives_the_nearest_lattice_point():
    rng = np.random.default_rng(0)
    x = rng.uniform(-2, 2, (300, 8))
    best = lattice.decoded(x)
    assert ((2 * best) % 2 == (2 * best[:, :1]) % 2).all() and (best.sum(axis=1) % 2 == 0).all()
    near = lattice.neighbours()
    assert near.shape == (240, 8) and len(np.unique(near, axis=0)) == 240 and (np.abs((near**2).sum(axis=1) - 2) < 1e-12).all()
    distance = ((x - best) ** 2).sum(axis=1)
    assert (distance <= 1 + 1e-9).all()  # the covering radius
    assert (distance[:, None] <= ((x[:, None] - best[:, None] - near) ** 2).sum(axis=2) + 1e-9).all()


def test_recall_of_pairs_just_alike():
    rng = np.random.default_rng(1)
    for cosine, least in ((0.9501, 0.98), (0.97, 0.997)):
        x = rng.normal(size=(3000, 64))
        y = np.stack([turned(rng, v, cosine) for v in x])
        a, b = lattice.cells(lattice.unit(x)), lattice.cells(lattice.unit(y))
        met = ((a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)).any(axis=1)
        assert met.mean() >= least


@pytest.mark.parametrize("tile", [1024, 16])
def test_links_equal_brute_force(spark, monkeypatch, tile):
    """Groups of near copies, chains, exact copies, scaled copies, and what takes no part; a large cell in many tiles."""
    monkeypatch.setattr(lattice, "TILE", tile)
    rng = np.random.default_rng(2)
    rows = [(1000 + i, list(v)) for i, v in enumerate(rng.normal(size=(150, 24)))]
    heart = rng.normal(size=24)
    rows += [(2000 + i, list(heart + 0.03 * rng.normal(size=24))) for i in range(160)]
    rows += [(10 + i, list(heart)) for i in range(5)] + [(20, list(3 * heart)), (21, list(1e200 * heart)), (22, list(-heart))]
    step = rng.normal(size=24)
    for i in range(12):  # a chain, whose ends are not alike
        rows.append((3000 - i, list(step)))
        step = turned(rng, step, 0.985)
    rows += [(30, None), (31, []), (32, [0.0] * 24), (33, [None] * 24), (34, [float("nan")] * 24), (35, [float("inf")] + [1.0] * 23)]
    rows += [(None, list(heart)), (None, list(rng.normal(size=24))), (40, [1.0, 2.0]), (41, [1.0, 2.001]), (10, list(rng.normal(size=24)))]
    assert ours(frame(spark, rows).repartition(5)) == brute(rows)


def test_empty(spark):
    assert ours(frame(spark, [])) == []
    assert ours(frame(spark, [(1, None)])) == [(1, 0, 1, True)]
