"""Principal axes without the d x d matrix, and the threshold grid counted in place."""

import itertools

import numpy as np
import pytest

from protolens.operators import contrast as CT


def _rows(spark, mats):
    return spark.createDataFrame([(k, v.tolist()) for k, x in enumerate(mats) for v in x], "layer int, vector array<double>").repartition(6)


@pytest.mark.parametrize("d,n", [(3, 50), (40, 200), (700, 60), (600, 400)])
def test_krylov_axes_equal_the_eigenvectors(spark, d, n):
    rng = np.random.default_rng(d)
    mats = [rng.normal(size=(n, d)) * (1 + 9 * (np.arange(d) == d // 2) + 5 * (np.arange(d) == 1)) + 30.0,
            rng.normal(size=(n, 2)) @ rng.normal(size=(2, d))]  # rank 2: the iteration ends by itself
    got = {(r.layer, r.component): r for r in CT.principal_directions(_rows(spark, mats), ["layer"], k=2, engine="krylov").collect()}
    assert len(got) == 4
    for layer, x in enumerate(mats):
        c = x - x.mean(0)
        _, s, vt = np.linalg.svd(c, full_matrices=False)
        for k in (0, 1):
            r = got[layer, k]
            assert abs(abs(np.dot(r.direction, vt[k])) - 1) < 1e-9
            assert abs(r.evr - s[k] ** 2 / np.sum(s ** 2)) < 1e-9 and abs(r.variance - s[k] ** 2 / (n - 1)) < 1e-6
            assert r.direction[int(np.argmax(np.abs(r.direction)))] > 0


def test_engines_agree_and_auto_goes_by_width(spark, monkeypatch):
    rng = np.random.default_rng(1)
    df = _rows(spark, [rng.normal(size=(90, 24)) * np.linspace(1, 4, 24)])
    a = CT.principal_directions(df, ["layer"], k=2, engine="gram").collect()
    monkeypatch.setattr(CT, "GRAM_MAX_DIM", 8)
    b = CT.principal_directions(df, ["layer"], k=2).collect()
    for x, y in zip(sorted(a, key=lambda r: r.component), sorted(b, key=lambda r: r.component)):
        assert np.allclose(x.direction, y.direction, atol=1e-7) and abs(x.evr - y.evr) < 1e-12
    assert CT.principal_directions(df.limit(0), ["layer"], engine="krylov").count() == 0


def test_grid_against_every_cell(spark, monkeypatch):
    monkeypatch.setattr(CT, "HELD_EXAMPLES", 40)  # several blocks a task
    rng = np.random.default_rng(6)
    sims = {(i, x): (None if rng.random() < .1 else float("nan") if rng.random() < .02 else float(rng.uniform(-.2, 1.2)))
            for i in range(200) for x in (2, 5, 9, 11) if rng.random() < .9 and i % 17}
    y = {i: int(rng.random() < .4) for i in range(200)}
    df = spark.createDataFrame([(i, x, s) for (i, x), s in sims.items()], "example_id int, layer int, similarity double").repartition(3)
    labels = spark.createDataFrame(list(y.items()), "example_id int, label int")
    got = {(r.combo, r.j, r.direction): r for r in CT.grid_f1(df, labels, [2, 5, 9, 11], 3, (0.0, 1.0), 0.1).collect()}
    combos = [c for r in (1, 2, 3) for c in itertools.combinations((2, 5, 9, 11), r)]
    assert len(got) == len(combos) * 10 * 2
    order = {r.combo: r.combo_idx for r in got.values()}
    assert [k for k, _ in sorted(order.items(), key=lambda e: e[1])] == ["_".join(map(str, c)) for c in combos]
    for c in combos:
        per = {i: [s for x in c if (s := sims.get((i, x))) is not None] for i in y}
        per = {i: v for i, v in per.items() if v}
        top = {i: float("inf") if any(np.isnan(s) for s in v) else max(v) for i, v in per.items()}
        low = {i: min((s for s in v if not np.isnan(s)), default=float("inf")) for i, v in per.items()}
        for j in range(10):
            t = 0.0 + j * 0.1
            for direction in ("smaller", "larger"):
                on = {i: (top[i] > t) if direction == "smaller" else (low[i] <= t) for i in per}
                r = got["_".join(map(str, c)), j, direction]
                want = (sum(on[i] and y[i] for i in on), sum(on[i] and not y[i] for i in on), sum(not on[i] and y[i] for i in on))
                assert (r.tp, r.fp, r.fn) == want and r.layers == list(c) and r.r == len(c)
                assert abs(r.f1 - (2 * want[0] / (2 * want[0] + want[1] + want[2]) if sum(want) else 0.0)) < 1e-12


def test_grid_of_32_layers_and_three_at_a_time(spark):
    """5488 combinations: every example stays one row."""
    rng = np.random.default_rng(3)
    rows = [(i, x, float(s)) for i, v in enumerate(rng.random((300, 32))) for x, s in enumerate(v)]
    df = spark.createDataFrame(rows, "example_id int, layer int, similarity double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "example_id int, label int")
    grid = CT.grid_f1(df, labels, range(32), 3)
    assert grid.count() == 5488 * 100 * 2
    best = CT.best_condition_point(grid).first()
    assert best.f1 >= 2 / 3 and 1 <= len(best.layers) <= 3


def test_pairs_take_one_row_a_rank(spark):
    v = spark.createDataFrame([(1, i, [float(i), 1.0]) for i in range(6)] + [(2, i, [0.0, float(i)]) for i in range(5)], "layer int, example_id int, vector array<double>")
    pairs = spark.createDataFrame([(1, 0, 3), (2, 1, 4), (3, 2, 5), (4, 0, 99)], "rank int, pos_id int, neg_id int")
    got = {(r.layer, r.rank): (r.pos_id, r.neg_id, r.pos, r.neg) for r in CT.pair_vectors(v, pairs).collect()}
    assert got == {**{(1, k): (p, n, [float(p), 1.0], [float(n), 1.0]) for k, p, n in ((1, 0, 3), (2, 1, 4), (3, 2, 5))},
                   **{(2, k): (p, n, [0.0, float(p)], [0.0, float(n)]) for k, p, n in ((1, 0, 3), (2, 1, 4))}}
