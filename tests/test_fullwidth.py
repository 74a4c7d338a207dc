"""Full-width numpy re-derivations for the operators whose SQL oracle runs on a 2-dim slice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from protolens.operators import contrast as CT
from protolens.operators import scoring as SC
from protolens.operators import stats as S
from protolens.operators.corpus import contrastive_zip
from protolens.plans.common import layer_vectors, train_test

from .conftest import SF_CHECK


@pytest.fixture(scope="module")
def fitted(spark):
    tr, te = train_test(spark, SF_CHECK)
    fit = S.fit_gda(tr, ["layer"], "label", per_class=True)
    return tr, te, fit, tr.toPandas(), te.toPandas()


def _prep(ptr, layer):
    d = ptr[ptr.layer == layer]
    x, y = np.stack(d.vector.to_numpy()), d.label.to_numpy()
    mus = np.stack([x[y == k].mean(0) for k in (0, 1)])
    xc = np.concatenate([x[y == k] - mus[k] for k in (0, 1)])
    c = xc.T @ xc / (len(x) - 1)
    p = 16 * np.linalg.inv((len(x) - 1) * c + np.trace(c) * np.eye(16))
    pk = []
    for k in (0, 1):
        z = x[y == k] - mus[k]
        ck = z.T @ z / (len(z) - 1)
        pk.append(16 * np.linalg.inv((len(z) - 1) * ck + np.trace(ck) * np.eye(16)))
    return mus, p, pk


def test_gda_and_mahalanobis_full_width(fitted):
    tr, te, fit, ptr, pte = fitted
    logits = {(r.example_id, r.layer): r.logits for r in SC.gda_logits(te, fit["params"], ["layer"]).collect()}
    maha = {(r.example_id, r.layer): r.maha for r in SC.mahalanobis_sq(te, fit["means"], fit["precision"], ["layer"]).collect()}
    cmaha = {(r.example_id, r.layer): r.maha for r in
             SC.mahalanobis_class_sq(te, fit["means"], fit["class_precision"], ["layer"]).collect()}
    for layer in (1, 2, 3):
        mus, p, pk = _prep(ptr, layer)
        w, b = mus @ p, np.log(0.5) - 0.5 * np.einsum("nd,dc,nc->n", mus, p, mus)
        for _, row in pte[pte.layer == layer].iterrows():
            x = np.asarray(row.vector)
            key = (row.example_id, layer)
            assert np.allclose(logits[key], x @ w.T + b, atol=1e-9)
            assert np.allclose(maha[key], [(x - m) @ p @ (x - m) for m in mus], atol=1e-9)
            assert np.allclose(cmaha[key], [(x - mus[k]) @ pk[k] @ (x - mus[k]) for k in (0, 1)], atol=1e-9)


def test_principal_direction_full_width(spark):
    v = layer_vectors(spark, SF_CHECK)
    ids = contrastive_zip(v.where("layer = 1").select("example_id", "label"), "example_id", "label")
    pairs = CT.pair_vectors(v, ids, ["layer"])
    d = {r.layer: (np.array(r.direction), r.evr) for r in CT.read_directions(pairs, ["layer"]).collect()}
    pp = pairs.select("layer", "pos", "neg").toPandas()
    for layer in (1, 2, 3):
        q = pp[pp.layer == layer]
        pos, neg = np.stack(q.pos.to_numpy()), np.stack(q.neg.to_numpy())
        mid = (pos + neg) / 2
        train = np.concatenate([pos - mid, neg - mid])
        train = train - train.mean(0)
        _, s, vt = np.linalg.svd(train, full_matrices=False)
        v1 = vt[0]
        evr = s[0] ** 2 / np.sum(s ** 2)
        got, got_evr = d[layer]
        assert abs(abs(got @ v1) - 1.0) < 1e-9 and abs(got_evr - evr) < 1e-9
        # orientation: positives project above negatives at least as often as below
        proj_p, proj_n = pos @ got, neg @ got
        assert np.mean(proj_p > proj_n) >= np.mean(proj_p < proj_n)


def test_wide_vectors_take_the_arrow_path(spark):
    """d = 300 (> the higher-order-function limit): Gram fit and Mahalanobis scoring against numpy."""
    import pandas as pd

    rng = np.random.default_rng(1)
    d, n = 300, 700
    x = rng.normal(size=(n, d)) + 3.0
    y = (rng.random(n) < 0.5).astype(int)
    x[y == 1] += 0.4
    pdf = pd.DataFrame({"example_id": np.arange(n), "layer": 7, "label": y, "vector": list(x)})
    df = spark.createDataFrame(pdf)
    fit = S.fit_gda(df, ["layer"], "label")
    got = {r.example_id: r.maha for r in SC.mahalanobis_sq(df, fit["means"], fit["precision"], ["layer"]).collect()}
    mus = np.stack([x[y == k].mean(0) for k in (0, 1)])
    xc = np.concatenate([x[y == k] - mus[k] for k in (0, 1)])
    c = xc.T @ xc / (n - 1)
    p = d * np.linalg.inv((n - 1) * c + np.trace(c) * np.eye(d))
    for i in (0, 11, 333, 699):
        exp = [(x[i] - m) @ p @ (x[i] - m) for m in mus]
        assert np.allclose(got[i], exp, rtol=1e-9, atol=1e-8)
