"""Condition vector and threshold search end to end (survey section 3.3).

pairs (J10) -> pairwise contrast matrix (C3) -> first principal direction (C4)
-> orientation (C6) -> [save (K5)] -> similarities (C8) -> grid search (C10/C17)
-> predictions (C11).  Every step is a distributed job; only the directions,
the threshold grid and the best cell are parameter-sized tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolens.operators import contrast as CT
from protolens.operators.corpus import contrastive_zip
from protolens.operators.params import materialize
from protolens.operators.pooling import pool_masked_mean


def condition_search(vectors: DataFrame, layers: Sequence[int], label: str = "label", id_col: str = "example_id",
                     method: str = "pca_pairwise", max_layers: int = 1, threshold_range=(0.0, 1.0),
                     threshold_step: float = 0.01, seed: int = 42, directions_path: str | None = None) -> dict:
    """``vectors``: (example_id, layer, label, vector), one pooled vector per example and layer.

    Returns directions, the grid table, the best cell and per-example predictions.
    """
    from protolens.sources import sinks as SK

    first = vectors.where(F.col("layer") == int(layers[0])).select(id_col, label)
    ids = contrastive_zip(first, id_col, label, seed)
    pairs = CT.pair_vectors(vectors, ids, ["layer"], id_col)
    directions = CT.read_directions(pairs, ["layer"], method)
    if directions_path:
        SK.save_directions(directions, directions_path)
    sims = CT.condition_similarity(vectors.where(F.col("layer").isin([int(x) for x in layers])), directions, ["layer"])
    sims = materialize(sims.select(id_col, "layer", label, "similarity"))  # slim, and read by the grid and the predictions
    grid = CT.grid_f1(sims, first, layers, max_layers, threshold_range, threshold_step, id_col)
    best = CT.best_condition_point(grid)
    preds = CT.condition_predictions(sims, best, id_col)
    return {"directions": directions, "similarities": sims, "grid": grid, "best": best, "predictions": preds}


def condition_search_from_tokens(token_vectors: DataFrame, labels: DataFrame, layers: Sequence[int],
                                 mode: str = "mean", **kw) -> dict:
    """Same search from token vectors: 'mean' pools valid positions (V2), 'last' takes the last valid one (V1)."""
    from protolens.operators.pooling import pool_last_token

    pooled = pool_masked_mean(token_vectors, ["example_id", "layer"]) if mode == "mean" else \
        pool_last_token(token_vectors, ["example_id", "layer"])
    return condition_search(pooled.join(labels, "example_id"), layers, **kw)
