"""protolens: vector moderation analytics on PySpark (DataFrame in, DataFrame out).

Subpackages: ``sources`` (readers, sinks, fixture views), ``functions`` (column
expressions), ``operators`` (statistics, scoring, metrics, sampling, contrast,
rollups), ``plans`` (end-to-end flows and the query catalog), ``streaming``.
"""

from protolens.operators.stats import class_means, class_scatter, fit_gda, pooled_covariance  # noqa: F401
from protolens.operators.scoring import gda_logits, mahalanobis_sq, nmc_pred, softmax_probs  # noqa: F401
from protolens.operators.metrics import binary_scores, ranking_metrics  # noqa: F401
from protolens.plans.flagship import evaluate_files, multilayer_report, stack_evaluate  # noqa: F401

__version__ = "0.1.0"
