"""retentia: churn analytics on Spark.

Event log -> per-user behavioural features -> encoded vectors -> classifiers,
metrics, tuning and batch scoring, all as DataFrame / spark.ml plans.
"""

from retentia.schema import EVENT, FEATURES, FeatureSpec
from retentia.session import build_session, scratch_path

__all__ = ["EVENT", "FEATURES", "FeatureSpec", "build_session", "scratch_path"]
