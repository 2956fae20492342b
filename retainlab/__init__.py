"""retainlab: retention-risk analytics expressed as Spark DataFrame plans.

Subpackages
-----------
sources    scans, the derived student table, stage loading, request batches, sinks
functions  column-expression building blocks (features, cut, label rule, ordered helpers)
operators  DataFrame -> DataFrame operators (contract, prep, split, models, metrics,
           scoring, explanations, exploration)
plans      end-to-end plans (training, scoring, explanation report)
streaming  Structured Streaming variants of the scoring plans
"""

from retainlab.session import get_spark

__all__ = ["get_spark"]
