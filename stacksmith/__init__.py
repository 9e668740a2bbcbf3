"""stacksmith: Spark-native feature preparation, profiling, out-of-fold
stacking, blending and self-training for tabular-plus-text binary tasks."""

__version__ = "0.1.0"
