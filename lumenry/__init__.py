"""Spark-native engine for style-conditioned caption corpora."""

__version__ = "0.1.0"
