"""corvane: a Spark-native document index, query and safe-reading engine."""

__version__ = "0.1.0"
