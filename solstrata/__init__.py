"""solstrata: Spark-native analytics over smart-contract source corpora."""

__version__ = "0.1.0"
