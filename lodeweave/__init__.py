"""lodeweave: a Spark-native entity-resolution and ranked-retrieval engine."""

__version__ = "0.1.0"
