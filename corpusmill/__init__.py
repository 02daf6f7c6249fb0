"""corpusmill: a Spark-first engine that prepares and searches text collections."""

__version__ = "0.1.0"
