"""folioforge: a Spark-first engine for document knowledge bases and text corpora."""

__version__ = "0.1.0"
