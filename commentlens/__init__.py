"""Comment-quality analytics on Spark: ingest, rules, clustering, review, datasets, streaming."""

__version__ = "0.1.0"
