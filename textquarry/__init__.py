"""textquarry: build, maintain and search text collections as Spark DataFrame jobs."""

__version__ = "0.1.0"
