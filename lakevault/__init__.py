"""Content-addressed, deduplicating snapshot storage and its analytics on Spark."""

__all__ = ["__version__"]
__version__ = "0.1.0"
