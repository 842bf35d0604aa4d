"""Document retrieval and retrieval-augmented question answering as Spark DataFrame operations."""

from .session import get_spark

__all__ = ["get_spark"]
