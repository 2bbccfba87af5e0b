"""A Spark-native analytics, query-acceleration and data-pipeline engine."""

from millrace.session import configure, get_session

__all__ = ["configure", "get_session"]
