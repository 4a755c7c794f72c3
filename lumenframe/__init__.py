"""Spark-native SQL analytics engine."""

from lumenframe.session import Session

__all__ = ["Session"]
