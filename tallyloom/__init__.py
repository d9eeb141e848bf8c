"""Spark-native evaluation, benchmark and text-data analytics."""

from tallyloom.session import get_session

__all__ = ["get_session"]
