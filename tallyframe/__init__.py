"""Spark-native feature, profiling and scoring engine for one-to-many history data."""

from tallyframe.session import build_session

__all__ = ["build_session"]
