"""Endurance-training analytics on Spark DataFrames."""

from wattspark.session import build_session

__all__ = ["build_session"]
