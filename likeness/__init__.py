"""Similarity and copy analytics over document tables, written for Spark."""

from likeness.session import build_session

__all__ = ["build_session"]
