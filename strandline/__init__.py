"""Spark-first analytics for news-derived event data."""

from strandline.session import build_session, materialize, shared_dir

__all__ = ["build_session", "materialize", "shared_dir"]
