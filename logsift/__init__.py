"""logsift: search and analyse text logs with Spark DataFrames."""

from logsift.schemas import SavedSearch, SearchSpec  # noqa: F401

__all__ = ["SearchSpec", "SavedSearch"]
