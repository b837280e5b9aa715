"""Content-curation operators on Spark DataFrames."""

from newsweft.params import Params

__all__ = ["Params"]
