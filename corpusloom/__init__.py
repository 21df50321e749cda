"""Word-embedding analytics on Spark: every step from text to vectors is a DataFrame operator."""

from corpusloom.config import EmbeddingConfig

__all__ = ["EmbeddingConfig"]
