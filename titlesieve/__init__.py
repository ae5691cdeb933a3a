"""Screening of proposed titles against a corpus, as Spark jobs."""

from .config import ScreeningConfig

__all__ = ["ScreeningConfig"]
