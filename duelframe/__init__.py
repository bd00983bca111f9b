"""Paired-contest analytics as Spark DataFrame operators."""

from .keys import Keys

__all__ = ["Keys"]
