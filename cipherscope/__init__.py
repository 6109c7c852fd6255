"""Cryptographic-inventory analytics as Spark jobs."""

from .session import ship

__all__ = ["ship"]
