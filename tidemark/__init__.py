"""tidemark: point-in-time analytics over entity snapshots and dated facts, on Spark."""

from tidemark.config import Settings

__all__ = ["Settings"]
