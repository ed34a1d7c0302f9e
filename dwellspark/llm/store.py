"""Cutting lineage: intermediate tables in the folder all executors share."""

from ..scratch import cut, drop, shared_dir

__all__ = ["cut", "drop", "shared_dir"]
