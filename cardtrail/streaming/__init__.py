"""Incremental jobs over a history that grows by new files (new ``pdate``
partitions)."""
