"""Plan helpers: shared storage, size-checked broadcast, column picking."""
