"""Incremental forms: file streams run with ``availableNow``, so a run without new files is a no-op."""
