"""Dataset-level operators. None of them gathers all rows of one key into a task or on the driver."""
