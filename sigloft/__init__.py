"""Event-driven market signals as Spark jobs.

Packages: ``functions`` (column expressions), ``operators`` (keyed, ordered, as-of, substring, velocity and vector
operators), ``sources`` (landed files and versioned tables), ``plans`` (the domain jobs), ``streaming`` (incremental
forms), ``catalog`` (the registered queries and their SQL checks).
"""
