"""Service-operations analytics as Spark DataFrame / Structured Streaming jobs.

Every operator is a function ``DataFrame -> DataFrame`` (or several DataFrames in,
one out).  ``as_of`` is always an explicit parameter so results are reproducible.
"""

DEFAULT_AS_OF = "2024-02-01 00:00:00"
