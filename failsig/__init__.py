"""failsig: CI failure triage on Spark.

Logs become one row per failed test, failures become stable signatures, and signatures fold
into a pattern knowledge base that is linked to skip markers and reported on.
"""

__version__ = "0.1.0"
