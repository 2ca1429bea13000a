"""annotary: literature annotation analytics on Spark DataFrames.

Everything takes and returns DataFrames; no module keeps a session or a path.
"""

__version__ = "0.1.0"
