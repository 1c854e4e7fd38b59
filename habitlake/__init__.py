"""habitlake — habit and team productivity analytics on Spark.

Operators take and return DataFrames; every one runs for all users in one
distributed pass (the request key of a per-user lookup becomes a group or
join key).
"""

__version__ = "0.1.0"
