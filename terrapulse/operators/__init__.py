"""Operators: DataFrames in, lazy DataFrames out.

No operator asks for a broadcast of a table that grows with the data. Joins with
dimensions carry no hint: Catalyst (and AQE at run time) broadcasts a side only
when its measured size is under `spark.sql.autoBroadcastJoinThreshold`, and
shuffles otherwise.
"""
