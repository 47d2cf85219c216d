"""Territorial events on Spark: snapshots in, typed events, counts, indicators and radius searches out.

Every operator takes DataFrames (or Columns) and returns lazy DataFrames (or
Columns); only sinks and pipelines run jobs.
"""
