"""The generic TPC-H-like tables seen as territorial data, in Spark and in SQL."""
