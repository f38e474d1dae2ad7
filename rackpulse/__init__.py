"""Fleet telemetry on Spark: ingest, message log, device and sample tables, queries.

Every operator takes DataFrames and returns DataFrames; Spark plans, partitions
and shuffles the work.
"""
