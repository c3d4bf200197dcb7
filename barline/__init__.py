"""Market-data jobs on Spark: long tables in, DataFrames out."""
