"""Find, explain and track unusual values in tables, on Spark DataFrames."""
