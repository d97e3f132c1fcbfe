"""Reference-integrity and corpus analytics on Spark: functions from DataFrames to a DataFrame."""
