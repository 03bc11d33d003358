"""Market-data research on PySpark: DataFrame operators and streaming jobs."""
