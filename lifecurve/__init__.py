"""Life-curve analytics on PySpark DataFrames."""
