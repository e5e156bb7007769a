"""Event-history and posterior analytics on PySpark DataFrames."""
