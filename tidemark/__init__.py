"""Time-grid analytics and training-data preparation on PySpark."""
