"""Document-graph analytics and training-data preparation on PySpark."""
