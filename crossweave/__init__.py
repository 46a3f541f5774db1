"""crossweave: panel analytics and training-data operators on PySpark DataFrames."""
