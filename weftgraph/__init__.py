"""Graph analytics and data-parallel operators on PySpark DataFrames."""
