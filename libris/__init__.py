"""Book-catalogue reconciliation on Spark DataFrames."""
