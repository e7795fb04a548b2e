"""varloom: variation-graph analytics on PySpark DataFrames."""
