"""quadrille: temporal graph analytics on Spark DataFrames."""
