"""Document reconciliation analytics on Spark DataFrames."""
