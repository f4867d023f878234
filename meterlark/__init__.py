"""Usage analytics and corpus operators for API gateways, on Spark DataFrames."""
