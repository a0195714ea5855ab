"""Street-segment analytics on Spark: every operator is a DataFrame or Column builder."""
