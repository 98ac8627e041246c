"""Design-based analysis of household-budget surveys on Spark DataFrames."""
