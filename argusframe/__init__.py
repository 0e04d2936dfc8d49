"""argusframe: security-event analytics and corpus preparation on Spark DataFrames."""
