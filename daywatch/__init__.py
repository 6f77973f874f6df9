"""daywatch: user-day risk analytics on Spark DataFrames."""
