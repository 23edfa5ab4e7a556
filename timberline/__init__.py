"""Log analytics and columnar log encoding on Spark DataFrames."""
