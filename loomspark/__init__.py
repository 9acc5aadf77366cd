"""A library of relational, time-series and statistical operators on Spark DataFrames."""
