"""Job-posting analytics as Spark DataFrame, SQL and Structured Streaming jobs.

Every operator is a function of DataFrames (plus an explicit ``as_of`` time
where "now" matters) that returns a DataFrame; nothing is collected inside.
"""
