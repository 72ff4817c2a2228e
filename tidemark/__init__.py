"""Event-study, filing-text and point-in-time validation operators on Spark DataFrames."""
