"""lodestone: analytics over source trees, dependency claims and run logs, expressed as Spark DataFrames."""
