"""Web-page analytics on Spark: extraction, topics, robots, scheduling, results, metrics."""
