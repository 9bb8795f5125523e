"""Row-change audit and time travel on Spark."""
