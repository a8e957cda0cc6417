"""Column functions on questions, answers and query results."""
