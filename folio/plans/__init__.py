"""End-to-end plans and the queries that bind the operators to tables."""
